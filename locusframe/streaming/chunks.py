"""Files read some at a time, each chunk through a user's function; a chunk that comes twice is kept once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Start of the names of the folders of chunks.
CHUNK = "__chunk="


def chunk_writer(make: Callable[[DataFrame], DataFrame], out: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: what make gives for a chunk replaces whatever out has of a chunk of this number."""

    def write(rows: DataFrame, chunk: int) -> None:
        make(rows).write.mode("overwrite").parquet(f"{out}/{CHUNK}{chunk}")

    return write


def start_chunks(stream: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Sends all rows that a stream has now through make, chunk by chunk; out and state are folders that executors share.

    Spark runs a chunk again after a failure, with the same number and the same rows, so its folder is written anew and no
    row is doubled. What is left of a failed attempt is replaced then; until it is, out lacks that chunk or has a part of it.
    Chunk -1 is what make gives for no rows: it keeps the columns where there is nothing to read.
    """
    empty = stream.sparkSession.createDataFrame([], stream.schema)
    chunk_writer(make, out)(empty, -1)
    return stream.writeStream.foreachBatch(chunk_writer(make, out)).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all chunks."""
    return spark.read.parquet(out).drop(CHUNK.rstrip("="))


def each_chunk(spark: SparkSession, path: str, schema: T.StructType, make: Callable[[DataFrame], DataFrame], out: str, state: str, files: int = 1, fmt: str = "parquet", **options: str) -> DataFrame:
    """make's rows for the files of a folder, some files a chunk; called again with the same out and state, for new files only.

    make sees a chunk as an ordinary DataFrame, so it may filter, join or aggregate; it is called for no rows too. Aggregates
    are of one chunk, to be merged over what is returned. A file is never split over chunks, but over tasks.
    """
    stream = spark.readStream.schema(schema).format(fmt).options(**options).option("maxFilesPerTrigger", files).load(path)
    start_chunks(stream, make, out, state).awaitTermination()
    return read_chunks(spark, out)
