"""locusframe: genomic coordinate data and association statistics as Spark DataFrames."""
