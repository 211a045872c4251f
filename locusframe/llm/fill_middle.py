r"""Fill-in-middle: texts cut into prefix, middle and suffix at units, and put together with signs in another order.

The cuts use a marker that is injected into the text: the marker and the escape character are escaped where a text holds
them, regexp_replace appends the marker to each unit (the white space before a word with the word, or what white space
is left at the end), units are the markers' count, substring_index takes the first so many units, and taking the markers out and
unescaping gives the text of a part. All are Spark expressions. Both control characters are no white space, so
escaping changes no unit; both are single code points, so all works on code points.

Where the cuts fall, whether a text is changed and in which order follow from a SHA-256 of seed and key, so every run agrees.

Null and empty texts stay as they are (form plain, empty output), as do texts that hold one of the signs, as they
could not be told from those put in. A null key counts as an empty one. Rows are changed one by one: repeated rows alike, rows
that share a key but not a text by the same numbers. Texts of any length are cut whole. Empty tables give no rows. The
names of df's other columns don't matter, unless they are those of results, which take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit; what it matches from left to right covers a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKER, ESCAPE = "\x1e", "\x1f"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def marked(text: Column) -> Column:
    """text with its own markers escaped and a marker after each unit."""
    safe = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARKER), F.lit(ESCAPE + "m"))
    return F.regexp_replace(safe, f"({UNIT})", f"$1{MARKER}")


def unmarked(part: Column) -> Column:
    """What marked was given, of a part of its result."""
    plain = F.replace(part, F.lit(MARKER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "m"), F.lit(MARKER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _first(marked: str, units: str) -> Column:
    """The first so many units of a marked column."""
    return F.expr(f"substring_index({marked}, '\\u{ord(MARKER):04x}', {units})")


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, share: int = 50, spm: int = 80) -> DataFrame:
    """df with units, form (plain, psm or spm), prefix, middle, suffix and output.

    share: texts changed in a hundred; spm: of those, the ones in a hundred whose suffix comes first. The parts of plain texts are null.
    """
    names = [c for c in df.columns if c.lower() not in ("units", "form", "prefix", "middle", "suffix", "output")]
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    at = df.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("whole"), digest.alias("digest"))
    at = at.select("*", marked(F.col("whole")).alias("marked"), *[x.alias(f"h{i + 1}") for i, x in enumerate(h)])
    at = at.select("*", (F.octet_length("marked") - F.octet_length(F.replace(F.col("marked"), F.lit(MARKER), F.lit("")))).cast("long").alias("units"))
    held = F.lit(False)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        held |= F.contains("whole", F.lit(sign))
    form = F.when((F.col("whole") == "") | held | (F.col("h3") % 100 >= share), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    cuts = [F.col(x) % (F.col("units") + 1) for x in ("h1", "h2")]
    at = at.select(*[f"c{i}" for i in range(len(names))], "whole", "marked", "units", form.alias("form"), F.least(*cuts).cast("int").alias("low"), F.greatest(*cuts).cast("int").alias("high"))
    changed = F.col("form") != "plain"
    at = at.withColumn("to_low", F.when(changed, _first("marked", "low"))).withColumn("to_high", F.when(changed, _first("marked", "high")))
    # a part that starts after a marker loses it with the others
    after = lambda whole, part: F.substring(whole, F.length(part) + 1, F.length(whole))
    at = at.withColumns({"prefix": unmarked(F.col("to_low")), "middle": unmarked(after(F.col("to_high"), F.col("to_low"))), "suffix": unmarked(after(F.when(changed, F.col("marked")), F.col("to_high")))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_first = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_first).otherwise(F.col("whole"))
    return at.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "units", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: parts hold no sign, so each sign is found where it was put."""
    before = lambda x, sign: F.substring_index(x, sign, 1)
    after = lambda x, sign: F.substring_index(x, sign, -1)
    middle = after(output, MIDDLE)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), middle, after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), middle, after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
