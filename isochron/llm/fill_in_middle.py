"""Fill-in-the-middle: texts are cut in three by a hash of their id and put in another order behind sentinels.

Native SQL functions only: a regular expression makes the array of units, pieces of a SHA-256 give the cuts
and the form, slices of the array are joined to the arrangement. The inverse reads the sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a run of letters or one other code point; no text is lost between units.
UNIT = "([A-Za-z]+|[^A-Za-z])"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")


def arranged(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with n, form, output, prefix_chars, middle_chars. ``docs`` has doc_id and text; other columns pass through.

    n: units of the text. The digest of ``seed:doc_id`` draws two cuts, each evenly from the n + 1 places between units, and the form:
    plain (the text itself) for ``plain_percent`` of the documents and for texts that are empty or hold a
    sentinel; of the others ``spm_percent`` are suffix, prefix, middle and the rest prefix, suffix, middle, each behind its
    sentinel. prefix_chars and middle_chars (code points) are null for plain ones. A null text counts as
    empty, a null id as the empty string; rows that repeat an id are cut alike if their texts are. A text's
    units are in memory at once, some 60 bytes each.
    """
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    df = docs.drop("n", "form", "output", "prefix_chars", "middle_chars")
    df = df.withColumn("__units", F.regexp_extract_all(text, F.lit(UNIT), F.lit(1))).withColumn("__digest", digest)
    df = df.withColumn("n", F.size("__units").cast("bigint"))
    h = lambda k: _number(F.col("__digest"), k)
    cuts = h(1) % (F.col("n") + 1), h(2) % (F.col("n") + 1)
    df = df.withColumn("__lo", F.least(*cuts).cast("int")).withColumn("__hi", F.greatest(*cuts).cast("int"))
    held = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h(3) % 100 >= 100 - plain_percent)
    df = df.withColumn("form", F.when(held, "plain").when(h(4) % 100 < spm_percent, "spm").otherwise("psm"))
    cut = F.col("form") != "plain"
    piece = lambda start, length: F.when(cut, F.array_join(F.slice("__units", start, length), ""))
    df = df.withColumns({
        "__prefix": piece(F.lit(1), F.col("__lo")),
        "__middle": piece(F.col("__lo") + 1, F.col("__hi") - F.col("__lo")),
        "__suffix": piece(F.col("__hi") + 1, F.col("n").cast("int") - F.col("__hi")),
    })
    psm = F.concat(F.lit(PREFIX), "__prefix", F.lit(SUFFIX), "__suffix", F.lit(MIDDLE), "__middle")
    spm = F.concat(F.lit(SUFFIX), "__suffix", F.lit(PREFIX), "__prefix", F.lit(MIDDLE), "__middle")
    df = df.withColumn("output", F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm))
    df = df.withColumn("prefix_chars", F.char_length("__prefix").cast("bigint")).withColumn("middle_chars", F.char_length("__middle").cast("bigint"))
    return df.drop("__units", "__digest", "__lo", "__hi", "__prefix", "__middle", "__suffix")


def restored(output: Column, form: Column) -> Column:
    """The text of an arrangement, from output and form alone; null if the sentinels of the form are not there, each once and in order.

    A text with a sentinel is always plain, and none can arise where a piece meets one, as each begins with ``<`` and has no other.
    """
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    marks = F.array_join(F.regexp_extract_all(output, F.lit(f"({PREFIX}|{SUFFIX}|{MIDDLE})"), F.lit(1)), "")
    of = lambda name, order, *places: F.when((form == name) & (marks == "".join(order)) & (F.get(parts, F.lit(0)) == ""), F.concat(*(F.get(parts, F.lit(k)) for k in places)))
    psm = of("psm", (PREFIX, SUFFIX, MIDDLE), 1, 3, 2)
    spm = of("spm", (SUFFIX, PREFIX, MIDDLE), 2, 3, 1)
    return F.when(form == "plain", output).otherwise(F.coalesce(psm, spm))


def middle_report(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (of the text rebuilt from output and form). Rows and texts as in ``arranged``."""
    df = arranged(docs.select("doc_id", "text"), seed)
    sha = lambda c: F.sha2(c, 256)
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
