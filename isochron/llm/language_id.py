"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sampled text; a text, in lower case, is encoded with every
dictionary and belongs to the language that gives the fewest bytes. Where the margin is narrow, however long the
text, it is encoded again by the same coders, after text of each language. A margin that is narrow still means rejection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "und"
BLOCK = 1 << 14  # bytes encoded at once, so that the dictionary counts in all parts of a long text
LEVEL = 5
NARROW = 0.1  # a text whose margin is below this is encoded after text of each language,
CLOSE_BLOCK, CLOSE_LEVEL = 1 << 12, LEVEL  # so many bytes at once; more effort (19) takes 6 times as long and judges worse
CONTEXT, CONTEXTS = 512, 6  # bytes of that text, and how often another; headers and code tables then cost nothing extra


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text, mod 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(labelled: DataFrame, rows_per_language: int = 400, dictionary_bytes: int = 110_000, longest: int = 20_000, all_bytes: int = 32 << 20) -> dict[str, bytes]:
    """Dictionary of each language, from a sample of ``labelled`` (doc_id, text, lang).

    Bounds: of each label about ``rows_per_language`` rows, taken by a hash of their id, of at most ``longest`` characters;
    ``dictionary_bytes`` of text, or less where there are so many labels that all would have over ``all_bytes``. Only this
    sample reaches the driver. Rows without text or label teach nothing.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").where(F.char_length("text").between(1, longest)).select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}  # a row for each label
    if not counts:
        return {}
    dictionary_bytes = min(dictionary_bytes, all_bytes // len(counts))
    wanted = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))))
    rows = rows.withColumn("h", F.pmod(F.xxhash64(F.lit("sample"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(1 << 30))
    rows = rows.where(F.col("h") < F.element_at(wanted, F.col("lang"))).select("lang", "h", "doc_id", F.substring("text", 1, dictionary_bytes).alias("text"))
    sample = rows.orderBy("h", "doc_id", "text").limit(2 * rows_per_language * len(counts)).collect()
    parts: dict[str, bytes] = {}
    for r in sample:
        if len(parts.get(r.lang, b"")) < dictionary_bytes:
            parts[r.lang] = (parts.get(r.lang, b"") + b"\n" + r.text.lower().encode())[:dictionary_bytes]
    return {lang: parts[lang] for lang in counts if lang in parts}


def _coders(model: dict[str, bytes], level: int = LEVEL) -> list:
    import zstandard

    out = []
    for content in model.values():
        content = content[: -CONTEXT * CONTEXTS] or content
        # tables of the size that a block and its dictionary need; a level's own would take 85 MB for each language
        fit = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(content), write_content_size=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=fit)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=fit))
    return out


def _least(sizes: list[int]) -> tuple[int, float]:
    """Which is the least, and by what share it is below the next."""
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
    return best, 1.0 if rest is None else 1 - sizes[best] / rest if rest else 0.0


def _judge(model: dict[str, bytes]) -> Callable[[bytes], tuple[int, float]]:
    """A function of a text: which language of ``model`` it is in, and by what share its size is below the next one's."""
    usual = _coders(model)
    close = usual if CLOSE_LEVEL == LEVEL else _coders(model, CLOSE_LEVEL)
    before = [[x[-CONTEXT * (k + 1) :][:CONTEXT] for k in range(CONTEXTS)] for x in model.values()]
    alone = [sum(len(c.compress(x)) for x in own) for c, own in zip(close, before, strict=True)]

    def judge(data: bytes) -> tuple[int, float]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        best, score = _least([sum(len(c.compress(b)) for b in blocks) for c in usual])
        if score < NARROW:
            blocks = [data[i : i + CLOSE_BLOCK] for i in range(0, len(data), CLOSE_BLOCK)]
            sizes = [sum(len(c.compress(x + b)) for b in blocks for x in own) - n * len(blocks) for c, own, n in zip(close, before, alone, strict=True)]
            best, score = _least([max(0, n) for n in sizes])
        return best, score

    return judge


def has_letter(text: str | None) -> bool:
    """Whether ``text`` has a character of one of Unicode's categories of letters."""
    return text is not None and any(map(str.isalpha, text))


def identify(text: Column, model: dict[str, bytes], min_margin: float = 0.001) -> Column:
    """Struct (lang, score, rejected) of a text column.

    score: by how much the best language's size is below the next one's, as a share of that (0 to 1;
    1 if there is one language only). rejected: the text is null or has no letter (lang is ``und``,
    score 0), no language was learned (the same), or the score is under ``min_margin``. Ties go to the
    language with the most labels and have a score of 0. Whole texts are encoded, by one rule for all lengths.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        names, judge = list(model), _judge(model)
        for batch in batches:
            rows = []
            for t in batch:
                if not names or not has_letter(t):
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                best, score = judge(t.lower().encode())
                rows.append((names[best], score, score < min_margin))
            yield pd.DataFrame(rows, columns=["lang", "score", "rejected"])

    return F.pandas_udf(predict, "lang string, score double, rejected boolean")(text)


def predictions(docs: DataFrame, **bounds: int) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.

    Learns from the rows that are not held out. Other columns are ignored. An empty table, or one
    without labels, teaches nothing and all are ``und``.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()), **bounds)
    found = docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_identified(docs: DataFrame, min_margin: float = 0.001, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns. Rows with a label and not held out teach."""
    model = learn(docs.where(~held_out()), **bounds)
    return docs.withColumn("__found", identify(F.col("text"), model, min_margin)).where("NOT __found.rejected").drop("__found")
