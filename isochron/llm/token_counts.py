"""Exact length histogram of encoded documents.

Documents are encoded with a byte-level BPE and counted by encoded length. Suffix sums over the
histogram answer, for every context limit L, how many documents are longer than L, how many tokens
there are, and how many stay when each document is cut at L.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: how the public byte-level BPE vocabulary splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def encoding(path: str):
    """The tokenizer of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens of each row of ``docs`` (column text). Null and empty texts have 0 tokens.

    Rows keep no other column. Texts are encoded whole. Lone surrogates cannot occur in Spark strings.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(vocabulary).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(count(t)) if t else 0 for t in b.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(encode, "n_tokens bigint")


def length_histogram(lengths: DataFrame, width: int = 64) -> DataFrame:
    """Per distinct length: n_tokens, docs, tokens, docs_longer, tokens_longer, docs_total, tokens_total, truncated_tokens, quantile.

    docs and tokens count documents of that length; the suffix sums docs_longer and tokens_longer
    those above it. truncated_tokens is what stays of the corpus when each document is cut at
    n_tokens; quantile the share of documents of at most that length. Running totals go in two
    levels (blocks of ``width`` lengths, then within a block), so no task sorts all lengths.
    An empty table gives no rows.
    """
    per = lengths.groupBy("n_tokens").agg(F.count("*").alias("docs"))
    per = per.withColumn("tokens", F.col("docs") * F.col("n_tokens")).withColumn("__block", F.floor(F.col("n_tokens") / width))
    blocks = per.groupBy("__block").agg(F.sum("docs").alias("__d"), F.sum("tokens").alias("__t"))
    above = W.partitionBy(F.lit(0)).orderBy(F.col("__block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    blocks = blocks.select(
        "__block",
        F.coalesce(F.sum("__d").over(above), F.lit(0)).alias("__d_above"), F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__t_above"),
        F.sum("__d").over(every).alias("docs_total"), F.sum("__t").over(every).alias("tokens_total"),
    )
    inside = W.partitionBy("__block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("__d_in", F.coalesce(F.sum("docs").over(inside), F.lit(0))).withColumn("__t_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    out = per.join(blocks, "__block").withColumn("docs_longer", F.col("__d_in") + F.col("__d_above")).withColumn("tokens_longer", F.col("__t_in") + F.col("__t_above"))
    return out.select(
        "n_tokens", "docs", "tokens", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
        (1 - F.col("docs_longer") / F.col("docs_total")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for context limits that need not be lengths: limit, docs_longer, truncated_tokens, tokens_total."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit bigint")
    longer = histogram.join(F.broadcast(asked), F.col("n_tokens") > F.col("limit"), "inner")
    cut_off = longer.groupBy("limit").agg(F.sum("docs").alias("docs_longer"), F.sum("tokens").alias("over"))
    totals = histogram.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_total")).first()[0]
    out = asked.join(cut_off, "limit", "left").fillna(0, ["docs_longer", "over"])
    return out.select("limit", "docs_longer", (F.lit(totals) - F.col("over") + F.col("docs_longer") * F.col("limit")).alias("truncated_tokens"), F.lit(totals).alias("tokens_total"))
