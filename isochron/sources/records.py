"""Records from JSON, JSON lines and text; question sets; sinks for cases, measurements and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_questions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """question of each record of a ``json``, ``jsonl`` or ``txt`` file; broken JSON fails, blank lines and leading numbers of text go."""
    if kind == "txt":
        text = F.trim(F.regexp_replace("value", r"^\s*\d+[.)]\s*", ""))
        return spark.read.text(path).select(text.alias("question")).where("question <> ''")
    if kind not in ("json", "jsonl"):
        raise ValueError(f"unknown kind: {kind}")
    return spark.read.json(path, schema="question string, sql string, prod_question string", multiLine=kind == "json", mode="FAILFAST")


def question_column(records: DataFrame, use_prod: bool) -> DataFrame:
    """Records with the wording to ask: that of production where asked for and there."""
    return records.withColumn("asked", F.coalesce("prod_question", "question") if use_prod else F.col("question"))


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON lines in order of case_id, one folder per split."""
    cases.repartition("split").sortWithinPartitions("split", "case_id").write.mode("overwrite").partitionBy("split").json(path)


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """Adds outcome rows; a condition (arm, split, repeat) is a partition of its own and replaced as a whole."""
    outcomes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm", "split", "repeat").parquet(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def coalesced_metrics(artifacts: DataFrame, history: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Values from artifacts, from the metric history where those lack them."""
    h = history.select(*keys, *(F.col(v).alias(f"__{v}") for v in values))
    return artifacts.join(h, keys, "full_outer").select(*keys, *(F.coalesce(v, f"__{v}").alias(v) for v in values))
