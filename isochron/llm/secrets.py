"""Secret scans: fixed patterns, and a battery of randomness tests for other strings.

Candidates are long runs of the base64 alphabet. Each gets the smallest of four encodings that has
all its characters, and three tests for that encoding: chi-squared uniformity over the alphabet, runs
of character classes, serial correlation at lag 1. A string that looks other than random in one of
them (p under ``REJECT``) is none. For the others, uniformity and runs are turned round: how
likely is it that written text of this length comes so close to random? These p-values are combined
by Fisher's method and the Benjamini-Hochberg procedure picks the secrets among all candidates of the
same encoding and length class, so that the share of false ones stays below ``rate`` at every length.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isochron.llm.common import cut

#: The patterns, and the least length of what each must match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16),
    ("base32", re.compile(r"[A-Z2-7]+"), 32),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 62),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 64),
)
REJECT = 0.001
#: Of written text: sum of squared symbol shares, and share of neighbours in different classes.
TEXT_REPEAT, TEXT_CHANGE = 0.066, 0.15
STEPS = 20  # p-values are rounded up to powers of 10 ** (1 / STEPS), so that they are few


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _cube_root(x: float, k: float, extra: float) -> float:
    """Upper tail of a chi-squared of ``k`` degrees and noncentrality ``extra`` (Sankaran's normal approximation)."""
    mean, spread = k + extra, k + 2 * extra
    h = 1 - 2 * mean * (k + 3 * extra) / (3 * spread**2)
    p = spread / mean**2
    m = (h - 1) * (1 - 3 * h)
    centre = 1 + h * p * (h - 1 - (2 - h) * m * p / 2)
    return _normal_tail(((x / mean) ** h - centre) / (h * math.sqrt(2 * p) * (1 + m * p / 2))) if x > 0 else 1.0


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


@functools.lru_cache(maxsize=50_000)
def battery(s: str) -> tuple[str, float]:
    """Encoding of ``s`` and the p-value of "written text that comes so close to random"; 1 if a test says not random."""
    body = s.rstrip("=")
    name, _, k = next(e for e in ENCODINGS if e[1].fullmatch(body))
    n = len(body)
    if body.isdigit() or n < 2:
        return name, 1.0
    if name == "hex" and body.isupper():
        body = body.lower()
    counts = [body.count(c) for c in set(body)]
    chi = sum(c * c for c in counts) * k / n - n
    # runs of classes: their chance of changing between neighbours, for random characters of the encoding
    shares = {"hex": (10, 0, 6, 0), "base32": (6, 26, 0, 0), "alnum": (10, 26, 26, 0), "base64": (10, 26, 26, 2)}[name]
    change = 1 - sum(x * x for x in shares) / k**2
    changes = sum(_kind(a) != _kind(b) for a, b in zip(body, body[1:], strict=False))
    spread = math.sqrt((n - 1) * change * (1 - change))
    codes = [ord(c) for c in body]
    mean = sum(codes) / n
    var = sum((c - mean) ** 2 for c in codes)
    serial = sum((a - mean) * (b - mean) for a, b in zip(codes, codes[1:], strict=False)) / var * math.sqrt(n) if var else math.inf
    random = min(_cube_root(chi, k - 1, 0), 2 * _normal_tail(abs(changes - (n - 1) * change) / spread), 2 * _normal_tail(abs(serial)))
    if random < REJECT:
        return name, 1.0
    p_uniform = 1 - _cube_root(chi, k - 1, n * max(0.1, k * TEXT_REPEAT - 1))
    p_runs = _normal_tail((changes - 0.5 - (n - 1) * TEXT_CHANGE) / math.sqrt((n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE)))
    x = -math.log(max(p_uniform, 1e-300)) - math.log(max(p_runs, 1e-300))
    return name, min(1.0, math.exp(-x) * (1 + x))  # Fisher, two tests: 4 degrees of freedom


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping per kind, by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int]]:
    """(start, end, class, step) of strings outside ``base`` that pass for random; step is -STEPS * log10(p), rounded down."""
    out = []
    for m in CANDIDATE.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        name, p = battery(m[0])
        out.append((m.start(), m.end(), f"{name}:{(m.end() - m.start()).bit_length()}", int(-STEPS * math.log10(max(p, 1e-30)))))
    return out


SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
GUESS = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("klass", pa.string()), ("step", pa.int32())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base array<struct<start,kind,end>>, guesses array<struct<start,end,klass,step>> of each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, guesses = [], []
            for t in b.column(1).to_pylist():
                own = base_spans(t or "")
                base.append([dict(zip(("start", "kind", "end"), x, strict=True)) for x in own])
                guesses.append([dict(zip(("start", "end", "klass", "step"), x, strict=True)) for x in candidates(t or "", own)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(SPAN)), pa.array(guesses, pa.list_(GUESS))], ["doc_id", "base", "guesses"])

    spans = "base array<struct<start:int,kind:int,end:int>>, guesses array<struct<start:int,end:int,klass:string,step:int>>"
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, {spans}")


def thresholds(scanned: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per class of candidates: klass, least (the step from which on they count as secrets).

    Benjamini-Hochberg over the counts per step: the smallest step whose p-value times the number of
    candidates is at most ``rate`` times the number that reach it. Bounded: 4 encodings, at most 31
    length classes, 601 steps.
    """
    steps = scanned.select(F.explode("guesses").alias("g")).groupBy("g.klass", "g.step").agg(F.count("*").alias("n"))
    every, down = W.partitionBy("klass"), W.partitionBy("klass").orderBy(F.desc("step"))
    steps = steps.withColumn("all", F.sum("n").over(every)).withColumn("reach", F.sum("n").over(down))
    p = F.pow(F.lit(10.0), -F.col("step") / F.lit(STEPS))
    return steps.where(p * F.col("all") <= F.lit(rate) * F.col("reach")).groupBy("klass").agg(F.min("step").alias("least"))


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id, text): doc_id, base, added; arrays of (start, kind, end) in code points.

    ``base`` are the spans of the fixed patterns (the whole match), ``added`` those of strings that
    the tests take for random; the two don't overlap. Null texts count as empty. One row per row,
    whatever the ids are; other columns are ignored.
    """
    scanned = cut(scan(docs))
    limits = {r.klass: r.least for r in thresholds(scanned, rate).collect()}  # at most 124 rows
    at = F.create_map(*(F.lit(x) for kv in (limits or {"": 0}).items() for x in kv))
    picked = F.filter("guesses", lambda g: F.coalesce(g["step"] >= F.try_element_at(at, g["klass"]), F.lit(False)))
    return scanned.select("doc_id", "base", F.transform(picked, lambda g: F.struct(g["start"].alias("start"), F.lit(3).alias("kind"), g["end"].alias("end"))).alias("added"))


def as_text(spans) -> F.Column:
    """kind:start:end by start, then kind, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random of each row of ``docs``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return find_secrets(docs, rate).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_random"),
    )
