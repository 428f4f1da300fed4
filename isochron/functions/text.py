"""Text and JSON helpers as columns; Python is used only where brackets must be matched."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_key(text: str | Column) -> Column:
    """Trimmed lower case: what aliases are looked up by."""
    return F.lower(F.trim(text))


def cell(value: Column, width: int = 30) -> Column:
    """A cell for display: line breaks become blanks, long ones are cut and say their length; null stays null."""
    flat = F.regexp_replace(value.cast("string"), r"\s*[\r\n]+\s*", " ")
    return F.when(F.length(flat) > width, F.concat(F.left(flat, F.lit(width)), F.lit("... ("), F.length(flat).cast("string"), F.lit(" chars)"))).otherwise(flat)


def title(text: Column, width: int = 60) -> Column:
    """A title from a message: white space collapsed, cut at ``width``."""
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(width))


def without_thoughts(text: Column) -> Column:
    """An answer without its think blocks and the fences around its code."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?m)^```\w*\s*?$", ""), r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """The distinct alphanumeric words of a text in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def asks_within(asked: Column, description: Column) -> Column:
    """All words of ``asked`` are among those of ``description``."""
    return F.size(F.array_except(tokens(asked), tokens(description))) == 0


def number_in(text: Column, literal: Column) -> Column:
    """``literal`` occurs in ``text`` and isn't part of a longer number."""
    quoted = F.regexp_replace(literal, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\d.,])"), quoted, F.lit(r"(?![\d]|[.,]\d)")))


def stable_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def json_has(doc: Column, key: str) -> Column:
    """The JSON object has the key, be it with a null value (which get_json_object can't tell)."""
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def json_at(doc: Column, path: str) -> Column:
    """Value at a dotted path with list positions and ``*``: ``a.b.0.c``, ``a.*.c``."""
    parts = "".join(f"[{p}]" if p.isdigit() or p == "*" else f".{p}" for p in path.split("."))
    return F.get_json_object(doc, "$" + parts)


def _last_object(text: str | None) -> str | None:
    """The last well-formed JSON object in a text, scanned once from the left; nested ones belong to the outer."""
    if not text:
        return None
    decoder, at, found = json.JSONDecoder(), 0, None
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        if isinstance(value, dict):
            found = json.dumps(value, sort_keys=True, separators=(",", ":"))
        at = end
    return found


def last_json_object(text: Column) -> Column:
    """The last valid JSON object in free text, with sorted keys; null if there is none."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(_last_object)

    return F.pandas_udf(find, "string")(text)
