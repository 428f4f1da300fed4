"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public vocabulary file. That file ranks its pieces by merge order and has no
probabilities, so the log score of a piece is that of a Zipf-Mandelbrot law in its rank. Spaces become
the marker U+2581 and a text gets one in front; characters outside the vocabulary fall back to
their bytes. No piece has the marker after another character and none has a line feed, so the best
path of a text is made of the best paths of its words, which are kept in a bounded cache.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHIFT = 2.7  # of the Zipf-Mandelbrot law
UNKNOWN_PENALTY = 10.0
CACHED_WORDS, CACHED_BYTES = 300_000, 64
_UNIT = re.compile(rf" *[^ \n{MARK}]+| +|\n|{MARK}")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def double_array(keys: list[bytes], values: list[int]) -> tuple[list[int], list[int]]:
    """base and check of a trie of ``keys``: the child of s by byte b is t = base[s] + b + 1 if check[t] == s.

    The end of a key is a child by code 0, whose base is -1 - value. Node 0 is the root.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    base, check = [0], [0]
    used, free = bytearray(1), 1
    pending = [(0, 0, len(order), 0)]
    while pending:
        node, lo, hi, depth = pending.pop()
        children: list[tuple[int, int, int]] = []
        k = lo
        while k < hi:
            key = keys[order[k]]
            code = key[depth] + 1 if len(key) > depth else 0
            j = k
            while j < hi and (keys[order[j]][depth] + 1 if len(keys[order[j]]) > depth else 0) == code:
                j += 1
            children.append((code, k, j))
            k = j
        while free < len(used) and used[free]:
            free += 1
        at = max(1, free - children[0][0])
        while any(at + c < len(used) and used[at + c] for c, _, _ in children):
            at += 1
        need = at + children[-1][0] + 1 - len(used)
        if need > 0:
            used.extend(bytes(need))
            base.extend([0] * need)
            check.extend([-1] * need)
        base[node] = at
        for c, lo_c, hi_c in children:
            used[at + c], check[at + c] = 1, node
            if c:
                pending.append((at + c, lo_c, hi_c, depth + 1))
            else:
                base[at] = -1 - values[order[lo_c]]
    base.extend([0] * 257)
    check.extend([-1] * 257)
    return base, check


class Pieces:
    """Encoder and decoder for pieces and their log scores."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int]):
        self.bytes_of = [b""] * len(pieces)
        self.byte_id = [0] * 256
        keys, values = [], []
        for i, p in enumerate(pieces):
            if i in special:
                continue
            if m := _BYTE.fullmatch(p):
                self.byte_id[int(m[1], 16)] = i
                self.bytes_of[i] = bytes([int(m[1], 16)])
            else:
                keys.append(p.encode())
                values.append(i)
                self.bytes_of[i] = p.replace(MARK, " ").encode()
            if "\n" in p or re.search(f"[^{MARK}]{MARK}", p):
                raise ValueError(f"a piece crosses words: {p!r}")
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_id] = True
        self.base, self.check = double_array(keys, values)
        self.scores = scores
        self.unknown = min(scores[v] for v in values) - UNKNOWN_PENALTY
        self.cache: dict[str, bytes] = {}

    def viterbi(self, word: bytes) -> list[int]:
        """Ids of the best path through ``word`` (UTF-8, blanks as markers); ties go to the earliest start."""
        base, check, scores, n = self.base, self.check, self.scores, len(word)
        best, back, via = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            first, here = word[i], best[i]
            if first & 0xC0 == 0x80:
                continue
            single = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            s, j, known = 0, i, False
            while j < n:
                t = base[s] + word[j] + 1
                if check[t] != s:
                    break
                s, j = t, j + 1
                end = base[s]
                if check[end] == s:
                    piece = -1 - base[end]
                    score = here + scores[piece]
                    if score > best[j]:
                        best[j], back[j], via[j] = score, i, piece
                    known = known or j == single
            if not known and here + self.unknown > best[single]:
                best[single], back[single], via[single] = here + self.unknown, i, -1
        ids: list[int] = []
        while n:
            i = back[n]
            if via[n] >= 0:
                ids.append(via[n])
            else:
                ids.extend(self.byte_id[b] for b in reversed(word[i:n]))
            n = i
        return ids[::-1]

    def _unit(self, unit: str) -> bytes:
        if unit == MARK:  # in the text itself: its bytes, so that decoding gives it back
            ids = [self.byte_id[b] for b in MARK.encode()]
        else:
            ids = self.viterbi(unit.replace(" ", MARK).encode())
        packed = np.array(ids, "<i4").tobytes()
        if len(unit) <= CACHED_BYTES:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[unit] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; none for an empty one."""
        if not text:
            return np.zeros(0, "<i4")
        get, make = self.cache.get, self._unit
        return np.frombuffer(b"".join([get(u) or make(u) for u in _UNIT.findall(" " + text)]), "<i4")

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, the first marker goes."""
        pieces = self.bytes_of
        return b"".join([pieces[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")[1:]


@functools.cache
def load(path: str = MODEL) -> Pieces:
    """Pieces of a vocabulary file with scores -ln(rank + SHIFT), normalised; once per worker."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = len(p)
    ranks = [min(-p.get_score(i), n) for i in range(n)]
    total = math.log(sum(1 / (r + SHIFT) for r in ranks))
    special = {i for i in range(n) if p.is_control(i) or p.is_unknown(i)}
    return Pieces([p.id_to_piece(i) for i in range(n)], [-math.log(r + SHIFT) - total for r in ranks], special)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """ids array<int> of each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids. Null and empty texts have none."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in batches:
            ids = [coder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_tokens bigint, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of each row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, f"doc_id {kind}, text string")


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Encodes and decodes each row of ``docs`` (doc_id, text): doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip.

    ids_sha256 is of the ids as little-endian 32-bit numbers; round_trip tells that decoding gave the text back.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for b in batches:
            n, fallback, sha, same = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = coder.encode(t or "")
                n.append(len(ids))
                fallback.append(int(coder.is_byte[ids].sum()))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                same.append(coder.decode(ids) == (t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fallback, pa.int64()), pa.array(sha), pa.array(same)], ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, round_trip boolean")
