"""Hierarchical packing of token sequences into several context sizes.

Each task packs its own documents; nothing is shuffled. Whole windows of the longest
tier are cut from long documents. What remains of each document is routed to the
smallest tier that holds it; from the longest remainder down, each opens a window of its
tier, the gap is filled with the longest remainders of shorter tiers that fit whole, and
the last few tokens with the head of a shorter remainder, whose rest goes back. So every
window is full, and a tier is a power of two. What is left at a task's end is cut into
falling powers of two. Windows of a tier are dealt to step groups of equal tokens
by falling attention cost, back and forth.

Defined results: a null or empty text is one end token; no padding arises; rows that
repeat are packed each; a pool of remainders has a bounded number of tokens; sequence ids
are unique (task, then order); the same input splits give the same result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import tokens

TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens of remainders that are packed together, tokens of a step group.
POOL_TOKENS, STEP_TOKENS = 1 << 21, 1 << 17
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"

_ids: dict = {}


class Packer:
    """Takes (id, tokens as little-endian 32-bit bytes); gives (sequence, tier, pieces) where a piece is (id, start, bytes, document's tokens)."""

    def __init__(self, tiers: tuple[int, ...], pool_tokens: int):
        self.tiers, self.pool_tokens = sorted(tiers), pool_tokens
        self.pool: list[tuple] = []
        self.size = 0
        self.n = 0

    def add(self, key, data: bytes) -> Iterator[tuple[int, list]]:
        top, total = self.tiers[-1], len(data) // 4
        for start in range(0, total - top + 1, top):
            yield top, [(key, start, data[4 * start : 4 * (start + top)], total)]
        if rest := total % top:
            self.n += 1
            self.pool.append((rest, self.n, key, total - rest, data[4 * (total - rest) :], total))
            self.size += rest
        if self.size >= self.pool_tokens:
            yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[tuple[int, list]]:
        pool = sorted(self.pool, key=lambda p: p[:2])
        left: list[tuple] = []
        while pool:
            piece = pool.pop()
            tier = next(t for t in self.tiers if t >= piece[0])
            window, gap = [piece], tier - piece[0]
            while gap and pool:
                i = bisect_right(pool, gap, key=lambda p: p[0])
                if i:
                    x = pool.pop(i - 1)
                else:  # all that remain are longer than the gap: the head of the shortest
                    n, k, key, start, data, total = pool.pop(0)
                    x = (gap, k, key, start, data[: 4 * gap], total)
                    insort(pool, (n - gap, k, key, start + gap, data[4 * gap :], total), key=lambda p: p[:2])
                window.append(x)
                gap -= x[0]
            if gap:
                left = window
            else:
                yield tier, [x[2:6] for x in window]
        self.pool, self.size = left, sum(x[0] for x in left)
        if last:
            yield from self.tail()

    def tail(self) -> Iterator[tuple[int, list]]:
        pieces, rest = [x[2:6] for x in self.pool], self.size
        while rest:
            want = size = 1 << (rest.bit_length() - 1)
            window = []
            while want:
                key, start, data, total = pieces.pop(0)
                n = min(want, len(data) // 4)
                window.append((key, start, data[: 4 * n], total))
                if 4 * n < len(data):
                    pieces.insert(0, (key, start + n, data[4 * n :], total))
                want -= n
            yield size, window
            rest -= size


def balanced(windows: list[tuple[int, list]], step_tokens: int) -> Iterator[tuple[int, int, list]]:
    """(group, tier, pieces): windows of a tier in groups of step_tokens, dealt back and forth by falling sum of squared piece lengths."""
    by_tier: dict[int, list] = {}
    for tier, pieces in windows:
        by_tier.setdefault(tier, []).append(pieces)
    first = 0
    for tier in sorted(by_tier, reverse=True):
        own = sorted(by_tier[tier], key=lambda ps: -sum(len(p[2]) ** 2 for p in ps))
        groups = -(-len(own) * tier // step_tokens)
        for i, pieces in enumerate(own):
            turn, at = divmod(i, groups)
            yield first + (groups - 1 - at if turn % 2 else at), tier, pieces
        first += groups


def encoded(batches: Iterator[pa.RecordBatch], tokenizer_path: str, end: bytes) -> Iterator[tuple]:
    import numpy as np

    tok, marks = tokens.tokenizer(tokenizer_path)
    value = lambda e: np.array(e.ids, "<u4").tobytes()
    cache = _ids.setdefault(tokenizer_path, tokens.Pieces(tok, value))
    for ids, texts, words in tokens.runs(batches, marks):
        known = cache.learn(words)
        for key, text, ws in zip(ids, texts, words):
            data = value(tok.encode(text.decode(), add_special_tokens=False)) if ws is None else b"".join(map(known.__getitem__, ws))
            yield key, data + end


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece, see SCHEMA; ids are little-endian unsigned 32-bit token ids."""
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        packer, ready, held, count, group = Packer(tiers, pool_tokens), [], 0, 0, 0
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def rows(windows):
            nonlocal count, group
            columns: list[list] = [[] for _ in names]
            most = -1
            for g, tier, pieces in balanced(windows, step_tokens):
                at = 0
                for key, start, data, total in pieces:
                    n = len(data) // 4
                    for c, v in zip(columns, (key, start, n, data, total, task + count, at, tier, task + group + g)):
                        c.append(v)
                    at += n
                count, most = count + 1, max(most, g)
            group += most + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for key, data in encoded(batches, tokenizer_path, end):
            for window in packer.add(key, data):
                ready.append(window)
                held += window[0]
            if held >= pool_tokens:
                yield rows(ready)
                ready, held = [], 0
                # Arrow else keeps what earlier batches took
                pa.default_memory_pool().release_unused()
        ready.extend(packer.flush(last=True))
        if ready:
            yield rows(ready)
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(packed, SCHEMA).withColumnRenamed("doc_id", id_col)


__all__ = ["Packer", "balanced", "pack"]
