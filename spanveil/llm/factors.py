"""Substring dedup by a relative Lempel-Ziv parse over words.

The reference of a document is all text before it: smaller ids, and its own earlier
words. Of equal windows of ``window`` words only the first stands in the index, so a word
has one place in the reference at most where a long enough match begins, and the longest
match is the extension from there: the greedy parse has no places to choose from. The
reference is indexed in blocks by anchor: in each window the least hashed ``GRAM``-gram is
its anchor, and consecutive windows with one anchor are a phrase. A block holds the
phrases of its anchor hashes, in the order (anchor, phrase, position); each phrase of a
document is looked up in the block of its anchor, so every document meets every block
that it shares text with. Where an anchor has several different phrases, each of their
windows is looked up by its own hash. What is found is a stretch of windows with its place
in the reference. Then each document is parsed from its first word on: stretches that go
on at the next place of the reference are one factor, the next factor on the path begins
where the last one ends, and windows across that boundary are checked by themselves and
are factors off the path. Before anything is shuffled a task settles what repeats within
itself and sends each phrase or window once, so frequent passages are a row a task, not a
row an occurrence.

Hashes: words have two hashes by independent tables. A phrase is compared by its anchor
under one and all its words under the other, a window by both; that two different given
windows of equal hashes exist has probability 2^-128, of phrases with one anchor 2^-64.

Defined results: a null or empty text has no words; a text of fewer words than a window
loses none; of equal windows the first by (id, start) stays; a null id counts as before
all others; rows with one id are taken for copies of one document, which loses in all of
them what it loses in one; whole texts are used; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm import hashing
from spanveil.llm.scratch import discard, keep

GRAM = 8
#: Phrases or windows that a task settles at once, words of a long text that are hashed at once.
HELD, BLOCK_WORDS = 400_000, 1 << 18
TABLE, SECOND = hashing.Table(101), hashing.Table(103)
#: Kinds of rows: to be looked up, settled, to be looked up window by window, a sign that an anchor has several phrases.
ASK, FACTOR, APART, SIGN = 0, 1, 2, 3
LAST, FIRST = (1 << 63) - 1, -(1 << 63)
SCHEMA = "kind int, a long, c long, doc long, at long, n long, ref_doc long, ref_at long"


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def blocks(first: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Words of a chunk to be hashed together: from, to, and the first word of each document in them; a long text comes in blocks that overlap by a window less a word."""
    if len(first) > 2:
        yield 0, int(first[-1]), first
        return
    for a in range(0, int(first[-1]), BLOCK_WORDS):
        b = min(int(first[-1]), a + BLOCK_WORDS + window - 1)
        yield a, b, np.array([0, b - a])
        if b == first[-1]:
            return


def phrases(h: np.ndarray, whole: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, phrase hash, document index, start and number of windows of each phrase.

    h: hashes of the words; whole: hashes of the windows; first: first word of each document.
    """
    reach = window - GRAM + 1
    none = np.empty(0, np.uint64), np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    if len(h) < window:
        return none
    g = hashing.ngrams(h, GRAM)
    starts = np.arange(len(h) - window + 1)
    ends = np.repeat(first[1:], np.diff(first))[: len(starts)]
    starts = starts[starts + window <= ends]
    if not len(starts):
        return none
    low, width = g, 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    least = np.minimum(low[starts], low[starts + reach - width])
    at = np.empty(len(starts), np.int64)
    for d in range(reach - 1, -1, -1):
        np.copyto(at, starts + d, where=g[starts + d] == least)
    doc = np.searchsorted(first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] != starts[:-1] + 1)
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(starts)))
    s = starts[head]
    # a phrase has fewer windows than a window has words, so its first and its last window hold all its words
    all_ = hashing.mix(hashing.mix(whole[s] + n.astype(np.uint64)) + whole[s + n - 1])
    return g[at[head]], all_, doc[head], s - first[doc[head]], n


def _joined(doc: np.ndarray, at: np.ndarray, n: np.ndarray, ref_doc: np.ndarray, ref_at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring factors of one document on one diagonal as one."""
    o = np.lexsort((at, doc))
    doc, at, n, ref_doc, ref_at = doc[o], at[o], n[o], ref_doc[o], ref_at[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] - at[1:] != ref_at[:-1] - at[:-1])
    head = np.flatnonzero(new)
    return doc[head], at[head], np.add.reduceat(n, head) if len(head) else n, ref_doc[head], ref_at[head]


def _rows(kind: int, a=None, c=None, doc=None, at=None, n=None, ref_doc=None, ref_at=None) -> pa.RecordBatch:
    size = len(a) if a is not None else len(doc)
    column = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(x, pa.int64())
    if a is None:  # settled rows only pass through the exchange: spread them
        a = _signed(hashing.mix(doc.view(np.uint64) * np.uint64(31) + at.view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *map(column, (a, c, doc, at, n, ref_doc, ref_at))], [x.split()[0] for x in SCHEMA.split(", ")])


def _settle(a: np.ndarray, c: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, anchors: bool) -> Iterator[pa.RecordBatch]:
    """What repeats among these rows is settled; the first of each goes on. anchors: a is an anchor that may have several phrases c."""
    o = np.lexsort((at, doc, c, a))
    a, c, doc, at, n = a[o], c[o], doc[o], at[o], n[o]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    origin = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    # of a phrase that is as early as its first, which only rows with one id can have, nothing is earlier
    again = ~fresh & ((doc != doc[origin]) | (at != at[origin]))
    if again.any():
        yield _rows(FACTOR, None, None, *_joined(doc[again], at[again], n[again], doc[origin[again]], at[origin[again]]))
    a, c, doc, at, n = a[fresh], c[fresh], doc[fresh], at[fresh], n[fresh]
    if not anchors or not len(a):
        yield _rows(ASK, a, c, doc, at, n)
        return
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    size = np.diff(np.append(head, len(a)))
    several = np.repeat(size > 1, size)
    yield _rows(ASK, a[~several], c[~several], doc[~several], at[~several], n[~several])
    if several.any():
        zero = np.zeros(several.sum(), np.int64)
        d, s, m, *_ = _joined(doc[several], at[several], n[several], zero, at[several])
        yield _rows(APART, None, None, d, s, m)
        for i in (head[size > 1], (head + size - 1)[size > 1]):
            yield _rows(SIGN, a[i], c[i], np.full(len(i), LAST))


class _Held:
    def __init__(self, anchors: bool):
        self.parts: list[tuple] = []
        self.size, self.anchors = 0, anchors

    def add(self, part: tuple) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            columns = [np.concatenate(x) for x in zip(*self.parts)]
            self.parts, self.size = [], 0
            yield from _settle(*columns, self.anchors)


def _looked_up(rows: DataFrame, several: bool) -> DataFrame:
    """Factors of the rows that have an earlier equal; with several, also the windows to be looked up singly."""
    by_block = Window.partitionBy("a")
    order = by_block.orderBy("c", "doc", "at")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.col("kind").isin(ASK, SIGN)
    fresh = F.coalesce(F.lag("c").over(order) != F.col("c"), F.lit(True))
    seen = rows.withColumn("origin", F.when(asked, F.struct("doc", "at"))).withColumn("fresh", fresh)
    seen = seen.withColumn("origin", F.last(F.when(F.col("fresh"), F.col("origin")), ignorenulls=True).over(past))
    if several:
        ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = seen.withColumn("apart", F.first("c").over(ends) != F.last("c").over(ends))
    else:
        seen = seen.withColumn("apart", F.lit(False))
    ask = F.col("kind") == ASK
    earlier = ask & ~((F.col("origin.doc") == F.col("doc")) & (F.col("origin.at") == F.col("at"))) & ~F.col("fresh")
    settled = F.when(earlier, F.lit(FACTOR)).when(ask & F.col("apart"), F.lit(APART)).when(F.col("kind").isin(FACTOR, APART), F.col("kind"))
    return seen.select(
        settled.alias("kind"), "doc", "at", "n", F.when(earlier, F.col("origin.doc")).otherwise(F.col("ref_doc")).alias("ref_doc"), F.when(earlier, F.col("origin.at")).otherwise(F.col("ref_at")).alias("ref_at")
    ).where("kind is not null")


def parse(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Factors of at least a window that occur earlier: doc_id, start, windows, ref_doc_id, ref_start (words), greedy (on the path of the parse)."""
    text = _text(docs, id_col, text_col)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(anchors=True)
        for ids, data, off in hashing.chunks(batches):
            starts, ends, first = hashing.spans(data, off)
            for lo, hi, own in blocks(first, window):
                s, e = starts[lo:hi], ends[lo:hi]
                whole = hashing.ngrams(hashing.word_hashes(data, s, e, SECOND), window)
                a, c, doc, at, n = phrases(hashing.word_hashes(data, s, e, TABLE), whole, own, window)
                yield from held.add((_signed(a), _signed(c), ids[doc], at + lo, n))
        yield from held.flush()

    first_pass = keep(_looked_up(text.mapInArrow(anchored, SCHEMA), several=True), "factors")
    single = first_pass.where(F.col("kind") == APART).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(anchors=False)
        for batch in batches:
            lists, done = batch.column(2), 0
            for ids, data, off in hashing.chunks(iter([batch])):
                starts, ends, first = hashing.spans(data, off)
                doc, at, n = _flat(lists.slice(done, len(ids)))
                done += len(ids)
                inside = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.repeat(doc, n)
                place = first[doc] + inside
                fits = place + window <= first[doc + 1]
                place, doc, inside = place[fits], doc[fits], inside[fits]
                for lo, hi, _ in blocks(first, window):
                    here = (place >= lo) & (place <= hi - window)
                    at = place[here] - lo
                    if len(at):
                        g, g2 = (hashing.ngrams(hashing.word_hashes(data, starts[lo:hi], ends[lo:hi], t), window) for t in (TABLE, SECOND))
                        yield from held.add((_signed(g[at]), _signed(g2[at]), ids[doc[here]], inside[here], np.ones(len(at), np.int64)))
        yield from held.flush()

    met = text.join(single, "doc").select("doc", "text", "spans")
    second_pass = keep(_looked_up(met.mapInArrow(windows, SCHEMA), several=False), "window-factors")
    found = first_pass.where(F.col("kind") == FACTOR).unionByName(second_pass)
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "ref_doc", "ref_at")).alias("found"))
    out = keep(by_doc.mapInArrow(_parsed(window), "doc long, at long, n long, ref_doc long, ref_at long, greedy boolean"), "parse")
    discard(first_pass)
    discard(second_pass)
    back = lambda c: F.nullif(F.col(c), F.lit(FIRST))
    return out.select(back("doc").alias("doc_id"), F.col("at").alias("start"), F.col("n").alias("windows"), back("ref_doc").alias("ref_doc_id"), F.col("ref_at").alias("ref_start"), "greedy")


def _flat(lists: pa.Array) -> tuple[np.ndarray, ...]:
    """Row and fields of the structs of a list column; a null list is empty."""
    n = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), n), *(np.asarray(flat.field(i)) for i in range(flat.type.num_fields))


def _parsed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, at, n, ref_doc, ref_at = _joined(*_flat(batch.column(1)))
            path = np.zeros(len(doc), bool)
            last, end = -1, 0
            for i, (d, a, m) in enumerate(zip(doc.tolist(), at.tolist(), n.tolist())):
                if d != last:
                    last, end = d, 0
                if a + m > end:  # a window begins at or after the end of the factor before
                    path[i], end = True, a + m + window - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *map(pa.array, (at, n, ref_doc, ref_at, path))], ["doc", "at", "n", "ref_doc", "ref_at", "greedy"])

    return run


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _left(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the words that stay, joined by one space."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts[stay]] += 1
    mark[ends[stay]] -= 1
    use = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    at = np.flatnonzero(stay)
    doc = np.searchsorted(first, at, "right") - 1
    # the white space after a word stays as one space, unless the word is the last that its document keeps
    gaps = ends[at[:-1]][doc[1:] == doc[:-1]]
    use[gaps] = True
    out = data.copy()
    out[gaps] = 32
    total = np.append(0, np.cumsum(np.add.reduceat(use, off[:-1][off[:-1] < len(data)], dtype=np.int64))) if len(data) else np.zeros(1, np.int64)
    size = np.zeros(len(off) - 1, np.int64)
    filled = np.flatnonzero(off[:-1] < len(data))
    size[filled] = np.diff(total)
    size[np.diff(off) == 0] = 0
    return out[use], np.append(0, np.cumsum(size))


def remove(docs: DataFrame, factors: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_text (the words that stay, joined by one space)."""
    spans = factors.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), F.struct("start", "windows").alias("span")).groupBy("doc").agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids, data, off in hashing.chunks(iter([batch])):
                starts, ends, first = hashing.spans(data, off)
                doc, at, n = _flat(batch.column(2).slice(done, len(ids)))
                done += len(ids)
                edge = np.zeros(len(starts) + 1, np.int32)
                np.add.at(edge, np.minimum(first[doc] + at, first[doc + 1]), 1)
                np.add.at(edge, np.minimum(first[doc] + at + n + window - 1, first[doc + 1]), -1)
                stay = np.cumsum(edge[:-1]) == 0
                kept, ends_at = _left(data, off, starts, ends, first, stay)
                count = np.append(0, np.cumsum(stay))[first]
                n_words = np.diff(first)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends_at), pa.py_buffer(np.ascontiguousarray(kept))])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n_words), pa.array(n_words - np.diff(count)), text.cast(pa.large_string()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept_text"])

    met = _text(docs, id_col, text_col).join(spans, "doc", "left").select("doc", "text", "spans")
    return met.mapInArrow(cut, "doc long, n_words long, n_removed long, kept_text string").select(F.nullif(F.col("doc"), F.lit(FIRST)).alias(id_col), "n_words", "n_removed", "kept_text")


__all__ = ["parse", "remove"]
