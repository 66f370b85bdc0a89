"""N-gram Jaccard join with parity sketches, and the components of its links.

A document is the set of its hashed shingles. Of two sets with Jaccard similarity of at
least ``percent`` the symmetric difference is at most
``(x + y) (100 - percent) / (100 + percent)``. Per size band the shingles are dealt to
parts, each a sketch of 2^32 bits in which every shingle flips one bit: the Hamming
distance of such parity sketches is never above the symmetric difference. A part's word is
the XOR of the hashes of its set bits. Each difference spoils one part at most, so of a
document's non-empty parts, all but as many as its differences agree with any set that it
links with: joining on (band, part, word) loses no link. More parts are made than
differences are allowed, and a document leaves out so many of its most frequent words as
it has to spare: of the words that a link shares, the rarest stays on both sides, as all
documents rank words alike. A document with too few parts that are not empty sends them
all, empty ones as well.

Candidates are first each document with the one that it shares most words with, of those
that are least in a group. Then each group that still holds several components is searched
for links between them: smaller sketches bound each pair from below, and pairs within the
bound go on; of large groups first only those that would join components, then, where
components are left, all. Every candidate is verified on the exact sets. Documents with
equal sets are one class, and a task sends the words of a class once.

Defined results: null or empty texts and texts without words have no shingles, size 0
and are alone; fewer words than a shingle are one shingle; A-Z only are lowered; whole
texts are used; rows with one id are joined as if they linked (they share a component),
whatever their texts; a null id counts as the least id; empty tables give no rows; other
columns are not read. Sets are compared by 64-bit hashes of their shingles, which no fixed
words collide in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanveil.llm import hashing
from spanveil.llm.scratch import discard, keep

TABLE = hashing.Table(102, lower=True)
FIRST = -(1 << 63)
#: A group of more documents than this is large.
MANY = 32
#: Members of a group that are compared in one cell; candidates that a task settles at once; classes that a task remembers.
CELL, HELD, SEEN = 1024, 250_000, 100_000
#: A wide sketch has so many times the bits of a small one.
WIDER = 4
#: Rows of a batch that goes back to Spark.
BATCH_ROWS = 50_000
#: A table of at most so many ids goes to all tasks; larger ones are joined by sort and merge.
SMALL = 200_000
#: Sketches of so many bytes go to all tasks; more are joined by sort and merge.
BROADCAST_BYTES = 8 << 20
#: Words of sketches that are compared at once.
SLICE_WORDS = 1 << 19
#: Rows of the first pass: words for links within the own size band, with the next band, and one row a document.
OWN, NEXT, INFO = 0, 1, 2


class Bands:
    """Sizes up to tops[b] are band b; most differences of links within it, parts, and bits of a small sketch."""

    def __init__(self, percent: int, widest: int = 1 << 40):
        self.percent = percent
        tops = [6]
        while tops[-1] < widest:
            tops.append(tops[-1] * 3 // 2)
        self.tops = np.array(tops, np.int64)
        self.most = self.differences(2 * self.tops)
        self.parts = self.most + self.most // 4 + 9
        bits = np.maximum(64, 4 * self.most)
        self.bits = (1 << np.ceil(np.log2(bits)).astype(np.int64)).astype(np.int64)

    def differences(self, total):
        return total * (100 - self.percent) // (100 + self.percent)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.tops, sizes)

    def reaches(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether a size may link with the least size of the next band."""
        return 100 * sizes >= self.percent * (self.tops[band] + 1)

    def allowed(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Most differences of a set with any set of the band that it links with."""
        return self.differences(sizes + np.minimum(self.tops[band], sizes * 100 // self.percent))


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of a chunk, sorted."""
    starts, ends, first = hashing.spans(data, off)
    h = hashing.word_hashes(data, starts, ends, TABLE)
    del starts, ends
    n = np.diff(first)
    g = hashing.ngrams(h, width)
    if len(n) == 1 and n[0] >= width:
        g = np.unique(g)
        return np.zeros(len(g), np.int64), g
    at = np.arange(len(g))
    doc = np.repeat(np.arange(len(n)), n)
    inside = at + width <= first[doc[: len(g)] + 1]
    docs, hashes = [doc[: len(g)][inside]], [g[inside]]
    for size in range(1, width):
        short = np.flatnonzero(n == size)
        if len(short):
            docs.append(short)
            hashes.append(hashing.ngrams(h, size, salt=size)[first[short]])
    doc, g = np.concatenate(docs), np.concatenate(hashes)
    o = np.lexsort((g, doc))
    doc, g = doc[o], g[o]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    return doc[fresh], g[fresh]


def _reduce(op, values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """op over the values of each document; n: how many each has."""
    out = np.zeros(len(n), np.uint64)
    if len(values):
        out[n > 0] = op.reduceat(values, (np.cumsum(n) - n)[n > 0])
    return out


def part_words(doc: np.ndarray, g: np.ndarray, bands: Bands, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with a band of at least 0: (document, part, word), each part of each; the word of an empty part is 0."""
    use = band[doc] >= 0
    d, h = doc[use], g[use]
    parts = np.where(band >= 0, bands.parts[band], 0)
    base = np.cumsum(parts) - parts
    flat = base[d] + (((h >> np.uint64(32)) * parts[d].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    words = np.zeros(int(parts.sum()), np.uint64)
    if len(flat):
        head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        words[flat[head]] = np.bitwise_xor.reduceat(hashing.mix((h & np.uint64(0xFFFFFFFF)) + np.uint64(1)), head)
    owner = np.repeat(np.arange(len(band)), parts)
    return owner, np.arange(len(words)) - base[owner], words


def small_sketches(doc: np.ndarray, g: np.ndarray, bits: np.ndarray) -> list[bytes]:
    base = np.cumsum(bits) - bits
    flips = np.bincount(base[doc] + ((g >> np.uint64(6)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
    packed = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [packed[b // 8 : (b + w) // 8] for b, w in zip(base.tolist(), bits.tolist())]


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, value: np.ndarray, extra: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(key).view(np.int64)), pa.array(doc), pa.array(value * 4 + kind), pa.nulls(len(doc), pa.binary()) if extra is None else pa.array(extra, pa.binary())], ["key", "doc", "meta", "extra"]
    )


def _sketched(bands: Bands, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for ids, data, off in hashing.chunks(batches):
            doc, g = shingle_sets(data, off, width)
            n = np.bincount(doc, minlength=len(ids))
            one, two = _reduce(np.add, g, n), _reduce(np.add, hashing.mix(g ^ np.uint64(0x5851F42D4C957F2D)), n)
            band = bands.of(n)
            extra = [a + b + s for a, b, s in zip(*[[x.tobytes() for x in col] for col in (one, two)], small_sketches(doc, g, np.where(n > 0, bands.bits[band], 64)))]
            yield _rows(INFO, hashing.mix(ids.view(np.uint64)), ids, n, extra)
            new = np.zeros(len(ids), bool)
            for i, pair in enumerate(zip(one.tolist(), two.tolist())):
                if pair not in seen and n[i]:
                    new[i] = True
                    seen.add(pair)
            if len(seen) > SEEN:
                seen.clear()
            for kind, target, use in ((OWN, band, new), (NEXT, band + 1, new & bands.reaches(n, band))):
                most = bands.allowed(n, target)
                own = np.where(use & (most > 0), target, -1)
                owner, part, word = part_words(doc, g, bands, own)
                filled = np.bincount(owner[word != 0], minlength=len(ids))
                spare = np.maximum(0, filled - most - 1)
                stay = (word != 0) | (filled <= most)[owner]
                owner, part, word = owner[stay], part[stay], word[stay]
                key = hashing.mix(word ^ hashing.mix((own[owner] * (1 << 40) + part).astype(np.uint64) + np.uint64(1)))
                for a in range(0, len(key), BATCH_ROWS):
                    at = slice(a, a + BATCH_ROWS)
                    yield _rows(kind, key[at], ids[owner[at]], spare[owner[at]])

    return run


def _small(df: DataFrame) -> DataFrame:
    """A hint to send df to all tasks if it is small; df must be a written table."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def rarest(words: DataFrame) -> DataFrame:
    """(key, doc) of words (key, doc, kind, spare, total), less the spare most frequent of each document."""
    rank = F.row_number().over(Window.partitionBy("doc", "kind").orderBy(F.desc("total"), "key"))
    return words.withColumn("rank", rank).where("rank > spare").select("key", "doc")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): least id reachable of every node; edges: a, b, both among the nodes."""
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    held = keep(nodes.select("id", F.col("id").alias("comp")), "labels")
    labels, changed = held, 1
    while changed:
        near = keep(both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("low")), "least")
        lower = keep(labels.join(near, labels.id == near.a, "left").select("id", "comp", F.least("comp", F.coalesce("low", "comp")).alias("low")), "lower")
        onward = lower.select(F.col("id").alias("low"), F.col("low").alias("far"))
        jumped = keep(lower.join(onward, "low").select("id", "comp", F.least("low", "far").alias("low")), "jumped")
        for done in (held, near, lower):
            discard(done)
        changed = jumped.where("low < comp").limit(1).count()
        held, labels = jumped, jumped.select("id", F.col("low").alias("comp"))
    discard(both)
    return labels


def _distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the longer folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    return x if len(x) == size else np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def _near(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, na, nb, sa, sb = (c.to_pylist() for c in t.columns)
            ok = [_distance(x, y) <= bands.differences(p + q) and 100 * min(p, q) >= bands.percent * max(p, q) for p, q, x, y in zip(na, nb, sa, sb)]
            yield pa.RecordBatch.from_arrays([t.column(0).filter(pa.array(ok, pa.bool_())), t.column(1).filter(pa.array(ok, pa.bool_()))], ["a", "b"])

    return run


def _joining(bands: Bands, everything: bool):
    """Pairs of different components that may link, of each group of rows (group, id, comp, n, sketch, wide), sorted by group.

    A pair goes on if the distance of the sketches, then of the wide ones if given, is within its bound. Of a group of more than
    MANY, as in Kruskal's algorithm, the nearest pairs go on that join its components, one
    fewer than these at most; with everything, all pairs do.
    """

    def matrix(sketches) -> np.ndarray:
        size = min(map(len, sketches)) // 8
        return np.array([_folded(np.frombuffer(s, np.uint64), size) for s in sketches])

    def distances(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        step = max(1, SLICE_WORDS // x.shape[1])
        parts = [np.bitwise_count(x[i[a : a + step]] ^ x[j[a : a + step]]).sum(axis=1, dtype=np.int64) for a in range(0, len(i), step)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def near_pairs(comp, n, sketches, wide) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances and indices of the pairs."""
        x, out = matrix(sketches), []
        y = None if wide[0] is None else matrix(wide)
        for a in range(0, len(n), 64):
            i, j = np.nonzero((comp[a : a + 64, None] != comp[None, :]) & (np.arange(a, min(a + 64, len(n)))[:, None] < np.arange(len(n))[None, :]))
            i += a
            fits = 100 * np.minimum(n[i], n[j]) >= bands.percent * np.maximum(n[i], n[j])
            i, j = i[fits], j[fits]
            apart = distances(x, i, j)
            near = apart <= bands.differences(n[i] + n[j])
            apart, i, j = apart[near], i[near], j[near]
            if y is not None and len(i):
                near = distances(y, i, j) <= bands.differences(n[i] + n[j])
                apart, i, j = apart[near], i[near], j[near]
            out.append((apart, i, j))
        return tuple(np.concatenate(c) for c in zip(*out))

    def pairs(ids, comp, n, sketches, wide) -> np.ndarray:
        apart, i, j = near_pairs(comp, n, sketches, wide)
        if len(ids) > MANY and not everything:
            root = {c: c for c in comp.tolist()}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            joins = []
            for k in np.argsort(apart, kind="stable").tolist():
                p, q = top(int(comp[i[k]])), top(int(comp[j[k]]))
                if p != q:
                    root[p] = q
                    joins.append(k)
            i, j = i[joins], j[joins]
        return np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], axis=1)

    def whole(t: pa.Table) -> Iterator[np.ndarray]:
        group, ids, comp, n = (np.asarray(t.column(c).combine_chunks()) for c in range(4))
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(heads[1:], len(group))
        open_ = np.minimum.reduceat(comp, heads) != np.maximum.reduceat(comp, heads)
        sketches, wide = t.column(4), t.column(5)
        for a, b in zip(heads[open_].tolist(), ends[open_].tolist()):
            yield pairs(ids[a:b], comp[a:b], n[a:b], sketches.slice(a, b - a).to_pylist(), wide.slice(a, b - a).to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: list[np.ndarray] = []
        size = 0
        for t in batches:
            group = np.asarray(t.column(0))
            if not len(group):
                continue
            if held and held[-1].column(0)[-1].as_py() != group[0]:
                found += whole(pa.Table.from_batches(held))
                held = []
            last = np.flatnonzero(group != group[-1])
            if len(last):  # the last group of the batch may go on in the next one
                cut = int(last[-1]) + 1
                found += whole(pa.Table.from_batches([*held, t.slice(0, cut)]))
                held = []
                t = t.slice(cut)
            held.append(t)
            size = sum(map(len, found))
            if size > HELD:
                found = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > HELD // 2:
                    yield _pairs(found[0])
                    found = []
        if held:
            found += whole(pa.Table.from_batches(held))
        if found:
            yield _pairs(np.unique(np.concatenate(found), axis=0))

    return run


def _pairs(a: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1]))], ["a", "b"])


class Join:
    """The stages of one join over texts (doc, text) with an id each; ids are of classes of equal sets, by their least document."""

    def __init__(self, text: DataFrame, width: int, percent: int):
        self.width, self.bands, self.text = width, Bands(percent), text
        rows = text.mapInArrow(_sketched(self.bands, width), "key long, doc long, meta long, extra binary")
        kind, value = F.col("meta").bitwiseAND(3), F.shiftright("meta", 2)
        rows = rows.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("key"))).where((kind == INFO) | (F.col("total") > 1))
        rows = keep(rows.withColumn("total", F.col("total").cast("int")), "parity-rows")
        info = rows.where(kind == INFO).select("doc", value.alias("n"), F.substring("extra", 1, 16).alias("same"), F.expr("substring(extra, 17)").alias("sketch"))
        self.classes = keep(info.where("n > 0").groupBy("same", "n").agg(F.min("doc").alias("id"), F.min("sketch").alias("sketch")), "parity-classes")
        self.members = keep(info.select("doc", "n", "same").join(self.classes.select("same", "n", "id"), ["same", "n"], "left").select("doc", "n", F.coalesce("id", "doc").alias("id")), "parity-members")
        moved = keep(self.members.where("id <> doc").select("doc", "id"), "parity-moved")
        linked = rarest(rows.where(kind != INFO).select("key", "doc", kind.alias("kind"), value.alias("spare"), "total"))
        plain = keep(linked.join(_small(moved), "doc", "left").select("key", F.coalesce("id", "doc").alias("id")).distinct(), "parity-plain")
        discard(rows)
        groups = keep(plain.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("f")).where("f > 1"), "parity-groups")
        self.words = keep(plain.join(groups, "key"), "parity-words")
        for done in (plain, groups, moved):
            discard(done)

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(id, shingles) of the classes in the pairs."""
        width = self.width
        ids = keep(pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct(), "parity-ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, data, off in hashing.chunks(batches):
                doc, g = shingle_sets(data, off, width)
                ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(keys))))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(g.view(np.int64)))], ["id", "shingles"])

        found = self.text.join(_small(ids), "doc", "left_semi").mapInArrow(run, "id long, shingles array<long>")
        return keep(found, "parity-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets are similar enough; pairs must be a written table."""
        sets = self.sets(pairs)
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        union = F.size("x") + F.size("y") - common
        links = keep(both.where(100 * common >= self.bands.percent * union).select("a", "b").distinct(), "parity-links")
        discard(sets)
        return links

    def described(self, pairs: DataFrame) -> DataFrame:
        side = lambda c: self.classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def stars(self) -> DataFrame:
        """(a, b, c): b shares c words with a, the least class of their groups."""
        return keep(self.words.where("least < id").groupBy(F.col("least").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("c")), "parity-stars")

    def best(self, stars: DataFrame) -> DataFrame:
        """Of each class, the pair with the one that it shares most words with."""
        top = stars.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("m"))).alias("m"))
        return top.select((-F.col("m.m")).alias("a"), "b")

    def wide_sketches(self, ids: DataFrame) -> DataFrame:
        """(id, wide): sketches with WIDER times the bits, which few pairs beyond the bound pass."""
        bands, width = self.bands, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, data, off in hashing.chunks(batches):
                doc, g = shingle_sets(data, off, width)
                wide = small_sketches(doc, g, bands.bits[bands.of(np.bincount(doc, minlength=len(keys)))] * WIDER)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(wide, pa.binary())], ["id", "wide"])

        return keep(self.text.join(_small(ids), "doc", "left_semi").mapInArrow(run, "id long, wide binary"), "parity-wide")

    def across(self, labels: DataFrame, large_only: bool) -> DataFrame:
        """Pairs in different components that share a word and may link; see _joining.

        Of a large group, the members outside its largest component meet all others, in
        cells of bounded size: both sides are cut into blocks by hash, a cell for each pair
        of blocks. The largest component's members do not meet each other, so a group with
        few others costs little more than its size.
        """
        rows = self.words.where(F.col("f") > MANY) if large_only else self.words
        rows = keep(rows.select("key", "id", "f").join(labels, "id"), "parity-labelled")
        sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("comps"))
        open_ = keep(sizes.where("comps > 1").select("key", F.col("m.comp").alias("major"), F.col("m.c").alias("inside"), (F.col("all") - F.col("m.c")).alias("outside")), "parity-open")
        still = keep(rows.join(_small(open_), "key"), "parity-still")
        discard(rows)
        discard(open_)
        ids = keep(still.select(F.col("id").alias("doc")).distinct(), "parity-ids")
        info = self.classes.select("id", "n", "sketch").join(_small(ids), F.col("id") == F.col("doc"), "left_semi")
        if large_only:
            info = info.join(self.wide_sketches(ids), "id")
        else:
            info = info.withColumn("wide", F.lit(None).cast("binary"))
        info = keep(info, "parity-info")
        large = F.col("f") > MANY
        inner, outer = (F.when(large, F.ceil(F.col(c) / CELL)).otherwise(1).cast("int") for c in ("inside", "outside"))
        is_major, upto = F.col("comp") == F.col("major"), lambda n: F.sequence(F.lit(0), n - 1)
        mine = F.pmod(F.xxhash64("id"), F.when(is_major, inner).otherwise(outer)).cast("int")
        cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
        met_all = F.transform(upto(inner), lambda j: cell(0, j, F.col("mine")))
        met_each_other = F.transform(upto(outer), lambda j: cell(1, F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)))
        own = F.when(~large, F.array(cell(2, F.lit(0), F.lit(0)))).when(is_major, F.transform(upto(outer), lambda j: cell(0, F.col("mine"), j))).otherwise(F.concat(met_all, met_each_other))
        cells = still.withColumn("mine", mine).withColumn("cell", F.explode(own)).select(F.xxhash64("key", "cell.kind", "cell.i", "cell.j").alias("group"), "id", "comp")
        size = F.octet_length("sketch") + F.coalesce(F.octet_length("wide"), F.lit(0)) + 32
        if (info.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
            met = cells.repartition("group").join(F.broadcast(info), "id")
        else:
            met = cells.join(info, "id").repartition("group")
        dealt = met.select("group", "id", "comp", "n", "sketch", "wide").sortWithinPartitions("group")
        out = keep(dealt.mapInArrow(_joining(self.bands, large_only), "a long, b long").distinct(), "parity-across")
        for done in (info, still, ids):
            discard(done)
        return out


def _linked(text: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc, n, comp) of texts (doc, text) with an id each."""
    j = Join(text, width, percent)
    stars = j.stars()
    near = keep(j.described(j.best(stars)).mapInArrow(_near(j.bands), "a long, b long"), "parity-near")
    discard(stars)
    links = j.verified(near)
    nodes = keep(j.words.select("id").distinct(), "parity-nodes")
    labels = components(nodes, links)
    for large_only in (False, True):
        more = j.verified(j.across(labels, large_only))
        if more.limit(1).count():
            links = keep(links.unionByName(more), "parity-links")
            labels = components(nodes, links)
    discard(j.words)
    return j.members.join(labels, "id", "left").select("doc", "n", F.coalesce("comp", "id").alias("comp"))


def join_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (least id reachable by links, itself included)."""
    text = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    back = lambda c: F.nullif(F.col(c), F.lit(FIRST))
    if text.groupBy("doc").count().where("count > 1").limit(1).count():
        # rows that share an id get numbers of their own; then components that share an id are one
        rows = keep(text.select(F.monotonically_increasing_id().alias("row"), "doc", "text"), "parity-numbered")
        found = keep(_linked(rows.select(F.col("row").alias("doc"), "text"), width, percent).withColumnRenamed("doc", "row").join(rows.select("row", "doc"), "row"), "parity-found")
        first = found.groupBy("doc").agg(F.min("comp").alias("low"))
        edges = found.join(first, "doc").where("comp <> low").select(F.col("comp").alias("a"), F.col("low").alias("b")).distinct()
        groups = components(found.select(F.col("comp").alias("id")).distinct(), edges).withColumnRenamed("comp", "whole")
        out = keep(found.join(groups, found.comp == groups.id).select("doc", "n", "whole"), "parity-whole")
        least = out.groupBy("whole").agg(F.min("doc").alias("comp"))
        out = out.join(least, "whole")
    else:
        out = _linked(text, width, percent)
    return out.select(back("doc").alias(id_col), F.col("n").alias("n_shingles"), back("comp").alias("component_id"))
