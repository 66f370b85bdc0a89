"""Nearest neighbours with randomly rotated one-bit codes.

Index: each vector, less a centre and normed, is padded with zeros to ``widen`` times its
dimension and turned by a seeded random orthogonal matrix; kept are one sign bit a turned
dimension and two scalars, the norm and the inner product of the turned vector with its
own code. Centre and dimension are fitted on the first ``sample`` valid rows; every valid
row is indexed. Search: the inner product of a query with a vector is estimated from the
vector's bits divided by the correction scalar; its error is at most ``epsilon`` times
``sqrt((1 - c^2) / c^2 / (D - 1))``, where epsilon is the quantile of such errors over
pairs of sampled rows that leaves out a share of ``miss``. Queries go out in blocks of
bounded size, one block after the other. A first scan of the codes finds the best
estimates of each query, ``ROUGH`` times k; the k-th least of their exact distances bounds the k-th nearest from above. A second
scan lists the vectors whose lower bound is not above that; only these are fetched, by a
join, and compared exactly. Both scans read the codes without the vectors.

Defined results: vectors that are null, zero, or hold a null or non-finite component, or
whose dimension is not that of most sampled rows, take no part; ties go to the smaller
id; a query with fewer candidates than k has as many rows; a row with the query's
own id is never its neighbour; candidates that repeat count each; an id that asks in
several rows asks once, with its least vector; no queries, no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.scratch import discard, keep

SAMPLE, BLOCK_QUERIES, SEED = 4096, 16_384, 11
#: Code bits a dimension; share of vectors whose distance may lie below its bound.
WIDEN, MISS = 4, 0.005
#: The first scan keeps so many times k estimates of each query, the k nearest of which bound the search.
ROUGH = 4
#: Epsilon where fewer than two rows are sampled; sampled rows that stand in as queries.
EPSILON, TRIALS = 4.0, 256
#: Queries whose estimates are made at once, pairs that are compared exactly at once.
STEP, PAIRS = 128, 1 << 14


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def rotation(dim: int, widen: int, seed: int) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix of widen times the dimension."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim * widen, dim * widen)))
    return (q * np.sign(np.diag(r)))[:dim]


def turned(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of the vectors less the centre, and these normed and turned."""
    off = x - centre
    norm = np.sqrt((off * off).sum(axis=1))
    return norm, (off / np.where(norm > 0, norm, 1.0)[:, None]) @ turn


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, norms, inner products with the own code."""
    norm, unit = turned(x, centre, turn)
    return np.packbits(unit >= 0, axis=1), norm, np.where(norm > 0, np.abs(unit).sum(axis=1) / np.sqrt(turn.shape[1]), 1.0)


def estimates(unit: np.ndarray, codes: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """Estimated inner products of turned queries with the vectors of the codes."""
    wide = unit.shape[1]
    bits = np.unpackbits(codes, axis=1, count=wide).astype(np.float32)
    return (2 * (unit.astype(np.float32) @ bits.T) - unit.sum(axis=1, keepdims=True)) / (np.sqrt(wide) * dot)


def deviation(dot: np.ndarray, wide: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1 - dot * dot) / (dot * dot) / max(1, wide - 1))


def calibrated(x: np.ndarray, centre: np.ndarray, turn: np.ndarray, miss: float) -> float:
    """The epsilon that so small a share of the sample's estimates falls short of."""
    codes, _, dot = encode(x, centre, turn)
    _, unit = turned(x, centre, turn)
    asked = unit[:: max(1, len(x) // TRIALS)]
    short = (asked @ unit.T - estimates(asked, codes, dot)) / np.maximum(1e-12, deviation(dot, turn.shape[1]))
    own = np.arange(len(x))[None, :] == np.arange(0, len(x), max(1, len(x) // TRIALS))[:, None]
    return float(np.quantile(short[~own], 1 - miss)) if len(x) > 1 else EPSILON


def index(vectors: DataFrame, id_col: str, vec_col: str, sample: int = SAMPLE, widen: int = WIDEN, seed: int = SEED, miss: float = MISS) -> tuple[DataFrame, np.ndarray, np.ndarray, float] | None:
    """Table (row, id, code, norm, dot, vec) of every usable row, centre, rotation and epsilon; None if no row is usable."""
    vec = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    first = [r[0] for r in rows.select("vec").limit(sample).collect()]
    if not first:
        return None
    dim = Counter(map(len, first)).most_common(1)[0][0]
    fit = np.array([v for v in first if len(v) == dim])
    centre, turn = np.mean(fit, axis=0), rotation(dim, widen, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten(), np.float64).reshape(-1, dim)
            code, norm, dot = encode(x, centre, turn)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(dot), pa.array([v.tobytes() for v in x], pa.binary())], ["row", "id", "code", "norm", "dot", "vec"])

    numbered = rows.where(F.size("vec") == dim).select(F.monotonically_increasing_id().alias("row"), "id", "vec")
    return keep(numbered.mapInArrow(coded, "row long, id long, code binary, norm double, dot double, vec binary"), "codes"), centre, turn, calibrated(fit, centre, turn, miss)


def _scanned(batches: Iterator[pa.RecordBatch], queries: tuple, turn: np.ndarray) -> Iterator[tuple]:
    """Of batches (row, id, code, norm, dot), for some queries at a time: their slice, rows, estimated squared distances (infinite for the own id) and what an error of one deviation adds to them."""
    ids, unit, norms = queries
    for r in batches:
        if not r.num_rows:
            continue
        codes = np.frombuffer(b"".join(r.column(2).to_pylist()), np.uint8).reshape(r.num_rows, -1)
        row, key, norm, dot = (np.asarray(r.column(i)) for i in (0, 1, 3, 4))
        error = deviation(dot, turn.shape[1])
        for a in range(0, len(ids), STEP):
            at = slice(a, min(len(ids), a + STEP))
            cross = 2 * norm * norms[at, None]
            guess = norm * norm + norms[at, None] ** 2 - cross * estimates(unit[at], codes, dot)
            guess[ids[at, None] == key[None, :]] = np.inf
            yield at, row, guess, cross * error


def _best(k: int, score: np.ndarray, item: np.ndarray, best: list) -> list:
    """The k least (score, item) of new ones and the best so far."""
    score, item = np.append(best[0], score), np.append(best[1], item)
    if len(score) > k:
        at = np.argpartition(score, k - 1)
        at = np.flatnonzero(score <= score[at[k - 1]])  # with ties
        score, item = score[at], item[at]
    first = np.lexsort((item, score))[:k]
    return [score[first], item[first]]


def _rough(queries, turn: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = queries.value[:3]
        best = [[np.empty(0), np.empty(0, np.int64)] for _ in shared[0]]
        for at, row, guess, _ in _scanned(batches, shared, turn):
            for q in range(at.start, at.stop):
                fine = np.flatnonzero(guess[q - at.start] < (best[q][0][-1] if len(best[q][0]) == k else np.inf))
                if len(fine):
                    best[q] = _best(k, guess[q - at.start][fine], row[fine], best[q])
        n = [len(b[0]) for b in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n)), pa.array(np.concatenate([b[1] for b in best])), pa.array(np.concatenate([b[0] for b in best]))], ["q", "row", "guess"])

    return run


def _near(queries, reach, turn: np.ndarray, epsilon: float):
    """(row, qs): the queries whose reach a vector's lower bound is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, most = queries.value[:3], reach.value
        for r in batches:
            found = []
            for at, row, guess, slack in _scanned(iter([r]), shared, turn):
                low = guess - epsilon * slack
                i, j = np.nonzero((low <= most[at, None] * (1 + 1e-6) + 1e-12) & (guess < np.inf))
                found.append((j, i + at.start))
            if found:
                j, q = (np.concatenate(x) for x in zip(*found))
                o = np.argsort(j, kind="stable")
                ends = np.append(0, np.cumsum(np.bincount(j, minlength=r.num_rows)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(q[o].astype(np.int32)))
                out = pa.RecordBatch.from_arrays([r.column(0), lists], ["row", "qs"])
                yield out.filter(pa.array(np.diff(ends) > 0))

    return run


def _exact(queries, k: int):
    """(q, id, score): of each task, the k nearest of each query among the rows (id, vec, qs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = queries.value[3]
        best: dict[int, list] = {}
        for r in batches:
            for a in range(0, r.num_rows, 256):
                part = r.slice(a, 256)
                if not part.num_rows:
                    continue
                x = np.frombuffer(b"".join(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1)
                qs, ids = np.asarray(part.column(2).flatten()), np.asarray(part.column(0))
                at = np.repeat(np.arange(part.num_rows), np.asarray(part.column(2).value_lengths()))
                score = np.empty(len(qs))
                for b in range(0, len(qs), PAIRS):
                    diff = x[at[b : b + PAIRS]] - vectors[qs[b : b + PAIRS]]
                    score[b : b + PAIRS] = np.sqrt((diff * diff).sum(axis=1))
                o = np.argsort(qs, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(qs[o]) != 0)) if len(o) else []
                for h, e in zip(heads, [*heads[1:], len(o)]):
                    q, own = int(qs[o[h]]), o[h:e]
                    best[q] = _best(k, score[own], ids[at[own]], best.get(q, [np.empty(0), np.empty(0, np.int64)]))
        if best:
            n = [len(b[0]) for b in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(best), np.int64), n)), pa.array(np.concatenate([b[1] for b in best.values()])), pa.array(np.concatenate([b[0] for b in best.values()]))], ["q", "id", "score"])

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, widen: int = WIDEN, seed: int = SEED, miss: float = MISS, block: int = BLOCK_QUERIES, stats: dict | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance); is_query: over the column id; stats gets the numbers of pairs and of pairs compared exactly."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    built = index(vectors, id_col, vec_col, sample, widen, seed, miss)
    if built is None:
        return spark.createDataFrame([], out_schema)
    table, centre, turn, epsilon = built
    codes, points = table.select("row", "id", "code", "norm", "dot"), table.select("row", "id", "vec")
    asked = keep(table.where(is_query).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    blocks = max(1, -(-asked.count() // block))
    by_query = Window.partitionBy("q")
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # a block's queries
        if not rows:
            continue
        ids, vecs = np.array([r[0] for r in rows], np.int64), np.array([np.frombuffer(r[1], np.float64) for r in rows])
        norm, unit = turned(vecs, centre, turn)
        shared = spark.sparkContext.broadcast((ids, unit.astype(np.float32), norm, vecs))
        found = codes.mapInArrow(_rough(shared, turn, ROUGH * k), "q long, row long, guess double").withColumn("r", F.row_number().over(by_query.orderBy("guess", "row"))).where(F.col("r") <= ROUGH * k)
        rough = points.join(found.select("row", F.array(F.col("q").cast("int")).alias("qs")), "row").select("id", "vec", "qs")
        nearest_k = rough.mapInArrow(_exact(shared, k), "q long, id long, score double").withColumn("r", F.row_number().over(by_query.orderBy("score", "id"))).where(F.col("r") <= k)
        bound = nearest_k.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("most")).where(F.col("n") >= k).collect()
        most = np.full(len(ids), np.inf)
        most[[r.q for r in bound]] = np.array([r.most for r in bound]) ** 2
        reach = spark.sparkContext.broadcast(most)
        near = keep(codes.mapInArrow(_near(shared, reach, turn, epsilon), "row long, qs array<int>"), "near")
        if stats is not None:
            stats["pairs"] = stats.get("pairs", 0) + len(ids) * table.count()
            stats["exact"] = stats.get("exact", 0) + near.agg(F.sum(F.size("qs"))).first()[0]
        met = points.join(near, "row").select("id", "vec", "qs").mapInArrow(_exact(shared, k), "q long, id long, score double")
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids}).to_pandas(), "q long, query_id long")
        ranked = met.withColumn("rank", F.row_number().over(by_query.orderBy("score", "id"))).where(F.col("rank") <= k)
        parts.append(keep(ranked.join(F.broadcast(names), "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "nearest"))
        discard(near)
    if not parts:
        return spark.createDataFrame([], out_schema)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
