"""Quality classifier by importance resampling with hashed n-gram models.

Each document is the set of its hashed word unigrams (letters only, A-Z lowered) and
hashed bigrams of word shapes (punctuation, capitals, repetition of the word before).
Two generative models count, for each bucket, the documents that have it: the target's,
over at most ``most_labelled`` labelled good rows, and the raw text's, over all
documents. A document's log ratio adds log(raw / target), smoothed and of either sign,
over all its buckets. Each is shrunk by the probability that the bucket tells good from
bad at all, from its counts among the labelled rows of both kinds (without bad ones:
among good rows and all others), as most buckets are rare and their ratios chance. A
document's own row counts in neither model. With the raw text as a mixture of target and
rest, the importance weight is 1 / (p + (1 - p) exp(ratio - offset)), bounded by 1 / p,
where the prior p and the offset come from the labelled rows. Documents are sampled
without replacement by the k largest ``sharpness * log weight`` plus Gumbel noise; k is
the expected number of target documents. The k-th key is found by counting keys in ever
narrower bins.

Defined results: null and empty texts have no n-grams, so ratio 0, and count as target;
without labelled good rows every ratio is 0 and all are kept; all are kept as well where
the ratios of good and bad rows differ no more than by chance; noise depends on seed and
id only, so rows that repeat share one key and keys equal to the k-th are all kept;
labels of absent documents are not used; the whole text counts, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm import hashing
from spanveil.llm.scratch import keep

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 19, 1 << 14
GOOD, BAD = 1, 2
#: Labelled good rows that the target model is fitted on, labelled bad rows that set the shrinking and the offset: at most so many each.
MOST_LABELLED = 40_000
#: Share of buckets taken to tell good from bad before their counts are seen, documents added to both sides of a ratio.
TELLING, ADDED = 0.01, 0.5
#: The labelled rows' ratios differ if their distributions lie apart by so many times sqrt(1 / good + 1 / bad): chance does it once in a hundred.
APART = 1.63
SHARPNESS, SEED = 16.0, 5
#: The k-th key is read off once so few keys are in its bin.
LAST_BIN, BINS = 4096, 1024

#: Values of letters and of bytes beyond ASCII by their place in a word; all else counts nothing.
LETTERS = hashing.Table(SEED, lower=True)
_other = [i for i in range(128) if not chr(i).isalpha()]
LETTERS.values.reshape(-1, 256)[:, _other] = 0
SIGN = np.zeros(256, np.uint64)
_signs = [i for i in range(33, 127) if not chr(i).isalnum()]
SIGN[_signs] = np.random.default_rng(SEED + 1).integers(1, 1 << 63, len(_signs), dtype=np.uint64)


#: Words whose features are made at once.
STEP_WORDS = 1 << 18


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket), each word's and each pair of shapes', a bounded number of words at a time; a pair may repeat."""
    starts, ends, first = hashing.spans(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    none = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.full(1, -1)
    word_before, shape_before, doc_before = none
    for a, b in hashing.runs(starts, ends, 8 * STEP_WORDS):
        s, e, own = starts[a:b], ends[a:b], doc[a:b]
        part = data[s[0] : e[-1]]
        s, e = s - s[0], e - s[0]
        words = hashing.word_hashes(part, s, e, LETTERS)
        signs, capitals = np.zeros(len(part) + 1, np.uint64), np.zeros(len(part) + 1, np.int32)
        np.cumsum(SIGN[part], out=signs[1:])
        np.cumsum((part >= 65) & (part <= 90), out=capitals[1:])
        same = own == np.append(doc_before, own[:-1])
        again = same & (words == np.append(word_before, words[:-1]))
        style = np.minimum(capitals[e] - capitals[s], 2).astype(np.uint64) * np.uint64(3) + again.astype(np.uint64)
        shapes = hashing.mix((signs[e] - signs[s]) * np.uint64(11) + style + np.uint64(1))
        pairs = shapes + np.where(same, np.append(shape_before, shapes[:-1]), np.uint64(0)) * np.uint64(31)
        word_before, shape_before, doc_before = words[-1:], shapes[-1:], own[-1:]
        buckets = np.concatenate([words % np.uint64(WORD_BUCKETS), np.uint64(WORD_BUCKETS) + hashing.mix(pairs) % np.uint64(SHAPE_BUCKETS)])
        yield np.concatenate([own, own]), buckets.astype(np.int64)


def present(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the buckets that each document has, once each."""
    n, found = WORD_BUCKETS + SHAPE_BUCKETS, np.empty(0, np.int64)
    for doc, bucket in features(data, off):
        new = np.unique(doc * n + bucket)
        found = np.union1d(found, new) if len(found) else new
    return found // n, found % n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: bucket, documents that have it, good and bad ones among them; bucket -1 counts documents. Batches: mark, text."""
    n = WORD_BUCKETS + SHAPE_BUCKETS
    sums, docs = np.zeros((3, n), np.int64), np.zeros(3, np.int64)
    for marks, data, off in hashing.chunks(batches):
        doc, bucket = present(data, off)
        sums[0] += np.bincount(bucket, minlength=n)
        docs[0] += len(marks)
        for mark in (GOOD, BAD):
            sums[mark] += np.bincount(bucket[marks[doc] == mark], minlength=n)
            docs[mark] += int((marks == mark).sum())
    at = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *(pa.array(np.append(c[at], d)) for c, d in zip(sums, docs, strict=True))], ["bucket", "raw", "good", "bad"])


IS_GOOD = "coalesce(quality = 1 and toxic = 0, false)"


def share_of_good(labels: DataFrame) -> float | None:
    """Good ones among all labelled ids, whatever their number; an id with good and bad rows is bad."""
    ids = labels.where("doc_id is not null").groupBy("doc_id").agg(F.expr(f"min(cast({IS_GOOD} as int))").alias("good"))
    return ids.agg(F.avg("good")).first()[0]


def labelled(labels: DataFrame, good: bool, most: int) -> DataFrame:
    """Ids of at most so many labelled rows, the same ones each time."""
    rows = labels.where(F.col("doc_id").isNotNull() & (F.expr(IS_GOOD) if good else ~F.expr(IS_GOOD))).select("doc_id").distinct()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    x = n + 1.0
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 16)))])
    return np.where(n < 16, small[np.minimum(n, 15).astype(np.int64)], (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3))


def telling(good: np.ndarray, rest: np.ndarray, share: float) -> np.ndarray:
    """Probability that a bucket's good and other rows are not split by chance, where share of all rows are good; the other split may be any."""
    chance = _log_factorial(good + rest) - _log_factorial(good) - _log_factorial(rest) + good * np.log(share) + rest * np.log1p(-share)
    other = -np.log(good + rest + 1)
    return 1 / (1 + (1 - TELLING) / TELLING * np.exp(np.minimum(500, chance - other)))


def model(counts: DataFrame) -> np.ndarray | None:
    """Shrunk log(raw / target) of each bucket, as documents without a mark, good and bad ones see it: without their own row."""
    n = WORD_BUCKETS + SHAPE_BUCKETS
    # at most n + 1 rows
    rows = counts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "good", "bad"))).toArrow()
    sums = np.zeros((3, n + 1))
    at = rows.column("bucket").to_numpy()
    for i, c in enumerate(("raw", "good", "bad")):
        sums[i, at] = rows.column(c).to_numpy()
    if not sums[GOOD, n]:
        return None
    out = np.zeros((3, n), np.float32)
    for mark in (0, GOOD, BAD):
        raw, good, bad = (np.maximum(0, sums[i] - (i in (0, mark))) for i in range(3))
        good, bad, rest = np.minimum(good, raw), np.minimum(bad, raw), bad if sums[BAD, n] else np.maximum(0, raw - good)
        if good[n] and rest[n]:
            expected = raw * (good[n] / raw[n])
            out[mark] = (telling(good, rest, good[n] / (good[n] + rest[n])) * np.log((expected + ADDED) / (good + ADDED)))[:n]
    return out


def ratios(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """id, ratio of documents (doc_id, mark, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            keys, at = batch.column(0), 0
            for marks, data, off in hashing.chunks(iter([batch.select(["mark", "text"])])):
                total = np.zeros(len(marks))
                if table is not None:
                    doc, bucket = present(data, off)
                    total = np.bincount(doc, weights=table[marks[doc], bucket], minlength=len(marks)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(marks)), pa.array(total)], ["id", "ratio"])
                at += len(marks)

    return docs.select("doc_id", "mark", "text").mapInArrow(scored, "id long, ratio double")


def best_offset(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The ratio above which documents count as rest: fewest good rows above and bad rows not above; None if chance sets the two apart."""
    if not len(good):
        return None
    if not len(bad):
        return float(good.max()) + 1
    edges = np.unique(np.concatenate([good, bad]))
    lost = len(good) - np.searchsorted(np.sort(good), edges, "right")
    kept = np.searchsorted(np.sort(bad), edges, "right")
    # no two samples are further apart than 1, so few rows that part wholly are taken as they are
    if np.max(1 - lost / len(good) - kept / len(bad)) < min(1 - 1e-9, APART * np.sqrt(1 / len(good) + 1 / len(bad))):
        return None
    i = len(edges) - 1 - int(np.argmin((lost + kept)[::-1]))
    return float((edges[i] + edges[min(i + 1, len(edges) - 1)]) / 2)


def kth_largest(keys: DataFrame, k: int) -> float | None:
    """The k-th largest value of the column key, by counting in bins; None if there are fewer."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k <= 0 or n < k:
        return None
    inside = n
    while inside > LAST_BIN and high > low:
        width = (high - low) / BINS
        at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / width))).alias("bin")
        bins = sorted(keys.where(F.col("key").between(low, high)).groupBy(at).agg(F.count("key"), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, c, a, b in bins:
            if k <= c:
                low, high, inside = a, b, c
                break
            k -= c
    rows = keys.where(F.col("key").between(low, high)).select("key").orderBy(F.desc("key")).limit(LAST_BIN).collect()
    return rows[min(k, len(rows)) - 1][0]


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """One row a document: id, log_ratio, weight, key, kept."""
    known = labels.withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = keep(labelled(known, True, most_labelled).withColumn("mark", F.lit(GOOD)).unionByName(labelled(known, False, most_labelled).withColumn("mark", F.lit(BAD))), "labelled")
    # an id with good and bad rows is bad; at most 2 * most_labelled ids, so this side may be broadcast
    marks = F.broadcast(marks.groupBy("doc_id").agg(F.max("mark").cast("long").alias("mark")))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = text.join(marks, "doc_id", "left").select("doc_id", F.coalesce("mark", F.lit(0)).cast("long").alias("mark"), "text")
    counts = keep(marked.select("mark", "text").mapInArrow(_counted, "bucket long, raw long, good long, bad long"), "ngram-counts")
    table = keep(ratios(marked, model(counts)), "log-ratios")
    # a row a labelled id, of repeated rows the largest ratio: at most 2 * most_labelled
    seen = table.join(marks.withColumnRenamed("doc_id", "id"), "id").groupBy("id", "mark").agg(F.max("ratio").alias("ratio")).select("mark", "ratio").toPandas()
    fit, rest = seen.ratio[seen.mark == GOOD].to_numpy(), seen.ratio[seen.mark == BAD].to_numpy()
    offset = best_offset(fit, rest)
    prior = min(0.999, max(0.001, share_of_good(known.join(text.select("doc_id"), "doc_id", "left_semi")))) if len(fit) else 0.999
    excess = F.lit(-500.0) if offset is None else F.least(F.lit(500.0), F.lit(sharpness) * (F.col("ratio") - offset))
    weight = 1 / (prior + (1 - prior) * F.exp(excess))
    noise = -F.log(-F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + 0.5) / float(1 << 53)))
    keyed = table.select("id", "ratio", weight.alias("weight"), (F.log(weight) + noise).alias("key"))
    expected = keyed.agg(F.sum(F.col("weight") * prior)).first()[0] or 0.0
    least = None if offset is None else kth_largest(keyed, round(expected))
    kept = F.lit(True) if least is None else F.col("key") >= least
    return keyed.select(F.col("id").alias(id_col), F.col("ratio").alias("log_ratio"), "weight", "key", kept.alias("kept"))
