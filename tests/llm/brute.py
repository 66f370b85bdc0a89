"""Plain versions of operators, one document and one bucket at a time."""

import math

import numpy as np
from pyspark.sql import functions as F

from spanveil.llm import importance


def telling(good, rest, share):
    chance = math.lgamma(good + rest + 1) - math.lgamma(good + 1) - math.lgamma(rest + 1) + good * math.log(share) + rest * math.log(1 - share)
    odds = (1 - importance.TELLING) / importance.TELLING * math.exp(min(500, chance + math.log(good + rest + 1)))
    return 1 / (1 + odds)


def resampled(spark, rows, labels, sharpness=importance.SHARPNESS, seed=importance.SEED):
    """[(id, ratio, weight, key, least key that is kept)] of documents (id, text) and labels (id, quality, toxic)."""
    buckets = {}
    for i, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        buckets[i] = set(importance.present(raw, np.array([0, len(raw)]))[1].tolist())
    judged = {}
    for i, quality, toxic in labels:
        if i is not None:
            judged.setdefault(i, []).append(quality == 1 and toxic == 0)
    judged = {i: all(v) for i, v in judged.items()}
    mark = {i: judged.get(i) for i in buckets}
    count = {kind: {} for kind in ("raw", True, False)}
    total = {"raw": len(rows), True: sum(v is True for v in mark.values()), False: sum(v is False for v in mark.values())}
    for i, own in buckets.items():
        for kind in ("raw", mark[i]) if mark[i] is not None else ("raw",):
            for b in own:
                count[kind][b] = count[kind].get(b, 0) + 1
    ratio = {}
    for i, own in buckets.items():
        less = {"raw": 1, True: int(mark[i] is True), False: int(mark[i] is False)}
        n = {k: total[k] - less[k] for k in total}
        ratio[i] = 0.0
        for b in own if n[True] and n[False] else ():
            c = {k: max(0, count[k].get(b, 0) - less[k]) for k in count}
            expected = c["raw"] * n[True] / n["raw"]
            ratio[i] += telling(c[True], c[False], n[True] / (n[True] + n[False])) * math.log((expected + importance.ADDED) / (c[True] + importance.ADDED))
    good, bad = ([ratio[i] for i in ratio if mark[i] is kind] for kind in (True, False))
    edges = sorted(set(good + bad))
    wrong = {e: (sum(g > e for g in good), sum(b <= e for b in bad)) for e in edges}
    apart = max(1 - lost / len(good) - kept / len(bad) for lost, kept in wrong.values())
    if apart < min(1 - 1e-9, importance.APART * math.sqrt(1 / len(good) + 1 / len(bad))):
        return [(i, ratio[i], None, None, None) for i, _ in rows]
    least = min(sum(w) for w in wrong.values())
    at = max(e for e in edges if sum(wrong[e]) == least)
    offset = (at + min((e for e in edges if e > at), default=at)) / 2
    prior = min(0.999, max(0.001, sum(judged[i] for i in judged if i in buckets) / sum(i in buckets for i in judged)))
    weight = {i: 1 / (prior + (1 - prior) * math.exp(min(500, sharpness * (ratio[i] - offset)))) for i in ratio}
    ids = spark.createDataFrame([(i,) for i in buckets], "id long").select("id", F.xxhash64(F.lit(seed), "id").alias("h")).collect()
    noise = {r.id: -math.log(-math.log((((r.h & ((1 << 64) - 1)) >> 11) + 0.5) / (1 << 53))) for r in ids}
    key = {i: math.log(weight[i]) + noise[i] for i in ratio}
    k = round(sum(weight[i] * prior for i, _ in rows))
    kth = sorted((key[i] for i, _ in rows), reverse=True)[k - 1]
    return [(i, ratio[i], weight[i], key[i], kth) for i, _ in rows]
