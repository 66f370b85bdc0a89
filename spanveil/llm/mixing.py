"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Sizes are words. The targets share the whole size by weight, none above ``most_repeats``
times its source's size (water filling: sources sorted by cap over weight, the first
level that does not exceed its own cap holds for all that follow). Blocks of
``block_words`` words, one unless asked otherwise, are seats: sources get them by highest
quotients of their targets, then each source's hash shards by highest quotients of their
sizes. The quotient of the last seat is searched for, so that a few quotients a party are
ranked, however many seats there are. In each shard the documents lie in a
seeded order and the shard's quota is taken from that line, going around it again up to
``most_repeats`` times; so a document is taken whole as many times as the line is gone
around, and once more, or in part, if it lies in the last round's blocks. A source has a
shard for every ``shard_words`` words, so one huge source is many small windows.

Defined results: a null text has size 0 and is taken 0; the null source is a source of
its own, last in the order; with no words at all every target is 0; rows that repeat
count each; reruns agree, as the order depends on seed and id only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.scratch import keep as write_once

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_WORDS = 1, 1 << 19
#: Rounds of the search for the last seat's quotient, and values that are tried in each.
ROUNDS, TRIED = 4, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], most_repeats: int) -> DataFrame:
    """(source, source_size) -> and target, total: one row a source, so windows over all of them are small."""
    every = Window.partitionBy()
    ranked = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most_repeats)).withColumn("total", F.sum("source_size").over(every))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        capped.withColumn("below", F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("n"), F.col("level")))).over(every)["level"])
    )
    return levels.select("source", "source_size", "total", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: Sequence[str], votes: str, seats: str, order: Sequence[str]) -> DataFrame:
    """Adds quota: of each group's seats (the same on all its rows), those with the highest quotients votes / (2 k + 1); ties by order.

    A party has floor((votes / q + 1) / 2) quotients of at least q. q is narrowed from both
    sides to where as many stand as there are seats; the quotients between the two bounds,
    and one more on each side against rounding, are ranked.
    """
    whole = Window.partitionBy(*group)
    v = F.col(votes).cast("double")
    above = lambda q: F.when(v > 0, F.floor((v / q + 1) / 2)).otherwise(0).cast("long")
    sums = parties.withColumn("_v", F.sum(v).over(whole)).withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_top", F.max(v).over(whole))
    open_ = (F.col("_v") > 0) & (F.col(seats) > 0)
    # every party's number of quotients differs from votes / (2 q) by half a seat at most
    low = F.when(open_, F.col("_v") / (2 * F.col(seats) + F.col("_n")))
    sharp = F.when(2 * F.col(seats) > F.col("_n"), F.col("_v") / (2 * F.col(seats) - F.col("_n")))
    found = sums.withColumn("_low", low).withColumn("_high", F.when(open_, F.least(F.col("_top") * 1.001, F.coalesce(sharp, F.col("_top") * 1.001)) * 1.000001))
    for _ in range(ROUNDS):
        tried = [F.col("_low") * F.pow(F.col("_high") / F.col("_low"), F.lit(j / TRIED)) for j in range(1, TRIED)]
        counted = found.withColumn("_q", F.array(*tried)).withColumn("_c", F.array(*[F.sum(above(q)).over(whole) for q in tried]))
        pairs = F.arrays_zip("_q", "_c")
        enough, few = F.filter(pairs, lambda p: p["_c"] >= F.col(seats)), F.filter(pairs, lambda p: p["_c"] < F.col(seats))
        found = counted.withColumn("_l", F.coalesce(F.array_max(F.transform(enough, lambda p: p["_q"])), "_low")).withColumn("_high", F.coalesce(F.array_min(F.transform(few, lambda p: p["_q"])), "_high")).withColumn("_low", F.col("_l")).drop("_l", "_q", "_c")
    found = found.withColumn("_sure", F.when(open_, F.greatest(F.lit(0), above(F.col("_high")) - 1)).otherwise(0).cast("long")).withColumn("_most", F.when(open_, above(F.col("_low")) + 1).otherwise(0).cast("long"))
    found = found.withColumn("_left", F.when(open_, F.col(seats) - F.sum("_sure").over(whole)).otherwise(0))
    by_quotient = whole.orderBy(F.desc("_q"), *order)
    seated = found.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most")))).withColumn("_q", F.when(v > 0, v / (2 * F.col("_k") + 1)).otherwise(0.0))
    won = seated.withColumn("_won", (F.row_number().over(by_quotient) <= F.col("_left")).cast("long"))
    return won.groupBy(*parties.columns).agg((F.max("_sure") + F.sum("_won")).alias("quota"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most_repeats: int = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = write_once(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("h")), "mix-sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats)
    sources = sources.withColumn("block", F.lit(block_words).cast("long")).withColumn("seats", F.floor(F.col("total") / F.col("block") + 0.5).cast("long")).withColumn("shards", F.ceil(F.col("source_size") / shard_words).cast("long")).withColumn("all", F.lit(1))
    sources = write_once(sainte_lague(sources, ["all"], "target", "seats", ["source"]).drop("all", "seats", "total"), "mix-sources")
    at = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.greatest(F.lit(1), F.col("shards")))
    by_source = sources.withColumnRenamed("source", "s")
    placed = sized.join(by_source, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("shard", at)
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("line"), F.first("quota").alias("seats"), F.first("block").alias("block"))
    shards = sainte_lague(shards, ["source"], "line", "seats", ["shard"])
    shards = shards.select(F.col("source").alias("s"), F.col("shard").alias("sh"), "line", F.least(F.col("quota") * F.col("block"), F.col("line") * most_repeats).alias("words"))
    before = Window.partitionBy("source", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    lines = placed.withColumn("off", F.coalesce(F.sum("size").over(before), F.lit(0)))
    met = lines.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("sh")))
    rounds, last = F.floor(F.col("words") / F.greatest("line", F.lit(1))), F.col("words") % F.greatest("line", F.lit(1))
    part = F.greatest(F.lit(0), F.least(F.col("size"), last - F.col("off")))
    return met.select(F.col("id").alias(id_col), F.col("source"), "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents as the mix takes them: a row for each whole time, and one with the first words for the rest.

    Columns are those of docs; chars_col, if it is there, is the length of the text that is taken.
    """
    own = "__mix_id", "__mix_size", "__mix_taken", "__mix_of", "__mix_words"  # apart from any column of docs
    key, size, taken, of, words = own
    takes = mixed.where("taken > 0").groupBy(F.col(id_col).alias(key), F.col("size").alias(size)).agg(F.max("taken").alias(taken))
    met = docs.withColumn(of, word_count(F.col(text_col))).join(takes, F.col(id_col).eqNullSafe(F.col(key)) & (F.col(of) == F.col(size)))
    times, rest = F.floor(F.col(taken) / F.col(of)).cast("int"), (F.col(taken) % F.col(of)).cast("int")
    rounds = F.concat(F.array_repeat(F.lit(0), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = met.withColumn(words, F.explode(rounds))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col(words)), " ")
    out = out.withColumn(text_col, F.when(F.col(words) > 0, part).otherwise(F.col(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return out.select(*docs.columns)
