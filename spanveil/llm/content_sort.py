"""Exact dedup by content sort (DataFrame operations only).

The rows are sorted by their normalised text: first by its first characters, among equal
ones by a 64-bit hash of the whole text, then by the text itself, last by id. Sampled
splitters over the short keys range-partition the rows, so the sample on the driver is
small whatever the texts' lengths; all rows of a text fall into one partition, which is
sorted externally, and the window operator compares each row's full text with its
neighbour's to find the runs of equal texts. Only where one text has more rows than a
partition should hold, so that a splitter would repeat, its rows are dealt by id to several
runs, next to each other in the order; there are no more such texts than partitions. The
first rows of their runs, a bounded number, are then compared in full, and equal ones are
one group.

Defined results: a null text counts as empty; equal means identical after lower-casing
A-Z only; a group of one is kept; rows with equal ids and equal texts form one group in
which each of the rows with the kept id is marked kept; a null id never is the kept one
unless all of its group are null; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.scratch import keep as write_once
from spanveil.llm.scratch import shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a text that splitters see.
HEAD = 64


def sorted_runs(docs: DataFrame, id_col: str, text_col: str, best, falling: bool) -> DataFrame:
    """One row a document: id, hash, run (0 unless its text is split), run_keep, run_size, sha, and norm for the first row of a run of a split text."""
    partitions = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    most = max(1, -(-docs.count() // partitions))
    # at most as many as there are partitions
    split = write_once(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("hash", F.ceil(F.col("c") / most).cast("int").alias("runs")), "split-texts")
    dealt = rows.join(F.broadcast(split), "hash", "left").withColumn("head", F.substring("norm", 1, HEAD)).withColumn("run", F.coalesce(F.pmod(F.xxhash64("id"), F.col("runs")), F.lit(0)).cast("int"))
    ranged = dealt.select("id", "head", "hash", "run", "norm", F.col("runs").isNotNull().alias("split")).repartitionByRange("head", "hash", "run")
    equal = Window.partitionBy("head", "hash", "run", "norm")
    first = F.row_number().over(equal.orderBy(F.col("id").desc() if falling else F.col("id").asc())) == 1
    runs = ranged.withColumn("run_keep", best("id").over(equal)).withColumn("run_size", F.count(F.lit(1)).over(equal)).withColumn("first", first)
    return runs.select("id", "hash", "run", "run_keep", "run_size", F.sha2("norm", 256).alias("sha"), F.when(F.col("split") & F.col("first"), F.col("norm")).alias("norm"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", retain: str = "smallest") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256; retain: smallest or largest id of a group."""
    best = {"smallest": F.min, "largest": F.max}[retain]
    table = write_once(sorted_runs(docs, id_col, text_col, best, retain == "largest"), "content-sort")
    # a row a run of the split texts
    heads = table.where("norm is not null")
    whole = heads.groupBy("norm").agg(best("run_keep").alias("keep_id"), F.sum("run_size").alias("group_size"))
    merged = F.broadcast(write_once(heads.join(whole, "norm").select("hash", "run", "sha", "keep_id", "group_size"), "split-groups"))
    out = table.select("id", "hash", "run", "sha", "run_keep", "run_size").join(merged, ["hash", "run", "sha"], "left")
    keep_id = F.coalesce("keep_id", "run_keep")
    return out.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("group_size", "run_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))
