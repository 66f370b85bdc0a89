"""Training-corpus pipeline: quality, exact dedup, near-duplicate dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and
reads all that the stage before it kept. All stages but the last return these columns.
Rows with a null id stay together as one id; of rows that share an id, a stage keeps all
or none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import content_sort, importance, mixing, packing, parity_join
from spanveil.llm.queries import table, tokenizer_path
from spanveil.llm.scratch import keep, mark, release


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is among ids (a column __kept_id), null among nulls."""
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards the labelled good ones keeps."""
    judged = importance.resample(docs, table(spark, sf_dir, "labels"))
    return _only(docs, judged.where("kept").select(F.col("doc_id").alias("__kept_id")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, A-Z lowered, the one with the smallest id."""
    groups = content_sort.exact_groups(docs, retain="smallest")
    return _only(docs, groups.where("kept").select(F.col("doc_id").alias("__kept_id")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles, similarity 0.8 or more, connect, the one with the smallest id."""
    groups = parity_join.join_components(docs, width=5, percent=80)
    return _only(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_id")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's words near its target; a document that is taken twice is two rows."""
    return mixing.apply_mix(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; kept, as batches of ten thousand whole texts take too much of an executor's memory."""
    return keep(packing.pack(docs, tokenizer_path(), end_id=2), "packed").withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixed", mixed), ("packed", packed)]

#: The first, third and last stage have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, start, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
