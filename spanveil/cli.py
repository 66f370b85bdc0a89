"""Command lines: ``python -m spanveil.cli batch|evaluate``, also through spark-submit.

batch: redacts all text and word-processor files below a folder into numbered parts;
documents that the ledger in the output folder has done with the same content are
skipped, all others are recorded, failures too. Status 0: nothing is pending, 1: some
file failed or has a suffix that is not read, 2: wrong arguments.

evaluate: the rules on a gold corpus, as a report. Status 1: a span that the baseline
covers is missed, 2: no gold document.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.config import EngineConfig
from spanveil.operators import outputs, rules
from spanveil.plans import batch, evaluation
from spanveil.sources import readers

LEAST_PART = 1000
LEDGER = "doc_key string, unit int, sha256 string, status string, signature string"


def _units(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_key, unit, sha256 (of the file), text, error of the units of files (doc_key, relpath, sha256, content)."""
    suffix = F.lower(F.regexp_extract("relpath", r"\.([^./]*)$", 1))
    plain = files.where(suffix == "txt").select("doc_key", F.lit(0).alias("unit"), "sha256", F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("text"), F.lit(None).cast("string").alias("error"))
    word = readers.docx_units(files.where(suffix == "docx")).join(files.select("relpath", "doc_key", "sha256"), "relpath").select("doc_key", "unit", "sha256", "text", "error")
    other = files.where(~suffix.isin("txt", "docx")).select("doc_key", F.lit(0).alias("unit"), "sha256", F.lit(None).cast("string").alias("text"), F.lit("NotReadHere").alias("error"))
    return reduce(DataFrame.unionByName, (plain, word, other))


def run_batch(spark: SparkSession, source: str, target: str, config: EngineConfig) -> int:
    contents = readers.binary_files(spark, source, "")
    files = batch.inventory(contents)
    sign = batch.signature(config, rules_hash(), "")
    path = f"{target}/ledger"
    done = spark.read.schema(LEDGER).parquet(path) if _exists(spark, path) else spark.createDataFrame([], LEDGER)
    todo = batch.pending(files.withColumn("unit", F.lit(0)).drop("n_bytes"), done, sign).join(contents, "relpath")
    units = _units(spark, todo.select("doc_key", "relpath", "sha256", "content")).cache()
    good = units.where("error is null").select(F.struct("doc_key", "unit").alias("at"), "text")
    parts = batch.numbered_parts(batch.redact_long(good, "at", config=config), "at", config.part_chars, "redacted")
    parts.select("at.*", "part", "name", "part_text", "sha256", "chars").write.mode("append").parquet(f"{target}/parts")
    status = F.when(F.max(F.col("error").isNotNull().cast("int")) == 1, F.max("error")).otherwise("done")
    # the ledger comes last: what it calls done is written
    units.groupBy("doc_key", "sha256").agg(status.alias("status")).select("doc_key", F.lit(0).alias("unit"), "sha256", "status", F.lit(sign).alias("signature")).write.mode("append").parquet(path)
    units.unpersist()
    finished = spark.read.schema(LEDGER).parquet(path).where("status = 'done'")
    return int(files.join(finished, ["doc_key", "sha256"], "left_anti").limit(1).count() > 0)


def rules_hash() -> str:
    import hashlib

    return hashlib.sha256(repr([(r.label, r.pattern, r.priority, r.score) for r in rules.RULES]).encode()).hexdigest()


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def run_evaluation(spark: SparkSession, corpus: str, baseline: str | None, save: str | None, config: EngineConfig) -> int:
    pages = readers.gold(spark, corpus).cache()
    if not pages.limit(1).count():
        return 2
    level = evaluation.text_level(pages, config)
    digest = readers.corpus_hash(readers.binary_files(spark, corpus)).first()[0]
    old, warning = outputs.load_baseline(spark, baseline, digest) if baseline and _exists(spark, baseline) else (None, None)
    if warning:
        print(warning, file=sys.stderr)
    for row in evaluation.report(level, old).toLocalIterator():
        print(row.line)
    if save:
        new = outputs.baseline(level.outcomes.select("key", "outcome"), level.false)
        new.withColumns({"level": F.lit("text"), "corpus_hash": F.lit(digest)}).coalesce(1).write.mode("overwrite").json(save)
    return evaluation.exit_status(level, old)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanveil")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("batch")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--part-chars", type=int, default=EngineConfig.part_chars)
    e = commands.add_parser("evaluate")
    e.add_argument("--corpus", required=True)
    e.add_argument("--baseline")
    e.add_argument("--save-baseline")
    e.add_argument("--threshold", type=float, default=EngineConfig.threshold)
    args = parser.parse_args(argv)
    if args.command == "batch" and (args.part_chars < LEAST_PART or args.output.rstrip("/").startswith(args.input.rstrip("/"))):
        print(f"parts have {LEAST_PART} characters at least, and the output lies outside the input", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("spanveil").getOrCreate()
    if args.command == "batch":
        return run_batch(spark, args.input, args.output, EngineConfig(part_chars=args.part_chars))
    return run_evaluation(spark, args.corpus, args.baseline, args.save_baseline, EngineConfig(threshold=args.threshold))


if __name__ == "__main__":
    sys.exit(main())
