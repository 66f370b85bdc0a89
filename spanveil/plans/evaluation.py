"""The evaluator as one plan: gold pages in, outcomes, false positives, recall, report and baseline out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.config import EngineConfig
from spanveil.operators import evaluate
from spanveil.plans.pipeline import detect

PAGE = ["doc_id", "page_index"]


@dataclass(frozen=True)
class TextLevel:
    outcomes: DataFrame
    false: DataFrame

    @property
    def recall(self) -> DataFrame:
        return evaluate.recall(self.outcomes)

    @property
    def false_by_label(self) -> DataFrame:
        return evaluate.false_by_label(self.false)


def gold_spans(pages: DataFrame, optional: bool) -> DataFrame:
    """Rows of the gold spans of pages (doc_id, page_index, page); optional ones too if asked for."""
    spans = F.concat("page.spans", F.coalesce("page.optional_spans", F.slice("page.spans", 1, 0))) if optional else F.col("page.spans")
    return pages.select(*PAGE, F.explode(spans).alias("s")).select(*PAGE, "s.id", "s.label", "s.group", "s.text", F.col("s.char_start").alias("gs"), F.col("s.char_end").alias("ge"), "s.min_coverage", F.coalesce("s.difficulty", F.lit("normal")).alias("difficulty"))


def text_level(pages: DataFrame, config: EngineConfig = EngineConfig(), spans: DataFrame | None = None) -> TextLevel:
    """Detection on the gold texts themselves; spans (doc_id, page_index, start, end, label) take the place of the rules' if given."""
    if spans is None:
        found = detect(pages.select(*PAGE, F.col("page.canonical_text").alias("text")).repartition(*PAGE), config=config)
        spans = found.select(*PAGE, F.inline_outer("spans")).where(F.col("start").isNotNull()).select(*PAGE, "start", "end", "label")
    gold = gold_spans(pages, False)
    judged = evaluate.span_outcomes(gold.select(*PAGE, "id", "label", "group", "gs", "ge", "min_coverage"), spans, PAGE)
    more = gold.select(*PAGE, "id", "text", "difficulty")
    key = F.concat("doc_id", F.lit("#p"), F.col("page_index").cast("string"), F.lit("#"), "id")
    outcomes = judged.join(more, [*PAGE, "id"]).withColumn("key", key).withColumn("cause", F.when(F.col("outcome") == "miss", "model_miss").otherwise(""))
    text = pages.select(*PAGE, F.col("page.canonical_text").alias("_text"))
    false = evaluate.false_positives(gold_spans(pages, True), spans, PAGE).join(text, PAGE)
    return TextLevel(outcomes, false.withColumn("text", F.substring(F.substring("_text", F.col("start") + 1, F.col("end") - F.col("start")), 1, 40)).drop("_text"))


def report(level: TextLevel, baseline: DataFrame | None = None) -> DataFrame:
    """section, place, line: misses first, then recall by label with the total, false positives by label, and what changed against a baseline (key, outcome)."""
    pad = lambda c, n: F.rpad(F.col(c).cast("string"), n, " ")
    misses = level.outcomes.where("outcome = 'miss'")
    hard = F.when(F.col("difficulty") == "hard", "  (hard)").otherwise("")
    missed = misses.select(F.lit(1).alias("section"), F.struct(F.lit(0).alias("n"), F.concat("doc_id", F.lit(" "), "key").alias("k")).alias("place"), F.concat(F.lit("["), "doc_id", F.lit("] "), "id", F.lit(" "), pad("label", 13), F.lit(" "), F.substring("text", 1, 38), F.format_string("  cov=%.2f  cause=%s", F.col("covered"), F.col("cause")), hard).alias("line"))
    last = (F.col("label") == "TOTAL").cast("int")
    numbers = F.format_string("%5d%5d%7d%6d%9.2f%11.2f", *[F.col(c) for c in ("gold", "hit", "hit_mislabel", "miss", "recall_label", "recall_covered")])
    recall = level.recall.select(F.lit(2).alias("section"), F.struct((last * 1_000_000_000 - F.col("miss").cast("int") * (1 - last)).alias("n"), F.col("label").alias("k")).alias("place"), F.concat(pad("label", 15), numbers).alias("line"))
    false = level.false_by_label.select(F.lit(3).alias("section"), F.struct((-F.col("n")).cast("int").alias("n"), F.col("label").alias("k")).alias("place"), F.concat(F.lit("  "), "label", F.lit(": "), F.col("n").cast("string")).alias("line"))
    out = missed.unionByName(recall).unionByName(false)
    if baseline is not None:
        changed = evaluate.delta(baseline, level.outcomes.select("key", "outcome"))
        rank = F.when(F.col("change") == "regression", 0).otherwise(1)
        out = out.unionByName(changed.select(F.lit(4).alias("section"), F.struct(rank.alias("n"), F.col("key").alias("k")).alias("place"), F.concat("change", F.lit(" "), "key").alias("line")))
    return out.orderBy("section", "place")


def exit_status(level: TextLevel, baseline: DataFrame | None) -> int:
    """1 if a span that the baseline covers is missed now."""
    if baseline is None:
        return 0
    return int(evaluate.delta(baseline, level.outcomes.select("key", "outcome")).where("change = 'regression'").limit(1).count() > 0)
