"""Recall of predicted spans against gold spans, and regressions against a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.text import digits, fold, let

# Coverage that a gold span needs, for numbers and for the rest, the label's share, what a region needs, what a false positive may overlap.
NUMERIC_COVERAGE, TEXT_COVERAGE, LABEL_COVERAGE, REGION_COVERAGE, REGION_SEEN, FALSE_SHARE = 0.85, 0.6, 0.5, 0.8, 0.3, 0.3
# Gold labels that are numbers.
NUMERIC_GOLD = (
    "CPF", "RG", "CNS", "CNES", "CARTEIRINHA", "PRONTUARIO", "ATENDIMENTO", "GUIA_NUM", "SENHA_AUT", "PHONE", "CEP", "CRM", "COREN", "RQE", "NUMERO", "CNPJ",
)
# The groups of gold labels that a predicted label may stand for.
LABEL_GROUPS = {
    "PERSON": ("NAME",), "PATIENT": ("NAME",), "PATIENT_NAME": ("NAME",), "DOCTOR": ("NAME",), "DOCTOR_NAME": ("NAME",), "PROFESSIONAL": ("NAME",),
    "BR_CPF": ("DOC_NUM",), "CPF": ("DOC_NUM",), "BR_RG": ("DOC_NUM",), "RG": ("DOC_NUM",), "BR_DOC": ("DOC_NUM", "ORG"), "ID": ("DOC_NUM",),
    "MEDICAL_RECORD": ("DOC_NUM",), "MEDICAL_RECORD_NUMBER": ("DOC_NUM",), "MRN": ("DOC_NUM",), "CRM": ("DOC_NUM",), "COREN": ("DOC_NUM",), "RQE": ("DOC_NUM",),
    "CNS": ("DOC_NUM",), "CNES": ("DOC_NUM",), "TISS_GUIDE": ("DOC_NUM",), "TISS_AUTH": ("DOC_NUM",), "INSURANCE_ID": ("DOC_NUM",), "NUMERO": ("DOC_NUM",),
    "BR_CNPJ": ("ORG", "DOC_NUM"), "CNPJ": ("ORG", "DOC_NUM"), "INSTITUTION": ("ORG",), "HOSPITAL": ("ORG",), "ORGANIZATION": ("ORG",),
    "PHONE": ("CONTACT",), "PHONE_NUMBER": ("CONTACT",), "EMAIL": ("CONTACT",),
    "ADDRESS": ("LOCATION",), "STREET_ADDRESS": ("LOCATION",), "CITY": ("LOCATION",), "STATE": ("LOCATION",), "ZIP": ("LOCATION",), "ZIPCODE": ("LOCATION",), "POSTAL_CODE": ("LOCATION",),
    "DATE": ("DATE",), "DATE_OF_BIRTH": ("DATE",), "DOB": ("DATE",), "AGE": ("AGE",),
}


def in_group(label: Column, group: Column) -> Column:
    """Whether a predicted label may stand for a group of gold labels."""
    groups = F.create_map(*[x for k, v in LABEL_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(groups, F.upper(label)), group), F.lit(False))


def coverage(pairs: DataFrame, by: list[str], same: Column | None = None) -> DataFrame:
    """Share of each gold span (gs, ge; by names it) that the union of its predictions (ps, pe, null without one) covers; with same, own is that of the predictions for which it holds."""
    given = F.col("ps").isNotNull() & F.col("pe").isNotNull()
    # greatest and least pass over nulls, so a gold span without a prediction is kept apart
    lo, hi = F.when(given, F.greatest("gs", "ps")), F.when(given, F.least("ge", "pe"))
    clipped = pairs.withColumn("lo", lo).withColumn("hi", F.when(hi > lo, hi))
    past = Window.partitionBy(*by, "gs", "ge").orderBy(F.col("lo").asc_nulls_last(), "hi").rowsBetween(Window.unboundedPreceding, -1)

    def part(upto: Column) -> Column:
        reach = F.max(upto).over(past)
        return F.coalesce(F.greatest(F.lit(0), upto - F.greatest("lo", F.coalesce(reach, F.col("lo")))), F.lit(0))

    parts = {"part": part(F.col("hi"))} | ({} if same is None else {"own": part(F.when(same, F.col("hi")))})
    length = F.col("ge") - F.col("gs")
    share = lambda c: F.when(length > 0, F.sum(c) / length).otherwise(0.0)
    names = {"part": "coverage", "own": "own"}
    return clipped.withColumns(parts).groupBy(*by, "gs", "ge").agg(*[share(c).alias(names[c]) for c in parts])


def required(label: Column, minimum: Column) -> Column:
    return F.coalesce(minimum, F.when(label.isin(*NUMERIC_GOLD), NUMERIC_COVERAGE).otherwise(TEXT_COVERAGE))


def outcome(covered: Column, by_label: Column, need: Column) -> Column:
    return F.when(covered < need, "miss").when(by_label >= LABEL_COVERAGE, "hit").otherwise("hit_mislabel")


def _pairs(spans: DataFrame, others: DataFrame, page: list[str]) -> DataFrame:
    """Spans (gs, ge) with the others (ps, pe) on their page that they overlap, or none."""
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in page]
    cond = (F.col("ps") < F.col("ge")) & (F.col("pe") > F.col("gs"))
    for c in same:
        cond = c & cond
    rest = [c for c in others.columns if c not in page]
    return spans.alias("a").join(others.alias("b"), cond, "left").select("a.*", *[F.col(f"b.{c}") for c in rest])


def span_outcomes(gold: DataFrame, predicted: DataFrame, page: list[str]) -> DataFrame:
    """Per gold span (page, id, label, group, gs, ge, min_coverage): covered by any label, covered_label by labels of its group, and the outcome. predicted: page, start, end, label."""
    p = predicted.select(*page, F.col("start").alias("ps"), F.col("end").alias("pe"), F.col("label").alias("plabel"))
    keys = [*page, "id", "label", "group", "min_coverage"]
    out = coverage(_pairs(gold, p, page), keys, in_group(F.col("plabel"), F.col("group"))).withColumnsRenamed({"coverage": "covered", "own": "covered_label"})
    return out.withColumn("outcome", outcome(F.col("covered"), F.col("covered_label"), required(F.col("label"), F.col("min_coverage"))))


def false_positives(gold: DataFrame, predicted: DataFrame, page: list[str]) -> DataFrame:
    """Predictions (page, start, end, label) of which less than three tenths lie on gold or optional spans (page, gs, ge)."""
    g = gold.select(*page, F.col("gs").alias("ps"), F.col("ge").alias("pe"))
    p = predicted.select(*page, "label", F.col("start").alias("gs"), F.col("end").alias("ge"))
    out = coverage(_pairs(p, g, page), [*page, "label"])
    return out.where(F.col("coverage") < FALSE_SHARE).select(*page, "label", F.col("gs").alias("start"), F.col("ge").alias("end"), "coverage")


def false_by_label(false: DataFrame) -> DataFrame:
    """Counts of false positives by label, most first."""
    return false.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def recall(outcomes: DataFrame) -> DataFrame:
    """Counts and recalls by label, most misses first, and the total at the end."""
    n = F.count(F.lit(1))
    hit, mis = F.count_if(F.col("outcome") == "hit"), F.count_if(F.col("outcome") == "hit_mislabel")
    counts = [
        n.alias("gold"), hit.alias("hit"), mis.alias("hit_mislabel"), F.count_if(F.col("outcome") == "miss").alias("miss"), F.round(hit / n, 4).alias("recall_label"), F.round((hit + mis) / n, 4).alias("recall_covered"),
    ]
    total = F.grouping("label").alias("total")
    rolled = outcomes.rollup("label").agg(*counts, total)
    ordered = rolled.orderBy("total", F.desc("miss"), "label")
    return ordered.withColumn("label", F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("label"))).drop("total")


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose outcome changed between covered and missed: regression or fixed. Keys of one side only are ignored."""
    both = old.select("key", F.col("outcome").alias("old")).join(new.select("key", F.col("outcome").alias("new")), "key")
    change = F.when((F.col("old") != "miss") & (F.col("new") == "miss"), "regression").when((F.col("old") == "miss") & (F.col("new") != "miss"), "fixed")
    return both.withColumn("change", change).where("change is not null")


def fuzzy_contains(text: Column, value: Column) -> Column:
    """Numbers of six digits or more: the text's digits hold them with one changed at most; else the folded value is in the folded text."""

    def near(d: Column) -> Column:
        n = F.length(d["v"])
        misses = lambda i: F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, j: a + (F.substring(d["v"], j, F.lit(1)) != F.substring(d["t"], i + j, F.lit(1))).cast("int"))
        spots = F.sequence(F.lit(0), F.length(d["t"]) - n)
        return F.when(n >= 6, F.when(F.length(d["t"]) >= n, F.exists(spots, lambda i: misses(i) <= 1)).otherwise(False)).otherwise(F.contains(squeezed(text), squeezed(value)))

    squeezed = lambda c: F.regexp_replace(fold(c), r"(?U)\s+", " ")
    return let(F.struct(digits(value).alias("v"), digits(text).alias("t")), near)


def miss_cause(in_ocr: Column, detected: Column, mapped: Column, region: Column) -> Column:
    """Why a span was missed on the image."""
    return F.when(region, "detector_absent").when(~in_ocr, "ocr_lost").when(~detected, "model_miss").when(~mapped, "mapping_loss")


def rect_coverage(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Share of each gold rectangle (gx0, gy0, gx1, gy1; by names it) under the union of its upright boxes (x0, y0, x1, y1, null without one).

    Exact on areas, where a raster would count pixels: the rectangle is cut into columns at
    the boxes' sides, and in each column the covered heights are joined.
    """
    clip = lambda lo, hi, a, b: (F.greatest(F.col(lo), F.col(a)), F.least(F.col(hi), F.col(b)))
    (x0, x1), (y0, y1) = clip("x0", "x1", "gx0", "gx1"), clip("y0", "y1", "gy0", "gy1")
    given = F.col("x0").isNotNull() & (x1 > x0) & (y1 > y0)
    box = F.when(given, F.struct(y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1")))
    frames = boxes.withColumn("box", box).groupBy(*by, "gx0", "gy0", "gx1", "gy1").agg(F.array_sort(F.collect_list("box")).alias("bs"))
    cuts = F.array_sort(F.array_distinct(F.flatten(F.transform("bs", lambda b: F.array(b["x0"], b["x1"])))))

    def tall(xs: Column, ys: Column) -> Column:
        inside = F.filter(ys, lambda b: (b["x0"] <= xs["a"]) & (b["x1"] >= xs["b"]))
        start = F.struct(F.lit(float("-inf")).alias("upto"), F.lit(0.0).alias("sum"))
        step = lambda acc, b: F.struct(F.greatest(acc["upto"], b["y1"]).alias("upto"), (acc["sum"] + F.greatest(F.lit(0.0), b["y1"] - F.greatest(acc["upto"], b["y0"]))).alias("sum"))
        return F.aggregate(inside, start, step, lambda acc: acc["sum"])

    strips = lambda d: F.zip_with(F.slice(d["cuts"], 1, F.size(d["cuts"]) - 1), F.slice(d["cuts"], 2, F.size(d["cuts"]) - 1), lambda p, q: F.struct(p.alias("a"), q.alias("b")))
    covered = lambda d: F.aggregate(F.transform(strips(d), lambda x: (x["b"] - x["a"]) * tall(x, d["bs"])), F.lit(0.0), lambda t, v: t + v)
    area = (F.col("gx1") - F.col("gx0")) * (F.col("gy1") - F.col("gy0"))
    share = F.when((area > 0) & (F.size("bs") > 0), let(F.struct(cuts.alias("cuts"), F.col("bs").alias("bs")), covered) / area).otherwise(0.0)
    return frames.withColumn("coverage", share).drop("bs")


def region_outcomes(covered: DataFrame) -> DataFrame:
    """Adds outcome and cause to gold regions with expect and coverage."""
    need = F.when(F.col("expect") == "redact", REGION_COVERAGE).otherwise(REGION_SEEN)
    hit = F.col("coverage") >= need
    return covered.withColumn("outcome", F.when(hit, "hit").otherwise("miss")).withColumn("cause", F.when(hit, "").otherwise("detector_absent"))
