"""What goes out: responses, summaries, baselines, blacked-out rasters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages with fewer characters than this are warned of.
LITTLE_TEXT = 20
#: Parts of file names that hint at made-up documents.
SYNTHETIC = ("sample", "synthetic", "laudo_us_obstetrico", "ficha_admissao", "prescricao_medica")


def response(pages: DataFrame, entities: DataFrame, key: str, reveal: bool = False) -> DataFrame:
    """key, json: pages (key, page_index, width, height, text, redacted) with their entities (start, end, label, boxes, unmapped, redacted); the text itself only with reveal."""
    entity = F.struct("start", "end", "label", "redacted", "boxes", "unmapped")
    grouped = entities.groupBy(key, "page_index").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    none = F.array().cast(grouped.schema["entities"].dataType)
    page = F.struct("page_index", "width", "height", F.coalesce("entities", none).alias("entities"), F.col("redacted").alias("deidentified_text"), (F.col("text") if reveal else F.lit(None).cast("string")).alias("original_text"))
    docs = pages.join(grouped, [key, "page_index"], "left").groupBy(key).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    counts = entities.groupBy(key, "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("unmapped").alias("u")).groupBy(key).agg(
        F.sum("n").alias("total"), F.sum("u").alias("unmapped"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("by_label")
    )
    stats = F.struct(F.coalesce("total", F.lit(0)).alias("total_entities"), F.col("by_label"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))
    return docs.join(counts, key, "left").select(key, F.to_json(F.struct("pages", F.size("pages").alias("page_count"), stats.alias("stats"))).alias("json"))


def summary(pages: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """key, pages, covered, by_placeholder, warnings: counts only, no value of a person. pages: key, page_index, chars."""
    per = pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), F.array_sort(F.collect_list(F.when(F.col("chars") < LITTLE_TEXT, F.col("page_index") + 1))).alias("little")
    )
    kinds = entities.groupBy(key, "redacted").agg(F.count(F.lit(1)).alias("n")).groupBy(key).agg(F.sum("n").alias("covered"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("redacted", "n")))).alias("by_placeholder"))
    covered = F.coalesce("covered", F.lit(0))
    little = F.when(F.col("pages") > 1, F.transform("little", lambda p: F.concat(F.lit("little text on page "), p.cast("string")))).otherwise(F.array().cast("array<string>"))
    return per.join(kinds, key, "left").select(key, "pages", covered.alias("covered"), "by_placeholder", F.concat(little, F.when(covered == 0, F.array(F.lit("nothing found"))).otherwise(F.array().cast("array<string>"))).alias("warnings"))


def baseline(outcomes: DataFrame, false_positives: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """One row: outcomes by key, and the metrics. A baseline is as small as its gold corpus."""
    n, covered = F.count(F.lit(1)), F.count_if(F.col("outcome") != "miss")
    sums = outcomes.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "outcome")))).alias("outcomes"), n.alias("gold"), F.round(F.count_if(F.col("outcome") == "hit") / n, 4).alias("recall_label"), F.round(covered / n, 4).alias("recall_covered"),
        (n - covered).alias("fn"),
    )
    out = sums.crossJoin(false_positives.agg(F.count(F.lit(1)).alias("fp")))  # one row each
    if regions is None:
        return out.withColumn("region_miss", F.lit(0).cast("long"))
    return out.crossJoin(regions.agg(F.count_if(F.col("outcome") == "miss").alias("region_miss")))


def read_baseline(df: DataFrame) -> DataFrame:
    """key, outcome of a baseline's map."""
    return df.select(F.explode("outcomes").alias("key", "outcome"))


def load_baseline(spark: SparkSession, path: str, corpus_hash: str) -> tuple[DataFrame, str | None]:
    """(key, outcome) of a baseline file, and a warning if it was made on another corpus; it is compared all the same."""
    found = spark.read.schema("outcomes map<string,string>, corpus_hash string").json(path, multiLine=True)
    made_on = found.first().corpus_hash
    return read_baseline(found), f"the baseline was made on another corpus ({made_on})" if made_on not in (None, corpus_hash) else None


def region_overlap(boxes: Column, gold: Column) -> Column:
    """Share of the boxes' common frame inside gold rectangles, whose overlaps count twice, at most 1; 1 without boxes."""
    frame = F.struct(
        F.array_min(F.transform(boxes, lambda b: b["x0"])).alias("x0"), F.array_min(F.transform(boxes, lambda b: b["y0"])).alias("y0"), F.array_max(F.transform(boxes, lambda b: b["x1"])).alias("x1"), F.array_max(F.transform(boxes, lambda b: b["y1"])).alias("y1")
    )
    side = lambda a, b, lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    inter = F.aggregate(gold, F.lit(0.0), lambda t, g: t + side(frame, g, "x0", "x1") * side(frame, g, "y0", "y1"))
    area = F.greatest(F.lit(1.0), (frame["x1"] - frame["x0"]) * (frame["y1"] - frame["y0"]))
    return F.when(F.size(boxes) == 0, 1.0).otherwise(F.least(F.lit(1.0), inter / area))


def looks_synthetic(name: Column) -> Column:
    low = F.lower(name)
    return F.greatest(*[F.contains(low, F.lit(h)) for h in SYNTHETIC])


def token_windows(starts: Column, ends: Column, width: int = 1024, overlap: int = 128) -> Column:
    """Character windows (start, end) over token offsets: width tokens each, overlapping, the last as soon as the tokens are covered."""
    n, stride = F.size(starts), width - overlap
    count = F.when(n <= width, F.lit(1)).otherwise(F.ceil((n - width) / stride).cast("int") + 1)
    at = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * stride)
    return F.when(n > 0, F.transform(at, lambda i: F.struct(F.element_at(starts, i + 1).alias("start"), F.element_at(ends, F.least(n, i + width)).alias("end"))))


def burn(pages: DataFrame) -> DataFrame:
    """Raw rasters (key, width, height, raster of 3 bytes a pixel, boxes of whole pixels x0 y0 x1 y1) with their boxes black; nothing but pixels goes out."""

    def black(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, raster, boxes in zip(pdf.width, pdf.height, pdf.raster, pdf.boxes):
                a = np.frombuffer(raster, np.uint8).reshape(h, w, 3).copy()
                for b in boxes:
                    x0, y0, x1, y1 = (b[k] for k in ("x0", "y0", "x1", "y1"))
                    a[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = 0
                out.append(a.tobytes())
            yield pdf.assign(raster=out).drop(columns="boxes")

    rest = [f for f in pages.schema if f.name != "boxes"]
    return pages.mapInPandas(black, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest))
