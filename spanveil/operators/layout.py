"""Pages of OCR lines: reading order, offsets, boxes of spans, the export gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil import labels
from spanveil.config import EngineConfig
from spanveil.functions.text import let

# Advance widths of characters, against a small letter of middle width; capitals 1.3, others 1.
NARROW, SLIM, WIDE, WIDEST = "ilj|!.,;:'`", 'ftrI()[]{}/\\- "', "mw@", "MW"
CAPITAL = 1.30
SIDES = "struct<x0:double,y0:double,x1:double,y1:double>"


def bucket(y: Column) -> Column:
    """Rows of eight pixels, halves to even."""
    return F.bround(y / 8).cast("long") * 8


def reading_order(lines: DataFrame, by: list[str]) -> DataFrame:
    """Adds line_no from 0: by row of the first vertex, then its x, then the input order (columns y0, x0, line_idx)."""
    order = Window.partitionBy(*by).orderBy(bucket(F.col("y0")), "x0", "line_idx")
    return lines.withColumn("line_no", F.row_number().over(order) - 1)


def with_offsets(lines: DataFrame, by: list[str], order: str = "line_no", text: str = "txt") -> DataFrame:
    """Adds char_start and char_end in the page text, the non-empty lines joined by a line break; empty lines go."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0)).cast("int")
    return lines.where(F.length(text) > 0).withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length(text))


def page_text(lines: DataFrame, by: list[str], order: str = "line_no", text: str = "txt") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n").alias("text"))


def tsv_lines(words: DataFrame, by: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Lines from recognised words (by, such as file and page; level, block, par, line, left, top, width, height, conf, text, row): level 5 only, blanks dropped, words by left; in order of first appearance; keep: columns of block, par and line to carry along."""
    used = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    word = F.struct("left", "row", F.trim("text").alias("text"), "top", "width", "height")
    lines = used.groupBy(*by, "block", "par", "line").agg(
        F.array_sort(F.collect_list(word)).alias("ws"), F.min("row").alias("line_idx"), F.min("left").cast("double").alias("x0"), F.min("top").cast("double").alias("y0"),
        F.max(F.col("left") + F.col("width")).cast("double").alias("x1"), F.max(F.col("top") + F.col("height")).cast("double").alias("y1"), F.avg(F.greatest("conf", F.lit(0)) / 100).alias("confidence"),
    )
    words_ = F.aggregate(
        "ws",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,x0:double,x1:double>>").alias("out")),
        lambda acc, w: F.struct(
            (acc["at"] + F.length(w["text"]) + 1).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + F.length(w["text"])).cast("int").alias("b"), w["left"].cast("double").alias("x0"), (w["left"] + w["width"]).cast("double").alias("x1")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return lines.select(*by, *keep, "line_idx", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("txt"), "x0", "y0", "x1", "y1", "confidence", words_.alias("words"))


def text_width(text: Column) -> Column:
    """Sum of advance widths."""
    known = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    n = [known(c) for c in (NARROW, SLIM, WIDE, WIDEST)]
    others = F.translate(text, NARROW + SLIM + WIDE + WIDEST, "")
    capitals = F.length(F.regexp_replace(others, r"\P{Lu}", ""))
    return n[0] * 0.40 + n[1] * 0.60 + n[2] * 1.65 + n[3] * 1.80 + capitals * CAPITAL + (F.length(others) - capitals) * 1.0


def line_box(line: Column, start: Column, end: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Sides of the part of a level line (txt, x0, y0, x1, y1, char_start, char_end, words) that a span covers, with the padding; null if none.

    With word boxes whole words are covered; else the place goes by advance widths.
    """
    a = F.greatest(F.lit(0), start - line["char_start"])
    b = F.least(line["char_end"] - line["char_start"], end - line["char_start"])
    tall = (line["y1"] - line["y0"]) * config.bbox_pad_lines
    sides = lambda x0, x1: F.struct(x0.alias("x0"), (line["y0"] - tall).alias("y0"), x1.alias("x1"), (line["y1"] + tall).alias("y1")).cast(SIDES)

    def by_words(hit: Column) -> Column:
        x0, x1 = F.array_min(F.transform(hit, lambda w: w["x0"])), F.array_max(F.transform(hit, lambda w: w["x1"]))
        chars = F.greatest(F.lit(1), F.aggregate(hit, F.lit(0), lambda n, w: n + w["b"] - w["a"]))
        pad = (x1 - x0) * config.bbox_pad_chars / chars
        return F.when(F.size(hit) > 0, sides(x0 - pad, x1 + pad))

    def by_width(w: Column) -> Column:
        pad = F.lit(config.bbox_pad_chars) / F.greatest(F.lit(1), F.length(line["txt"]))
        at = lambda t: line["x0"] + (line["x1"] - line["x0"]) * t
        return sides(at(F.greatest(F.lit(0.0), w["a"] / w["all"] - pad)), at(F.least(F.lit(1.0), w["b"] / w["all"] + pad)))

    hit = F.filter(F.coalesce(line["words"], F.array().cast("array<struct<a:int,b:int,x0:double,x1:double>>")), lambda w: (w["b"] > a) & (w["a"] < b))
    widths = F.struct(text_width(F.substring(line["txt"], F.lit(1), a)).alias("a"), text_width(F.substring(line["txt"], F.lit(1), b)).alias("b"), F.greatest(F.lit(0.4), text_width(line["txt"])).alias("all"))
    return F.when(b > a, F.coalesce(let(hit, by_words), let(widths, by_width)))


def span_boxes(spans: DataFrame, lines: DataFrame, by: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Each span with the boxes of all lines that it touches; unmapped where there are none, and never dropped."""
    keys = [F.col(f"s.{c}") == F.col(f"l.{c}") for c in by]
    touch = (F.col("l.char_end") > F.col("s.start")) & (F.col("l.char_start") < F.col("s.end"))
    cond = touch
    for k in keys:
        cond = k & cond
    line = F.struct(*[F.col(f"l.{c}") for c in ("txt", "x0", "y0", "x1", "y1", "char_start", "char_end", "words")])
    met = spans.alias("s").join(lines.alias("l"), cond, "left")
    boxed = met.select(*[F.col(f"s.{c}") for c in by], "s.start", "s.end", "s.label", F.col("l.char_start").alias("at"), F.when(F.col("l.txt").isNotNull(), line_box(line, F.col("s.start"), F.col("s.end"), config)).alias("box"))
    boxes = F.transform(F.array_sort(F.collect_list(F.when(F.col("box").isNotNull(), F.struct("at", "box")))), lambda b: b["box"])
    out = boxed.groupBy(*by, "start", "end", "label").agg(boxes.alias("boxes"))
    return out.withColumn("unmapped", F.size("boxes") == 0).withColumn("redacted", labels.placeholder(F.col("label")))


def export_gate(entities: DataFrame, doc: str) -> DataFrame:
    """Per document: entities, unmapped ones, and whether it may be exported."""
    return entities.groupBy(doc).agg(F.count(F.lit(1)).alias("entities"), F.count_if("unmapped").alias("unmapped")).withColumn("exportable", F.col("unmapped") == 0)


def outward(box: Column, width: Column, height: Column) -> Column:
    """Whole pixels that cover the box, inside the image."""
    clip = lambda v, most: F.greatest(F.lit(0), F.least(most, v)).cast("int")
    return F.struct(
        clip(F.floor(box["x0"]), width).alias("x0"), clip(F.floor(box["y0"]), height).alias("y0"), clip(F.ceil(box["x1"]), width).alias("x1"), clip(F.ceil(box["y1"]), height).alias("y1")
    )


def rotate(box: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """The upright box around a box turned about a point."""
    r = F.radians(degrees)
    corners = F.array(*[F.struct(box[x].alias("x"), box[y].alias("y")) for x in ("x0", "x1") for y in ("y0", "y1")])
    xs = F.transform(corners, lambda c: (c["x"] - cx) * F.cos(r) - (c["y"] - cy) * F.sin(r) + cx)
    ys = F.transform(corners, lambda c: (c["x"] - cx) * F.sin(r) + (c["y"] - cy) * F.cos(r) + cy)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def overlap_area(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")


def visual_order(entities: DataFrame, by: list[str]) -> DataFrame:
    """Adds rank: unmapped last, then rows of six pixels, then x. A pairwise rule with that tolerance has no total order; rows are the documented stand-in."""
    order = Window.partitionBy(*by).orderBy("unmapped", F.floor(F.col("y0") / 6), "x0", "start")
    return entities.withColumn("rank", F.row_number().over(order))


def quality_gate(pages: DataFrame, lines: DataFrame, by: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """Per page (width, height): characters, weighted confidence, least side, and the reasons to refuse it."""
    seen = F.length(F.regexp_replace("txt", r"(?U)\s", ""))
    sums = lines.groupBy(*by).agg(F.sum(seen).alias("chars"), F.sum(F.col("confidence") * F.length("txt")).alias("weighted"), F.sum(F.length("txt")).alias("all"))
    out = pages.join(sums, by, "left").withColumn("chars", F.coalesce("chars", F.lit(0))).withColumn("confidence", F.round(F.when(F.col("all") > 0, F.col("weighted") / F.col("all")).otherwise(0.0), 2))
    out = out.withColumn("min_side", F.least("width", "height"))
    reasons = F.filter(
        F.array(
            F.when(F.col("min_side") < config.min_side, "small"),
            F.when(F.col("chars") < config.min_chars, "little_text").when(F.col("confidence") < config.min_confidence, "low_confidence"),
        ),
        lambda r: r.isNotNull(),
    )
    return out.select(*by, "chars", "confidence", "min_side", reasons.alias("reasons"))


QUAD = "array<struct<x:double,y:double>>"
#: Fixed value: least side of a box that a user draws.
LEAST_SIDE = 8


def line_quad(line: Column, start: Column, end: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Corners (top left, top right, bottom right, bottom left) of the part of a line (txt, quad, char_start, char_end) that a span covers; the padding goes along the line's own edges, so turned lines stay covered. Null if none."""
    a = F.greatest(F.lit(0), start - line["char_start"])
    b = F.least(line["char_end"] - line["char_start"], end - line["char_start"])
    n = F.greatest(F.lit(1), line["char_end"] - line["char_start"])
    fits = F.length(line["txt"]) == n
    width = lambda at: F.when(fits, text_width(F.substring(line["txt"], F.lit(1), at))).otherwise(at.cast("double"))
    all_ = F.when(fits, F.greatest(F.lit(0.4), text_width(line["txt"]))).otherwise(n.cast("double"))
    pad = F.lit(config.bbox_pad_chars) * F.when(fits, all_ / n).otherwise(1.0) / all_
    ends = F.struct(F.greatest(F.lit(0.0), width(a) / all_ - pad).alias("a"), F.least(F.lit(1.0), width(b) / all_ + pad).alias("b"))
    corner = lambda i: F.element_at(line["quad"], i)

    def corners(t: Column) -> Column:
        def point(at: Column, base: bool) -> Column:
            along = lambda p, q, c: corner(p)[c] + (corner(q)[c] - corner(p)[c]) * at
            top, bottom = (lambda c: along(1, 2, c)), (lambda c: along(4, 3, c))
            own, other = (bottom, top) if base else (top, bottom)
            return F.struct(*[(own(c) + (own(c) - other(c)) * config.bbox_pad_lines).alias(c) for c in ("x", "y")])

        return F.array(point(t["a"], False), point(t["b"], False), point(t["b"], True), point(t["a"], True)).cast(QUAD)

    return F.when(b > a, let(ends, corners))


def upright(quad: Column, tolerance: float = 0.5) -> Column:
    """Sides of a box whose corners stand level and plumb within the tolerance, else null."""
    p = [F.element_at(quad, i) for i in range(1, 5)]
    near = lambda i, j, c: F.abs(p[i][c] - p[j][c]) <= tolerance
    x, y = F.least(p[0]["x"], p[3]["x"]), F.least(p[0]["y"], p[1]["y"])
    right, low = F.greatest(p[1]["x"], p[2]["x"]), F.greatest(p[2]["y"], p[3]["y"])
    fine = near(0, 1, "y") & near(2, 3, "y") & near(0, 3, "x") & near(1, 2, "x") & (right > x) & (low > y)
    return F.when(fine, F.struct(x.alias("x0"), y.alias("y0"), right.alias("x1"), low.alias("y1")).cast(SIDES))


def drawn_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """The box between two points that a user drew, inside the image; null if a side is below the least."""
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v.cast("double")))
    xs, ys = (clip(x1, width), clip(x2, width)), (clip(y1, height), clip(y2, height))
    sides = F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1")).cast(SIDES)
    return F.when((F.abs(x1 - x2) >= LEAST_SIDE) & (F.abs(y1 - y2) >= LEAST_SIDE), sides)


def any_line_gate(pages: DataFrame, lines: DataFrame, by: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """by, accepted: a page is refused if it has no line or any line is below the confidence."""
    weak = lines.groupBy(*by).agg(F.max(F.col("confidence") < config.min_confidence).alias("weak"))
    return pages.select(*by).join(weak, by, "left").select(*by, F.coalesce(~F.col("weak"), F.lit(False)).alias("accepted"))


def display_groups(entities: DataFrame, by: list[str]) -> DataFrame:
    """Mapped entities by upper-case label with their numbers (column index), groups by falling size: by, label, n, indices, rank."""
    mapped = entities.where(~F.col("unmapped"))
    out = mapped.groupBy(*by, F.upper("label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("index")).alias("indices"))
    # of equal groups the one with the earlier first entity stands first
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.element_at("indices", 1))
    return out.withColumn("rank", F.row_number().over(order))


def blocks(lines: DataFrame, by: list[str]) -> DataFrame:
    """What a response shows of each line: text, its corners and confidence."""
    quad = F.col("quad") if "quad" in lines.columns else F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    return lines.select(*by, "line_no", F.col("txt").alias("text"), quad.cast(QUAD).alias("bbox"), "confidence", "char_start", "char_end")
