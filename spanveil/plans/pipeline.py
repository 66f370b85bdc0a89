"""The ordered composition of the detection operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil import labels
from spanveil.config import EngineConfig
from spanveil.functions.text import alnum_count, cut, digit_count, let, matches
from spanveil.operators import names, numeric, rules, seams, snap, spans
from spanveil.plans.chunking import chunks
from spanveil.schemas import SPAN, SPANS


def normal_model_spans(raw: Column, floor: float) -> Column:
    """A model's output (entity_group, score, start, end, chunk_offset) as spans: labels remapped, what is dropped or below the floor gone."""
    group = F.upper(raw["entity_group"])
    bare = F.when(F.substring(group, 2, 1) == "-", F.substring(group, F.lit(3), F.length(group))).otherwise(group)
    label = labels.remap(bare)
    at = F.coalesce(raw["chunk_offset"], F.lit(0))
    score = F.coalesce(raw["score"], F.lit(1.0))
    good = group.isNotNull() & (bare != "") & ~F.startswith(group, F.lit("LABEL_")) & (label != "DROP") & (raw["end"] > raw["start"]) & (score >= floor)
    made = F.struct(
        (raw["start"] + at).cast("int").alias("start"), (raw["end"] + at).cast("int").alias("end"), label.alias("label"), raw["word"].alias("txt"), score.cast("double").alias("score"),
        F.lit("model").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong"),
    )
    return F.when(F.coalesce(good, F.lit(False)), made.cast(SPAN))


def mock_spans(text: Column) -> Column:
    """Stand-in for a model: capitalised names after a field word, and the rest of the line after an address word."""
    low, up = "a-záéíóúâêôãõç", "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
    name = rf"(?U)((?:Paciente|Medico|Dr\.?|Dra\.?)[:\s]+)((?:[{up}][{low}]+\s?){{2,5}})"
    return F.concat(_mocked(text, "PERSON", 0.95, name), _mocked(text, "ADDRESS", 0.93, r"(?iuU)(Endereco[:\s]+)([^\n]+)"))


def _mocked(text: Column, label: str, score: float, pattern: str) -> Column:
    """Spans of the pattern's second group, without white space around it."""
    groups = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "lead"), (2, "value"))])
    rows = F.zip_with(matches(text, pattern), groups, lambda m, x: F.struct((m["start"] + F.length(x["lead"])).alias("a"), F.regexp_replace(x["value"], r"(?U)^\s+|\s+$", "").alias("v")))
    made = lambda r: F.struct(
        r["a"].cast("int").alias("start"), (r["a"] + F.length(r["v"])).cast("int").alias("end"), F.lit(label).alias("label"), r["v"].alias("txt"), F.lit(score).alias("score"),
        F.lit("mock").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong"),
    ).cast(SPAN)
    return F.transform(rows, made)


def survivor(text: Column, e: Column, threshold: Column) -> Column:
    """The span if it is validated, a rule's, strong or scored enough; a weak number goes to the classifier; else null."""
    kept = e["validated"] | e["origin"].isin("regex", "mock", "numeric") | e["strong"] | (e["score"] >= threshold)
    numbers, all_ = digit_count(e["txt"]), alnum_count(e["txt"])
    return F.when(kept, e).when((numbers >= 4) & (numbers / F.greatest(all_, F.lit(1)) >= 0.6), numeric.classify(text, e))


def present(xs: Column) -> Column:
    return F.filter(xs, lambda e: e.isNotNull())


@lru_cache(maxsize=64)
def _steps(text_col: str, model_col: str | None, config: EngineConfig, gateway: int) -> list[tuple[str, Column]]:
    """The columns of detect, one after the other. They name columns and are bound to no table, so a session builds them once; gateway: of the session."""
    text, step = F.coalesce(F.col(text_col), F.lit("")), F.col("_spans")
    threshold = F.lit(config.threshold)
    found = F.concat(rules.scan(text), names.labelled_names(text))
    blank = F.regexp_like(text, F.lit(r"(?U)^\s*$"))
    if config.mode == "mock":
        source = mock_spans(text)
    elif model_col is not None:
        source = F.coalesce(F.col(model_col), F.array().cast(SPANS))
    else:
        source = None
    out = []
    if source is not None:
        out.append(("_model", F.transform(F.filter(source, lambda e: e["end"] > e["start"]), lambda e: snap.snap(text, e))))
        found = F.concat(F.col("_model"), found)
    out.append(("_spans", F.when(blank, F.array().cast(SPANS)).otherwise(found)))
    out.append(("_spans", spans.reslice(text, step)))
    out.append(("_spans", spans.dedup(step)))
    out.append(("_spans", present(F.transform(step, spans.promote))))
    if source is not None:
        out.append(("_spans", present(F.transform(step, lambda e: F.when(e["label"] == "NUM_CANDIDATE", numeric.classify(text, e)).otherwise(e)))))
    out.append(("_spans", spans.merge(text, step)))
    if source is not None:
        out.append(("_spans", present(F.transform(step, lambda e: survivor(text, e, threshold)))))
    out.append(("_spans", F.transform(step, lambda e: names.expand(text, e))))
    out.append(("_spans", spans.finalize(text, step)))
    return out


def detect(df: DataFrame, text_col: str = "text", model_col: str | None = None, out: str = "spans", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds the disjoint spans of each text; model_col: an array of spans from another source. The order of the steps matters: the threshold comes after the merge."""
    for name, column in _steps(text_col, model_col, config, id(df.sparkSession.sparkContext._gateway)):
        df = df.withColumn(name, column)
    return df.withColumnRenamed("_spans", out).drop("_model")


def model_spans(texts: DataFrame, key: str, model: Callable[[DataFrame], DataFrame], config: EngineConfig = EngineConfig(), text: str = "text") -> DataFrame:
    """key, e, part: a model's spans over the chunks of each text, and its second look at lines in capitals that no name touches.

    model: takes (key, chunk), gives (key, entity_group, score, start, end) with offsets in
    the chunk; a row of chunks has a key of its own.
    """
    piece = F.inline(chunks(F.coalesce(F.col(text), F.lit("")), config.model_chunk_chars))
    pieces = texts.select(key, piece).select(F.struct(F.col(key), "start").alias("at"), "chunk")
    raw = model(pieces)
    entity = lambda offset: F.struct("entity_group", "score", "start", "end", F.lit("").alias("word"), offset.alias("chunk_offset"))
    seen = raw.select(F.col(f"at.{key}").alias(key), normal_model_spans(entity(F.col("at.start")), config.model_floor).alias("e")).where("e is not null").withColumn("part", F.lit(0))
    if not config.caps_retry:
        return seen
    names_found = seen.select(key, "e.start", "e.end", "e.label")
    probe = seams.caps_probe(texts, names_found, key, text)
    joined = probe.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "probe"))), lambda p: p["probe"]), "\n").alias("chunk"))
    again = model(joined.select(F.struct(F.col(key), F.lit(0).alias("start")).alias("at"), "chunk"))
    again = again.select(F.col(f"at.{key}").alias(key), normal_model_spans(entity(F.lit(0)), config.model_floor).alias("e")).where(F.col("e").isNotNull() & F.upper("e.label").isin(*seams.NAMES))
    back = seams.caps_back(again.select(key, "e.*"), probe, key)
    return seen.unionByName(back.select(key, F.struct(*[f for f in _fields(SPAN)]).cast(SPAN).alias("e")).withColumn("part", F.lit(1)))


def _fields(kind: str) -> list[str]:
    return [f.split(":")[0] for f in kind.removeprefix("struct<").removesuffix(">").split(",")]


def detect_with(texts: DataFrame, key: str, model: Callable[[DataFrame], DataFrame] | None = None, suggestions: DataFrame | None = None, text: str = "text", out: str = "spans", config: EngineConfig = EngineConfig()) -> DataFrame:
    """Adds the spans of each text (with a key of its own) from the rules, a model and located suggestions (key, value, label)."""
    sources = []
    if model is not None:
        sources.append(model_spans(texts, key, model, config, text))
    if suggestions is not None:
        found = seams.suggested(texts, suggestions, key, text).where("located")
        e = F.struct("start", "end", "label", F.lit("").alias("txt"), "score", "origin", F.lit(False).alias("validated"), F.lit(False).alias("strong")).cast(SPAN)
        sources.append(found.select(key, e.alias("e"), F.lit(2).alias("part")))
    if not sources:
        return detect(texts, text, out=out, config=config)
    every = reduce(DataFrame.unionByName, sources)
    arrays = every.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "e"))), lambda x: x["e"]).alias("_found"))
    return detect(texts.join(arrays, key, "left"), text, model_col="_found", out=out, config=config).drop("_found")


def redact(text: Column, found: Column) -> Column:
    """The text with a placeholder for each of its disjoint spans, which come in order."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["out"], cut(text, acc["at"], e["start"]), labels.placeholder(e["label"])).alias("out"))
    return F.aggregate(found, state, step, lambda acc: F.concat(acc["out"], cut(text, acc["at"], F.length(text))))


def by_label(found: Column) -> Column:
    """Counts of the labels as a map."""
    count = lambda xs, n: F.size(F.filter(xs, lambda e: e["label"] == n)).cast("long")
    counted = lambda xs: let(F.array_distinct(F.transform(xs, lambda e: e["label"])), lambda names_: F.map_from_arrays(names_, F.transform(names_, lambda n: count(xs, n))))
    return let(found, counted)
