"""Where a model, a second look at capitals, or a language model's suggestions come in, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil import labels
from spanveil.functions.text import caps_line

NAMES = ("PERSON", "PATIENT", "PATIENT_NAME", "DOCTOR", "DOCTOR_NAME")
SUGGESTION_SCORE, SHORTEST, LONGEST = 0.9, 2, 200


def text_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, line, line_start, line_end of every line of each text."""
    parts = texts.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    return parts.withColumn("line_start", start).withColumn("line_end", F.col("line_start") + F.length("line"))


def title(line: Column) -> Column:
    """Each run of letters with a capital first; the length stays. Differs from initcap, which starts words at white space only."""
    letters = F.split(F.lower(line), "")
    step = lambda acc, c: F.struct(F.regexp_like(c, F.lit(r"\p{L}")).alias("in"), F.concat(acc["out"], F.when(acc["in"], c).otherwise(F.upper(c))).alias("out"))
    return F.aggregate(letters, F.struct(F.lit(False).alias("in"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def caps_probe(texts: DataFrame, found: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines in capitals that no name span (key, start, end, label) touches, in title case, with their offset in the probe of the text."""
    lines = text_lines(texts, key, text).where(caps_line(F.col("line")))
    names = found.where(F.upper("label").isin(*NAMES)).select(F.col(key).alias("_k"), "start", "end")
    free = lines.join(names, (F.col(key) == F.col("_k")) & (F.col("start") < F.col("line_end")) & (F.col("end") > F.col("line_start")), "left_anti")
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return free.withColumn("probe_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")).withColumn("probe", title(F.col("line")))


def caps_back(results: DataFrame, probe: DataFrame, key: str) -> DataFrame:
    """Spans of the probe (key, start, end) in the text's offsets: each belongs to the last probe line that starts no later (an as-of join)."""
    p = probe.select(F.col(key).alias("_k"), "probe_start", "line_start")
    met = results.join(p, (F.col(key) == F.col("_k")) & (F.col("probe_start") <= F.col("start")))
    last = met.groupBy(*results.columns).agg(F.max_by(F.col("line_start") - F.col("probe_start"), "probe_start").alias("shift"))
    return last.withColumn("start", F.col("start") + F.col("shift")).withColumn("end", F.col("end") + F.col("shift")).drop("shift")


def suggestion_label(label: Column) -> Column:
    """Unknown labels are ID."""
    up = F.upper(label)
    return F.when(up.isin(*labels.PLACEHOLDER), up).otherwise("ID")


def suggested(texts: DataFrame, suggestions: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Spans of suggested strings (key, value, label): each exact occurrence, else each with any white space between its words; located says whether there was one."""
    fit = suggestions.where(F.length("value").between(SHORTEST, LONGEST)).join(texts.select(key, text), key)
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.col("value"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    spaced = F.concat(F.lit(r"\Q"), F.regexp_replace(F.trim("value"), r"(?U)\s+", r"\\E(?U:\\s+)\\Q"), F.lit(r"\E"))
    exact, loose = _occurrences(F.col(text), quoted), _occurrences(F.col(text), spaced)
    spots = F.when(F.size(exact) > 0, exact).otherwise(loose)
    out = fit.withColumn("spot", F.explode_outer(spots))
    return out.select(key, "value", suggestion_label(F.col("label")).alias("label"), F.col("spot.start").alias("start"), F.col("spot.end").alias("end"), F.lit(SUGGESTION_SCORE).alias("score"), F.lit("llm").alias("origin"), F.col("spot").isNotNull().alias("located"))


def _occurrences(text: Column, pattern: Column) -> Column:
    """Offsets of a pattern that differs from row to row."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).cast("int").alias("start"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("end")))).alias("out")
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])).otherwise(none)


def parse_response(reply: Column) -> Column:
    """(entities, error) of a model's reply: the object from the first brace to the last; items without a text are left out, a missing label is ID.

    Fails closed: a reply without such an object, or whose entities are no list, has an
    error and no entities, and must not be read as "nothing found".
    """
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    found = F.get_json_object(inner, "$.entities")
    # a text that is no string is left out, a label of another kind is taken as it is written
    items = F.from_json(found, "array<string>")
    whole = F.when(F.coalesce(inner, F.lit("")) == "", "no_json").when(F.get_json_object(inner, "$").isNull(), "bad_json").when(~F.startswith(F.coalesce(F.ltrim(found), F.lit("")), F.lit("[")) | items.isNull(), "bad_shape")
    text = lambda i: F.get_json_object(i, "$.text")
    is_text = lambda i: F.try_variant_get(F.try_parse_json(i), "$.text", "string").isNotNull() & (F.schema_of_variant(F.try_variant_get(F.try_parse_json(i), "$.text", "variant")) == "STRING")
    good = F.filter(items, lambda i: F.coalesce(is_text(i), F.lit(False)))
    made = F.transform(good, lambda i: F.struct(text(i).alias("text"), F.upper(F.coalesce(F.get_json_object(i, "$.label"), F.lit("ID"))).alias("label")))
    return F.struct(F.when(whole.isNull(), made).alias("entities"), whole.alias("error"))


def apply_overrides(spans: DataFrame, overrides: DataFrame, manual: DataFrame, key: list[str]) -> DataFrame:
    """For the image export: spans without those that a user left out (key, entity_index), and the user's own boxes."""
    kept = spans.join(overrides.select(*key, "entity_index"), [*key, "entity_index"], "left_anti")
    return kept.unionByName(manual, allowMissingColumns=True)


