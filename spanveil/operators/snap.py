"""Anchor a model's span to the whole pattern that it touches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import let, matches
from spanveil.operators.rules import RULES, Rule, has_context
from spanveil.schemas import SPAN

#: Labels whose pattern alone is evidence; punctuation that is.
SURE = ("EMAIL", "CRM", "AGE")
FORMATTED = r"[./()\-]"


def _best(text: Column, e: Column, rule: Rule) -> Column:
    """The longest match that overlaps the span, first on ties; searched in the window only, so its edges hide what is beyond."""
    back, ahead = rule.window
    low = F.greatest(F.lit(0), e["start"] - back)

    def within(window: Column) -> Column:
        found = F.filter(matches(window, rule.pattern), lambda m: (m["end"] + low > e["start"]) & (m["start"] + low < e["end"]))
        if rule.validator is not None:
            found = F.filter(found, lambda m: rule.validator(m["txt"]))
        return F.array_min(F.transform(found, lambda m: F.struct((m["start"] - m["end"]).alias("size"), (m["start"] + low).alias("start"), (m["end"] + low).alias("end"), m["txt"].alias("txt"))))

    return let(F.substring(text, low + 1, F.least(F.length(text), e["end"] + ahead) - low), within)


def _moved(text: Column, e: Column, rule: Rule, m: Column) -> Column:
    validated = rule.validator is not None
    strong = F.lit(False)
    if not rule.keep_label:
        strong = F.lit(True) if validated or rule.label in SURE else F.regexp_like(m["txt"], F.lit(FORMATTED))
        if rule.context:
            strong = strong | has_context(text, m["start"], m["end"], rule.context)
    moved = F.struct(
        m["start"].cast("int").alias("start"), m["end"].cast("int").alias("end"), (e["label"] if rule.keep_label else F.lit(rule.label)).alias("label"), m["txt"].alias("txt"), e["score"].alias("score"),
        e["origin"].alias("origin"), (F.lit(validated) | e["validated"]).alias("validated"), (strong | e["strong"]).alias("strong"),
    )
    return F.when(m.isNotNull(), moved.cast(SPAN))


def snap(text: Column, e: Column) -> Column:
    """The span, moved to the match of the highest rule for its label that has one."""
    label = F.upper(e["label"])
    tried = []
    for rule in sorted(RULES, key=lambda r: -r.priority):
        move = _mover(text, e, rule)
        tried.append(F.when(label.isin(*rule.sources), let(_best(text, e, rule), move)))
    return F.coalesce(*tried, e)


def _mover(text: Column, e: Column, rule: Rule):
    return lambda m: _moved(text, e, rule, m)
