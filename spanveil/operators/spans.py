"""Span algebra on one array of spans per text: dedup, merge, containment, trim, union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil import labels
from spanveil.functions import checks
from spanveil.functions.text import core, cut, digit_count, has_core, let
from spanveil.operators.numeric import CONTEXT_LABELS
from spanveil.schemas import SPAN, SPANS


def span(e: Column, **changes: Column) -> Column:
    """The span with some fields changed."""
    names = ("start", "end", "label", "txt", "score", "origin", "validated", "strong")
    return F.struct(*[changes.get(n, e[n]).alias(n) for n in names]).cast(SPAN)


def rank(e: Column) -> Column:
    return F.struct(e["validated"].alias("v"), labels.priority(e["label"]).alias("p"), (e["end"] - e["start"]).alias("n"), e["score"].alias("s"))


def in_order(spans: Column) -> Column:
    """By start, longer first, else as they are."""
    keyed = F.transform(spans, lambda e, i: F.struct(e["start"].alias("a"), (e["start"] - e["end"]).alias("b"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def reslice(text: Column, spans: Column) -> Column:
    """Spans with the text's own characters; those with fewer than two letters or digits inside go."""
    own = F.transform(spans, lambda e: span(e, txt=cut(text, e["start"], e["end"])))
    return F.filter(own, lambda e: has_core(e["txt"]))


def dedup(spans: Column) -> Column:
    """One span per place. The winner so far holds the highest score seen, and only a strictly higher rank replaces it, so this is a fold and no maximum."""
    same = lambda o, e: (o["start"] == e["start"]) & (o["end"] == e["end"])

    def step(acc: Column, e: Column) -> Column:
        joined = lambda o: span(F.when(rank(e) > rank(o), e).otherwise(o), score=F.greatest(e["score"], o["score"]), validated=e["validated"] | o["validated"])
        replaced = F.transform(acc, lambda o: F.when(same(o, e), joined(o)).otherwise(o))
        return F.when(F.exists(acc, lambda o: same(o, e)), replaced).otherwise(F.concat(acc, F.array(e))).cast(SPANS)

    return in_order(F.aggregate(spans, F.array().cast(SPANS), step))


def promote(e: Column) -> Column:
    """Check digits: BR_DOC becomes what validates or needs eight digits (else null); an invalid CPF or CNPJ becomes BR_DOC."""
    label, true = F.upper(e["label"]), F.lit(True)

    def checked(value: Column) -> Column:
        cpf, cnpj, demoted = checks.cpf_valid(value), checks.cnpj_valid(value), span(e, label=F.lit("BR_DOC"))
        doc = F.when(cpf, span(e, label=F.lit("BR_CPF"), validated=true)).when(cnpj, span(e, label=F.lit("BR_CNPJ"), validated=true)).when(digit_count(value) >= 8, e)
        return (
            F.when(label == "BR_DOC", doc)
            .when(label.isin("BR_CPF", "CPF"), F.when(cpf, span(e, validated=true)).otherwise(demoted))
            .when(label.isin("BR_CNPJ", "CNPJ"), F.when(cnpj, span(e, validated=true)).otherwise(demoted))
            .when((label == "CNS") & checks.cns_valid(value), span(e, validated=true))
            .otherwise(e)
        )

    return let(core(e["txt"]), checked)


def merge(text: Column, spans: Column) -> Column:
    """Neighbours of one label as one. Each span is held against the last result only, so another label between breaks the chain."""

    def joined(e: Column, last: Column, gap: Column) -> Column:
        """The two as one, or null."""
        marks = (F.length(gap) <= 3) & F.regexp_like(gap, F.lit(r"(?U)^[\s.,\-/:;()\[\]_]+$"))
        filler = (e["label"] == "PERSON") & (F.length(gap) <= 12) & F.regexp_like(gap, F.lit(r"(?U)^[\p{L}\s&&[^\n]]+$"))
        fuse = (e["label"] == last["label"]) & ((e["start"] <= last["end"]) | (~e["label"].isin(*CONTEXT_LABELS) & (marks | filler)))
        end = F.greatest(last["end"], e["end"])
        return F.when(fuse, span(last, end=end, txt=cut(text, last["start"], end), score=F.greatest(last["score"], e["score"]), validated=last["validated"] | e["validated"], strong=last["strong"] | e["strong"]))

    def step(acc: Column, e: Column) -> Column:
        wide = let(F.try_element_at(acc, F.lit(-1)), lambda last: let(cut(text, last["end"], e["start"]), lambda gap: joined(e, last, gap)))
        fused = lambda w: F.when(w.isNotNull(), F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(w))).otherwise(F.concat(acc, F.array(e))).cast(SPANS)
        return let(wide, fused)

    return F.aggregate(in_order(spans), F.array().cast(SPANS), step)


def drop_contained(spans: Column) -> Column:
    """Without those that lie inside another with other bounds."""
    inside = lambda e, o: ((o["start"] != e["start"]) | (o["end"] != e["end"])) & (o["start"] <= e["start"]) & (o["end"] >= e["end"])
    return let(spans, lambda xs: F.filter(xs, lambda e: ~F.exists(xs, lambda o: inside(e, o))))


def trim(text: Column, spans: Column) -> Column:
    """Disjoint spans: of two that overlap the lower rank shrinks, or goes where nothing is left; ties keep the earlier."""
    state = f"struct<cur:{SPAN},gone:boolean,out:{SPANS}>"

    def against(s: Column, p: Column) -> Column:
        cur, keeps = s["cur"], F.concat(s["out"], F.array(p))
        sliced = lambda e, a, b: span(e, start=a, end=b, txt=cut(text, a, b))
        apart = s["gone"] | (cur["start"] >= p["end"]) | (cur["end"] <= p["start"])
        wins = rank(cur) > rank(p)
        less = F.when(p["start"] < cur["start"], sliced(p, p["start"], cur["start"])).when(p["end"] > cur["end"], sliced(p, cur["end"], p["end"])).otherwise(span(p, end=p["start"], txt=F.lit("")))
        rest = F.when(cur["end"] > p["end"], sliced(cur, p["end"], cur["end"])).when(cur["start"] < p["start"], sliced(cur, cur["start"], p["start"]))
        given = lambda c, g, o: F.struct(c.alias("cur"), g.alias("gone"), o.alias("out")).cast(state)
        return (
            F.when(apart, given(cur, s["gone"], keeps)).when(wins, given(cur, s["gone"], F.concat(s["out"], F.array(less)))).when(rest.isNull(), given(cur, F.lit(True), keeps)).otherwise(given(rest, F.lit(False), keeps))
        )

    def step(acc: Column, e: Column) -> Column:
        begin = F.struct(e.alias("cur"), F.lit(False).alias("gone"), F.array().cast(SPANS).alias("out")).cast(state)
        return F.aggregate(acc, begin, against, lambda s: F.when(s["gone"], s["out"]).otherwise(F.concat(s["out"], F.array(s["cur"]))).cast(SPANS))

    cleared = F.aggregate(spans, F.array().cast(SPANS), step)
    alive = F.filter(cleared, lambda e: (e["end"] > e["start"]) & has_core(e["txt"]))
    return F.transform(F.array_sort(F.transform(alive, lambda e, i: F.struct(e["start"].alias("a"), i.alias("i"), e.alias("e")))), lambda k: k["e"])


def finalize(text: Column, spans: Column) -> Column:
    return trim(text, drop_contained(in_order(spans)))


def union_windows(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans of overlapping windows (start, end, label in the text's offsets) as disjoint ones; REDACTED where labels differ."""
    order = Window.partitionBy(*by).orderBy("start", "end", "label")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(F.lit("REDACTED"))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), one.alias("label")).drop("island")
