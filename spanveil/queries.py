"""Queries of the detection engine over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil import labels
from spanveil.config import EngineConfig
from spanveil.functions import checks
from spanveil.functions import text as tx
from spanveil.operators import evaluate, layout, numeric, rules, seams, snap, spans
from spanveil.plans import batch, pipeline
from spanveil.plans.chunking import chunks
from spanveil.schemas import SPAN, SPANS
from spanveil.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame, key: str, column: str = "spans") -> DataFrame:
    """One row a span. The outer form keeps the optimizer from copying the whole detection into a filter below it."""
    return df.select(key, F.inline_outer(column)).where(F.col("start").isNotNull())


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RUN = r"[0-9](?:[ .\-/]?[0-9])*"


def _located(table: str, key: str, column: str, pattern: str) -> str:
    """Matches with offsets: lengths of the pieces between them and of the matches before."""
    return f"""
WITH m AS (SELECT {key}, regexp_extract_all({column}, '{pattern}') AS ms, regexp_split_to_array({column}, '{pattern}') AS ps FROM {table}),
x AS (SELECT {key}, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)
SELECT {key}, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda p: length(p))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS INT) AS start, ms[i] AS txt FROM x"""


def _scan(spark, sf_dir, table, key, column, label):
    rule = rules.BY_LABEL[label]
    found = read(spark, sf_dir, table).select(key, rules.guarded(F.coalesce(column, F.lit("")), rule).alias("m"))
    return found.select(key, F.inline_outer("m")).where(F.col("start").isNotNull()).select(key, "start", "txt")


@query(_located("documents", "doc_id", "text", EMAIL))
def scan_email(spark, sf_dir):
    return _scan(spark, sf_dir, "documents", "doc_id", "text", "EMAIL")


@query(_located("pages", "page_id", "html", EMAIL))
def scan_email_pages(spark, sf_dir):
    return _scan(spark, sf_dir, "pages", "page_id", "html", "EMAIL")


@query(_located("documents", "doc_id", "text", RUN))
def scan_digit_run(spark, sf_dir):
    return _scan(spark, sf_dir, "documents", "doc_id", "text", "DIGIT_RUN")


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS redacted FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def redact_email(spark, sf_dir):
    found = read(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", "text", rules.rule_spans(F.coalesce("text", F.lit("")), rules.BY_LABEL["EMAIL"]).alias("spans"))
    return found.where(F.size("spans") > 0).select("doc_id", pipeline.redact(F.col("text"), F.col("spans")).alias("redacted"))


@query(f"SELECT lang, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '{EMAIL}'))) AS BIGINT) AS emails FROM documents GROUP BY lang")
def email_stats_by_lang(spark, sf_dir):
    n = F.when(F.contains("text", F.lit("@")), F.regexp_count("text", F.lit(EMAIL))).otherwise(F.when(F.col("text").isNotNull(), 0))
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(n).cast("long").alias("emails"))


# Identifiers from keys: a third of the numbers has a changed last digit.
_CHANGED = "CASE WHEN k % 3 = 0 THEN substr({c}, 1, {n}) || CAST((CAST(substr({c}, {m}, 1) AS INT) + 1) % 10 AS STRING) ELSE {c} END"


def _numbers(column: str, size: int) -> str:
    return f"SELECT k, {_CHANGED.format(c=column, n=size - 1, m=size)} AS number, k % 3 <> 0 AS valid FROM numbers"


@query(fixtures.duck(_numbers("cpf", 11)))
def cpf_validate(spark, sf_dir):
    return fixtures.sql_over_keys(spark, sf_dir, _numbers("cpf", 11)).select("k", "number", checks.cpf_valid(F.col("number")).alias("valid"))


@query(fixtures.duck(_numbers("cnpj", 14)))
def cnpj_validate(spark, sf_dir):
    return fixtures.sql_over_keys(spark, sf_dir, _numbers("cnpj", 14)).select("k", "number", checks.cnpj_valid(F.col("number")).alias("valid"))


@query(fixtures.duck(_numbers("cns", 15)))
def cns_validate(spark, sf_dir):
    return fixtures.sql_over_keys(spark, sf_dir, _numbers("cns", 15)).select("k", "number", checks.cns_valid(F.col("number")).alias("valid"))


_GOLD_ROWS = "SELECT note_id, char_start AS start, char_end AS \"end\", label, value AS txt FROM ({gold}) g WHERE valid AND {which}"


def _gold(which: str) -> str:
    return fixtures.duck(_GOLD_ROWS.format(gold=fixtures.GOLD_SQL, which=which))


def _rule_query(label: str):
    def run(spark, sf_dir):
        found = fixtures.notes(spark, sf_dir).select("note_id", rules.rule_spans(F.col("text"), rules.BY_LABEL[label]).alias("spans"))
        return flat(found, "note_id").select("note_id", "start", "end", "label", "txt")

    return run


for _name, _label in (("scan_cpf", "BR_CPF"), ("scan_cnpj", "BR_CNPJ"), ("scan_phone", "PHONE"), ("scan_crm", "CRM"), ("scan_cep", "ZIPCODE"), ("scan_date", "DATE"), ("scan_age", "AGE"), ("scan_rg", "BR_RG")):
    query(_gold(f"label = '{_label}'"), _name)(_rule_query(_label))


@query(_gold("label <> 'PERSON'"))
def scan_all_rules(spark, sf_dir):
    found = fixtures.notes(spark, sf_dir).select("note_id", rules.scan(F.col("text")).alias("spans"))
    return flat(found, "note_id").select("note_id", "start", "end", "label", "txt")


@query(_gold("label = 'PERSON'"))
def labelled_names(spark, sf_dir):
    from spanveil.operators import names

    found = fixtures.notes(spark, sf_dir).select("note_id", names.labelled_names(F.col("text")).alias("spans"))
    return flat(found, "note_id").select("note_id", "start", "end", "label", "txt")


@query(_gold("true"))
def pipeline_spans(spark, sf_dir):
    return flat(pipeline.detect(fixtures.notes(spark, sf_dir)), "note_id").select("note_id", "start", "end", "label", "txt")


def _redacted_sql() -> str:
    out = ["lead"]
    for before, value, label in fixtures.PIECES:
        shown = f"'{labels.PLACEHOLDER[label]}'" if label else value
        out += [f"'{before}'", f"CASE WHEN cpf_ok THEN {shown} ELSE cpf END" if value == "cpf" else shown]
    return fixtures.duck(f"SELECT note_id, {' || '.join(out)} AS redacted FROM vals")


@query(_redacted_sql())
def pipeline_redacted(spark, sf_dir):
    found = pipeline.detect(fixtures.notes(spark, sf_dir))
    return found.select("note_id", pipeline.redact(F.col("text"), F.col("spans")).alias("redacted"))


@query(fixtures.duck(f"SELECT label, count(*) AS n, count(DISTINCT note_id) AS notes FROM ({fixtures.GOLD_SQL}) g WHERE valid GROUP BY label"))
def pipeline_stats(spark, sf_dir):
    found = flat(pipeline.detect(fixtures.notes(spark, sf_dir)), "note_id")
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note_id").alias("notes"))


# Fragments that a model might give: the inside of a value, under a loose label.
_FRAGMENTS = "SELECT note_id, char_start + 2 AS a, char_end - 3 AS b, label, char_start, char_end, value, valid FROM ({gold}) g WHERE label IN ('BR_CPF', 'PHONE', 'EMAIL', 'PERSON')".format(gold=fixtures.GOLD_SQL)
_LOOSE = "CASE label WHEN 'BR_CPF' THEN 'CPF' ELSE label END"


def fragments(spark, sf_dir) -> DataFrame:
    """(note_id, text, model): the fragments as spans of a model with score 0.3."""
    rows = fixtures.sql_over_keys(spark, sf_dir, _FRAGMENTS)
    one = F.struct(
        F.col("a").cast("int").alias("start"), F.col("b").cast("int").alias("end"), F.expr(_LOOSE).alias("label"), F.lit("").alias("txt"), F.lit(0.3).alias("score"), F.lit("model").alias("origin"), F.lit(False).alias("validated"),
        F.lit(False).alias("strong"),
    ).cast(SPAN)
    return fixtures.notes(spark, sf_dir).join(rows.groupBy("note_id").agg(F.array_sort(F.collect_list(one)).alias("model")), "note_id").repartition("note_id")


@query(
    fixtures.duck(f"""SELECT note_id, a AS frag_start, CASE WHEN label = 'PERSON' THEN a ELSE char_start END AS start, CASE WHEN label = 'PERSON' THEN b ELSE char_end END AS "end",
  CASE WHEN label = 'BR_CPF' AND NOT valid THEN 'CPF' ELSE label END AS label, label <> 'PERSON' AND valid AS strong FROM ({_FRAGMENTS}) f""")
)
def snap_fragments(spark, sf_dir):
    moved = F.transform("model", lambda e: F.struct(e["start"].alias("frag_start"), snap.snap(F.col("text"), e).alias("e")))
    out = fragments(spark, sf_dir).select("note_id", F.explode_outer(moved).alias("x"))
    return out.select("note_id", "x.frag_start", "x.e.start", "x.e.end", "x.e.label", "x.e.strong")


@query(
    # what is cut off at the end begins in lower case within a word, so only the front grows back
    fixtures.duck(f"""SELECT note_id, char_start AS start, char_end - 3 AS "end" FROM ({fixtures.GOLD_SQL}) g WHERE label = 'PERSON'""")
)
def expand_person(spark, sf_dir):
    from spanveil.operators import names

    people = F.filter("model", lambda e: e["label"] == "PERSON")
    out = fragments(spark, sf_dir).select("note_id", F.explode_outer(people).alias("e"), "text")
    wide = out.select("note_id", names.expand(F.col("text"), F.col("e")).alias("w"))
    return wide.select("note_id", "w.start", "w.end")


# A fragment of a number with wrong check digits stays a document number above the threshold; below it the classifier decides, and knows no more than that it is a number.
@query(fixtures.duck(f"""SELECT CASE WHEN valid THEN label WHEN 0.3 >= threshold THEN 'BR_DOC' ELSE 'NUMERO' END AS label, threshold::DOUBLE AS threshold, count(*) AS n
  FROM ({fixtures.GOLD_SQL}) g, (VALUES (0.2), (0.5), (0.95)) t(threshold) GROUP BY ALL"""))
def threshold_sweep(spark, sf_dir):
    df = fragments(spark, sf_dir)
    out = None
    for t in (0.2, 0.5, 0.95):
        found = flat(pipeline.detect(df, model_col="model", config=EngineConfig(threshold=t)), "note_id").groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("threshold", F.lit(t))
        out = found if out is None else out.unionByName(found)
    return out


@query(
    fixtures.duck("SELECT note_id, record AS txt, 'MEDICAL_RECORD' AS label, false AS validated FROM vals UNION ALL SELECT note_id, cns AS txt, 'CNS' AS label, true AS validated FROM vals")
)
def numeric_keyword_nearest(spark, sf_dir):
    notes = fixtures.notes(spark, sf_dir)
    numbers = F.filter(tx.matches(F.col("text"), r"(?U)(?<!\d)\d+(?!\d)"), lambda m: F.length(m["txt"]).isin(7, 15))
    one = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("NUM_CANDIDATE").alias("label"), m["txt"].alias("txt"), F.lit(0.3).alias("score"), F.lit("model").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong"))
    found = notes.select("note_id", F.explode_outer(F.transform(numbers, lambda m: numeric.classify(F.col("text"), one(m).cast(SPAN)))).alias("e"))
    return found.where("e is not null").select("note_id", "e.txt", "e.label", "e.validated")


# Digit runs of the documents by the words before them: a small cut of the classifier that SQL can follow.
@query()
def digit_run_classified(spark, sf_dir):
    one = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("NUM_CANDIDATE").alias("label"), m["txt"].alias("txt"), F.lit(0.3).alias("score"), F.lit("model").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong"))
    found = read(spark, sf_dir, "documents").select("doc_id", F.transform(tx.matches(F.coalesce("text", F.lit("")), rules.BY_LABEL["DIGIT_RUN"].pattern), lambda m: numeric.classify(F.coalesce("text", F.lit("")), one(m).cast(SPAN))).alias("es"))
    return found.select(F.explode_outer("es").alias("e")).where("e is not null").groupBy("e.label").agg(F.count(F.lit(1)).alias("n"))


@query(
    fixtures.duck("""SELECT k, CASE WHEN k % 3 = 0 THEN 'BR_DOC' ELSE 'BR_CPF' END AS label, k % 3 <> 0 AS validated FROM numbers""")
)
def doc_promotion(spark, sf_dir):
    rows = fixtures.sql_over_keys(spark, sf_dir, _numbers("cpf", 11))
    e = F.struct(F.lit(0).alias("start"), F.lit(11).alias("end"), F.lit("BR_DOC").alias("label"), F.col("number").alias("txt"), F.lit(0.4).alias("score"), F.lit("model").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong"))
    return rows.select("k", spans.promote(e.cast(SPAN)).alias("e")).select("k", "e.label", "e.validated")


# Spans from order keys, up to 24 a text, many with the same bounds or one inside another.
_SPANS = """SELECT CAST(floor(o_orderkey / 24.0) AS INT) AS page_id, CAST(o_orderkey * 7 % 30 * 9 AS INT) AS start, CAST(o_orderkey * 7 % 30 * 9 + 4 + o_orderkey % 5 * 6 AS INT) AS "end",
  CASE o_orderkey % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'PERSON' ELSE 'EMAIL' END AS label FROM orders"""


def order_spans(spark, sf_dir) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_SPANS.replace('"end"', "`end`"))


def _as_arrays(df: DataFrame) -> DataFrame:
    one = F.struct("start", "end", "label", F.lit("xx").alias("txt"), F.lit(0.9).alias("score"), F.lit("regex").alias("origin"), F.lit(False).alias("validated"), F.lit(False).alias("strong")).cast(SPAN)
    return df.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).cast(SPANS).alias("spans"))


@query(
    f"""WITH s AS ({_SPANS}) SELECT page_id, start, "end", label FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b
  WHERE b.page_id = a.page_id AND (b.start <> a.start OR b."end" <> a."end") AND b.start <= a.start AND b."end" >= a."end")"""
)
def drop_contained(spark, sf_dir):
    return flat(_as_arrays(order_spans(spark, sf_dir)).select("page_id", spans.drop_contained(F.col("spans")).alias("spans")), "page_id").select("page_id", "start", "end", "label")


@query(
    f"""WITH s AS ({_SPANS}), g AS (SELECT *, coalesce(start >= max("end") OVER (PARTITION BY page_id
  ORDER BY start, "end", label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM s),
i AS (SELECT *, sum(new::INT) OVER (PARTITION BY page_id ORDER BY start, "end", label ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT page_id, min(start) AS start, max("end") AS "end", CASE WHEN min(label) = max(label) THEN min(label) ELSE 'REDACTED' END AS label FROM i
  GROUP BY page_id, island"""
)
def union_windows(spark, sf_dir):
    return spans.union_windows(order_spans(spark, sf_dir), ["page_id"])


@query(
    f"""WITH s AS ({_SPANS}) SELECT page_id, start, "end", max_by(label, CASE label WHEN 'EMAIL' THEN 80 WHEN 'PERSON' THEN 55 ELSE 48 END) AS label FROM s
  GROUP BY page_id, start, "end\""""
)
def dedup_spans(spark, sf_dir):
    return flat(_as_arrays(order_spans(spark, sf_dir)).select("page_id", spans.dedup(F.col("spans")).alias("spans")), "page_id").select("page_id", "start", "end", "label")


_GAP_TEXT = "substr(repeat('x, ', 120), e + 1, greatest(0, s2 - e))"


# One span after the other: each joins the last one of its text or begins the next.
@query(
    f"""WITH RECURSIVE o AS (SELECT page_id, start AS s2, "end" AS e2, label AS l2, row_number() OVER (PARTITION BY page_id ORDER BY start, "end" DESC, label) AS i
  FROM ({_SPANS}) t),
r AS (SELECT page_id, i, 1::BIGINT AS g, s2 AS s, e2 AS e, l2 AS l FROM o WHERE i = 1
  UNION ALL SELECT page_id, i, CASE WHEN joins THEN g ELSE g + 1 END, CASE WHEN joins THEN s ELSE s2 END, CASE WHEN joins THEN greatest(e, e2) ELSE e2 END, l2 FROM (
    SELECT o.page_id, o.i, g, s, e, s2, e2, l2, l = l2 AND (s2 <= e OR (s2 - e <= 3 AND regexp_full_match({_GAP_TEXT}, '[ .,/:;()_-]*')) OR (l = 'PERSON' AND s2 - e <= 12 AND regexp_full_match({_GAP_TEXT}, '[a-zA-Z ]*'))) AS joins
    FROM r JOIN o ON o.page_id = r.page_id AND o.i = r.i + 1) n)
SELECT page_id, min(s) AS start, max(e) AS "end", min(l) AS label FROM r GROUP BY page_id, g"""
)
def merge_adjacent(spark, sf_dir):
    arrays = _as_arrays(order_spans(spark, sf_dir))
    merged = arrays.select("page_id", spans.merge(F.lit("x, " * 120), F.col("spans")).alias("spans"))
    return flat(merged, "page_id").select("page_id", "start", "end", "label")


@query()
def trim_overlaps(spark, sf_dir):
    arrays = _as_arrays(order_spans(spark, sf_dir))
    done = arrays.select("page_id", spans.finalize(F.lit("abc" * 120), spans.dedup(F.col("spans"))).alias("spans"))
    return flat(done, "page_id").select("page_id", "start", "end", "label")


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"""{_LINES}, k AS (SELECT * FROM l WHERE length(line) > 0)
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id
  ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS char_start,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id
  ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(line) AS INT) AS char_end FROM k""")
def ocr_offset_map(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "txt"))
    return layout.with_offsets(lines, ["doc_id"]).select("doc_id", "line_no", "char_start", "char_end")


_UPPER_RUN = "regexp_replace(line, '[^\\p{L}]', '', 'g')"


@query(f"""{_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no FROM l WHERE len(regexp_extract_all(line, '[A-Za-zÀ-ÖØ-öø-ÿ]{{2,}}')) >= 2 AND length({_UPPER_RUN}) >= 6
AND length(regexp_replace(line, '[^\\p{{Lu}}]', '', 'g')) / length({_UPPER_RUN}) >= 0.70""")
def caps_lines(spark, sf_dir):
    lines = seams.text_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return lines.where(tx.caps_line(F.col("line"))).select("doc_id", "line_no")


# the line with RG and CNPJ is the only one in capitals
@query(fixtures.duck(f"SELECT note_id, 0 AS probe_start, char_start - 3 AS line_start FROM ({fixtures.GOLD_SQL}) g WHERE label = 'BR_RG'"))
def caps_offset_map(spark, sf_dir):
    notes = fixtures.notes(spark, sf_dir)
    found = flat(pipeline.detect(notes), "note_id")
    return seams.caps_probe(notes, found, "note_id").select("note_id", "probe_start", "line_start")


# Boxes from turn numbers: several rows of words, some on one row of pixels.
_BOXES = "SELECT conv_id, turn, CAST(turn * 37 % 100 AS DOUBLE) AS y0, CAST(turn * 53 % 200 AS DOUBLE) AS x0 FROM conversations"


@query(f"""WITH b AS ({_BOXES}) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round_even(y0 / 8, 0)::BIGINT * 8, x0, turn) - 1 AS line_no FROM b""")
def reading_order(spark, sf_dir):
    read(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    lines = spark.sql(_BOXES).withColumn("line_idx", F.col("turn"))
    return layout.reading_order(lines, ["conv_id"]).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"))


_KNOWN = (layout.NARROW + layout.SLIM + layout.WIDE + layout.WIDEST).replace("'", "''")


def _width(t: str) -> str:
    """The advance width of a string in SQL."""
    quoted = lambda chars: chars.replace("'", "''")
    known = " + ".join(f"(length({t}) - length(translate({t}, '{quoted(c)}', ''))) * {w}" for c, w in ((layout.NARROW, 0.40), (layout.SLIM, 0.60), (layout.WIDE, 1.65), (layout.WIDEST, 1.80)))
    other = f"translate({t}, '{_KNOWN}', '')"
    capitals = f"length(regexp_replace({other}, '[^\\p{{Lu}}]', '', 'g'))"
    return f"({known} + {capitals} * 1.3 + length({other}) - {capitals})"


@query(f"SELECT conv_id, turn, round({_width('text')}, 3)::DOUBLE AS width FROM conversations")
def char_widths(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(layout.text_width(F.col("text")), 3).alias("width"))


def note_page(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Gold spans of the notes and their lines as level boxes ten pixels a line and character; the last line has none."""
    lines = seams.text_lines(fixtures.notes(spark, sf_dir), "note_id")
    boxed = lines.where("line not like 'Cartao%' and line not like 'RG%'").select(
        "note_id", F.col("line").alias("txt"), F.lit(0.0).alias("x0"), (F.col("line_no") * 10).cast("double").alias("y0"), (F.length("line") * 10).cast("double").alias("x1"), (F.col("line_no") * 10 + 8).cast("double").alias("y1"),
        F.col("line_start").alias("char_start"), F.col("line_end").alias("char_end"), F.lit(None).cast("array<struct<a:int,b:int,x0:double,x1:double>>").alias("words"),
    )
    gold = fixtures.sql_over_keys(spark, sf_dir, fixtures.GOLD_SQL).select("note_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), "label")
    return gold, boxed


@query(fixtures.duck(f"""SELECT note_id, char_start AS start, label, CAST(CASE WHEN label IN ('BR_RG', 'BR_CNPJ') THEN 0 ELSE 1 END AS INT) AS n_boxes, label IN ('BR_RG', 'BR_CNPJ') AS unmapped FROM ({fixtures.GOLD_SQL}) g"""))
def span_to_lines(spark, sf_dir):
    gold, lines = note_page(spark, sf_dir)
    return layout.span_boxes(gold, lines, ["note_id"]).select("note_id", "start", "label", F.size("boxes").alias("n_boxes"), "unmapped")


@query(fixtures.duck(f"""SELECT note_id, count(*) AS entities, count(*) FILTER (label IN ('BR_RG', 'BR_CNPJ')) AS unmapped, count(*) FILTER (label IN ('BR_RG', 'BR_CNPJ')) = 0 AS exportable
  FROM ({fixtures.GOLD_SQL}) g GROUP BY note_id"""))
def export_gate(spark, sf_dir):
    gold, lines = note_page(spark, sf_dir)
    return layout.export_gate(layout.span_boxes(gold, lines, ["note_id"]), "note_id")


_NOTE_LINES = f"SELECT note_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no, text FROM ({fixtures.NOTES_SQL}) n"
_SUBBOX = f"""WITH l AS ({_NOTE_LINES}), p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY note_id
  ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
b AS (SELECT g.note_id, char_start AS start, line, line_no, substr(line, 1, (char_start - pos)::BIGINT) AS pa, substr(line, 1, (char_end - pos)::BIGINT) AS pb, 0.6 / length(line) AS pad, 10.0 * length(line) AS w
  FROM ({fixtures.GOLD_SQL}) g JOIN p ON p.note_id = g.note_id AND char_start >= pos AND char_end <= pos + length(line)
  WHERE line NOT LIKE 'RG%' AND line NOT LIKE 'Cartao%')
SELECT note_id, start, floor(w * greatest(0, {_width('pa')} / {_width('line')} - pad))::INT AS x0, greatest(0, floor(line_no * 10 - 0.64))::INT AS y0,
  least(1240, ceil(round(w * least(1, {_width('pb')} / {_width('line')} + pad), 9)))::INT AS x1, ceil(line_no * 10 + 8.64)::INT AS y1 FROM b"""


@query(fixtures.duck(f"SELECT * FROM ({_SUBBOX}) b"))
def line_subboxes(spark, sf_dir):
    gold, lines = note_page(spark, sf_dir)
    boxes = layout.span_boxes(gold, lines, ["note_id"]).select("note_id", "start", F.explode_outer("boxes").alias("b"))
    # beyond the ninth digit the sum of the widths depends on its order
    sides = F.struct(*[F.round(F.col(f"b.{c}"), 9).alias(c) for c in ("x0", "y0", "x1", "y1")])
    px = layout.outward(sides, F.lit(1240), F.lit(1754)).alias("px")
    return boxes.where("b is not null").select("note_id", "start", px).select("note_id", "start", "px.x0", "px.y0", "px.x1", "px.y1")


_MOCK = [
    ("MEDICA MODELO", "PERSON"),
    ("Helena Castro da Rocha", "PERSON"), ("529.982.247-25", "BR_CPF"), ("23.456.789-0", "BR_RG"), ("07/09/1981", "DATE"), ("43 anos", "AGE"), ("(21) 98765-4321", "PHONE"), ("helena@exemplo.org", "EMAIL"),
    ("Avenida Central, 900, Bairro Novo", "ADDRESS"), ("Paulo Neves", "PERSON"), ("CRM-RJ 654321", "CRM"), ("03/04/2024", "DATE"),
]


@query(
    "WITH t AS (SELECT " + " || chr(10) || ".join(f"'{line}'" for line in fixtures.MOCK_LINES) + " AS page) SELECT 1 AS page_id, (strpos(page, txt) - 1)::INT AS start, (strpos(page, txt) - 1 + length(txt))::INT AS \"end\", label, txt FROM t, (VALUES "
    + ", ".join(f"('{t}', '{n}')" for t, n in _MOCK)
    + ") v(txt, label)"
)
def mock_page_spans(spark, sf_dir):
    lines = layout.with_offsets(layout.reading_order(fixtures.mock_page(spark), ["page_id"]), ["page_id"])
    text = layout.page_text(lines, ["page_id"]).repartition("page_id")
    return flat(pipeline.detect(text, config=EngineConfig(mode="mock")), "page_id").select("page_id", "start", "end", "label", "txt")


@query("""SELECT doc_id, CAST(a AS INT) AS window_start, CAST(length(text[a + 1:b]) AS INT) AS n_chars
  FROM (SELECT doc_id, text, greatest(0, p - 1000) AS a, least(length(text), p + 13000) AS b FROM (SELECT doc_id, text, unnest(range(0, length(text), 12000)) AS p
  FROM documents))""")
def chunk_windows(spark, sf_dir):
    out = batch.windows(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "window_start", F.length("chunk").alias("n_chars"))


def _cuts(limit: int, size: str) -> str:
    """Texts cut one piece after the other; size: of a piece, from h (the next characters, at most limit), last (where its last line break stands, -1 without one) and more (whether the text goes on behind h)."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
z AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS pos, 0::BIGINT AS size FROM d
  UNION ALL SELECT doc_id, i + 1, pos, {size} FROM (
    SELECT doc_id, i, pos, n - pos > {limit} AS more, h, CASE WHEN contains(h, chr(10)) THEN length(h) - length(regexp_extract(h, '[^\n]*$')) - 1 ELSE -1 END AS last
  FROM (
      SELECT z.doc_id, z.i, z.pos + z.size AS pos, d.n, substr(d.text, z.pos + z.size + 1, {limit}) AS h FROM z JOIN d ON d.doc_id = z.doc_id
  WHERE z.pos + z.size < d.n) w) v)"""


@query(_cuts(1000, "CASE WHEN NOT more THEN length(h) WHEN last < 500 THEN 1000 ELSE last + 1 END") + " SELECT z.doc_id, i::INT AS part, 'parte-' || lpad(i::VARCHAR, 4, '0') || '.txt' AS name, size::INT AS chars, sha256(substr(text, pos + 1, size)) AS sha256 FROM z JOIN d ON d.doc_id = z.doc_id WHERE i > 0")
def text_parts(spark, sf_dir):
    return batch.numbered_parts(read(spark, sf_dir, "documents"), "doc_id", 1000).select("doc_id", "part", "name", "chars", "sha256")


@query(_cuts(8000, "CASE WHEN more AND last > 0 THEN last ELSE length(h) END") + " SELECT doc_id, pos::INT AS start, size::INT AS n_chars FROM z WHERE i > 0 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE coalesce(text, '') = ''")
def model_chunks(spark, sf_dir):
    out = read(spark, sf_dir, "documents").select("doc_id", F.inline_outer(chunks(F.col("text"), 8000)))
    return out.select("doc_id", "start", F.length("chunk").alias("n_chars"))


# Of all rules only the one of e-mail addresses has matches in the documents, so SQL can follow.
@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{EMAIL}')) AS INT) AS n_spans, sha256(regexp_replace(coalesce(text, ''), '{EMAIL}', '[EMAIL]', 'g')) AS redacted_sha256 FROM documents""")
def redact_long(spark, sf_dir):
    out = batch.redact_long(read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    return out.select("doc_id", "n_spans", F.sha2("redacted", 256).alias("redacted_sha256"))


# Gold names and groups of the notes' values.
_GOLD_NAMES = {
    "PERSON": ("PATIENT_NAME", "NAME"), "BR_CPF": ("CPF", "DOC_NUM"), "PHONE": ("PHONE", "CONTACT"), "DATE": ("DATE_OF_BIRTH", "DATE"), "AGE": ("AGE", "AGE"), "ZIPCODE": ("CEP", "LOCATION"),
    "EMAIL": ("EMAIL", "CONTACT"), "CRM": ("CRM", "DOC_NUM"), "BR_RG": ("RG", "DOC_NUM"), "BR_CNPJ": ("CNPJ", "ORG"),
}
_NAMED = lambda i: "CASE label " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _GOLD_NAMES.items()) + " END"
_GOLD_EVAL = f"""SELECT note_id AS page_id, label || '@' || CAST(char_start AS STRING) AS id, {_NAMED(0)} AS label, {_NAMED(1)} AS grp, char_start AS gs, char_end AS ge,
  CASE WHEN note_id % 11 = 5 THEN CAST(0.5 AS DOUBLE) END AS min_coverage FROM ({fixtures.GOLD_SQL}) g"""
# Predictions that miss a tail (three of ten characters of some dates), carry another label, are absent, lie across each other, or stand beside all gold.
_PREDICTED = f"""SELECT note_id AS page_id, char_start AS start, char_end - CASE WHEN label = 'DATE' AND note_id % 5 = 1 THEN 3 WHEN note_id % 4 = 0 THEN 5 ELSE 0 END AS "end",
  CASE WHEN note_id % 6 = 1 THEN 'DATE' ELSE label END AS label FROM ({fixtures.GOLD_SQL}) g WHERE note_id % 10 <> 3
  UNION ALL SELECT note_id AS page_id, char_start + 2 AS start, char_end + 1 AS "end", 'BR_DOC' AS label FROM ({fixtures.GOLD_SQL}) g WHERE note_id % 7 = 2
  UNION ALL SELECT note_id AS page_id, CAST(1000 + note_id + x AS INT) AS start, CAST(1010 + note_id AS INT) AS "end", 'EMAIL' AS label FROM vals, (SELECT 0 AS x
  UNION ALL SELECT 1 AS x) t WHERE note_id % 9 = 0
  UNION ALL SELECT note_id AS page_id, char_end - 2 AS start, char_end + 8 AS "end", 'PHONE' AS label FROM ({fixtures.GOLD_SQL}) g
  WHERE note_id % 8 = 1 AND label = 'BR_CNPJ'"""


def gold_and_predicted(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    gold = fixtures.sql_over_keys(spark, sf_dir, _GOLD_EVAL).withColumnRenamed("grp", "group")
    return gold, fixtures.sql_over_keys(spark, sf_dir, _PREDICTED.replace('"end"', "`end`"))


# SQL counts covered characters one by one.
_GROUPS = "(VALUES " + ", ".join(f"('{k}', '{g}')" for k, v in evaluate.LABEL_GROUPS.items() for g in v) + ") lg(name, of)"
_NUMERIC = ", ".join(f"'{x}'" for x in evaluate.NUMERIC_GOLD)
_SHARES = f"""SELECT e.*, avg(seen::INT) AS cov, avg(own::INT) AS cov_label FROM ({_GOLD_EVAL}) e JOIN (
    SELECT x.page_id, x.id, c, bool_or(p.start IS NOT NULL) AS seen, bool_or(coalesce(lg.of = x.grp, false)) AS own
    FROM (SELECT page_id, id, grp, unnest(range(gs, ge)) AS c FROM ({_GOLD_EVAL}) i) x LEFT
  JOIN ({_PREDICTED}) p ON p.page_id = x.page_id AND p.start <= c AND c < p."end" LEFT JOIN {_GROUPS} ON lg.name = p.label
    GROUP BY x.page_id, x.id, c) y ON y.page_id = e.page_id AND y.id = e.id GROUP BY ALL"""
_OUTCOMES = f"""SELECT page_id, id, label, round(cov, 6)::DOUBLE AS covered, round(cov_label, 6)::DOUBLE AS covered_label,
  CASE WHEN cov < coalesce(min_coverage, CASE WHEN label IN ({_NUMERIC}) THEN 0.85 ELSE 0.6 END) THEN 'miss' WHEN cov_label >= 0.5 THEN 'hit' ELSE 'hit_mislabel' END AS outcome FROM ({_SHARES}) s"""


@query(fixtures.duck(_OUTCOMES))
def span_outcomes(spark, sf_dir):
    out = evaluate.span_outcomes(*gold_and_predicted(spark, sf_dir), ["page_id"])
    return out.select("page_id", "id", "label", F.round("covered", 6).alias("covered"), F.round("covered_label", 6).alias("covered_label"), "outcome")


@query(fixtures.duck(f"SELECT page_id, id, gs, ge, round(cov, 6)::DOUBLE AS coverage FROM ({_SHARES}) s"))
def interval_coverage(spark, sf_dir):
    gold, predicted = gold_and_predicted(spark, sf_dir)
    p = predicted.select(F.col("page_id").alias("_p"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    pairs = gold.join(p, (F.col("page_id") == F.col("_p")) & (F.col("ps") < F.col("ge")) & (F.col("pe") > F.col("gs")), "left")
    return evaluate.coverage(pairs, ["page_id", "id"]).withColumn("coverage", F.round("coverage", 6))


@query(fixtures.duck(f"""SELECT coalesce(label, 'TOTAL') AS label, count(*) AS gold, count(*) FILTER (outcome = 'hit') AS hit, count(*) FILTER (outcome = 'hit_mislabel') AS hit_mislabel,
  count(*) FILTER (outcome = 'miss') AS miss,
  round(count(*) FILTER (outcome = 'hit') / count(*)::DOUBLE, 4) AS recall_label, round(count(*) FILTER (outcome <> 'miss') / count(*)::DOUBLE, 4) AS recall_covered
  FROM ({_OUTCOMES}) o GROUP BY ROLLUP (label)"""))
def recall_by_label(spark, sf_dir):
    return evaluate.recall(evaluate.span_outcomes(*gold_and_predicted(spark, sf_dir), ["page_id"]))


_FALSE = f"""SELECT page_id, label, start, "end", round(cov, 6)::DOUBLE AS coverage FROM (SELECT x.page_id, x.label, x.start, x."end", avg(on_gold::INT) AS cov FROM (
    SELECT p.page_id, p.label, p.start, p."end", c, bool_or(e.gs IS NOT NULL) AS on_gold FROM (SELECT *, unnest(range(start, "end")) AS c FROM ({_PREDICTED}) q) p
  LEFT JOIN ({_GOLD_EVAL}) e ON e.page_id = p.page_id AND gs <= c AND c < ge
    GROUP BY p.page_id, p.label, p.start, p."end", c) x GROUP BY ALL) y WHERE cov < 0.3"""


@query(fixtures.duck(_FALSE))
def false_positives(spark, sf_dir):
    return evaluate.false_positives(*gold_and_predicted(spark, sf_dir), ["page_id"]).withColumn("coverage", F.round("coverage", 6))


@query(fixtures.duck(f"SELECT label, count(*) AS n FROM ({_FALSE}) f GROUP BY label"))
def false_positives_by_label(spark, sf_dir):
    return evaluate.false_by_label(evaluate.false_positives(*gold_and_predicted(spark, sf_dir), ["page_id"]))


# Gold rectangles of ten by ten and boxes over them; SQL counts the whole pixels.
_RECTS = "SELECT note_id, CAST(0 AS DOUBLE) AS gx0, CAST(0 AS DOUBLE) AS gy0, CAST(10 AS DOUBLE) AS gx1, CAST(10 AS DOUBLE) AS gy1, CASE WHEN note_id % 2 = 0 THEN 'redact' ELSE 'review' END AS expect FROM vals"
_OVER = " UNION ALL ".join(f"SELECT note_id, CAST({a} AS DOUBLE) AS x0, CAST({b} AS DOUBLE) AS y0, CAST({c} AS DOUBLE) AS x1, CAST({d} AS DOUBLE) AS y1 FROM vals WHERE note_id % 5 <> 4" for a, b, c, d in (("note_id % 7", "-3", "note_id % 7 + 5", "note_id % 11"), ("-2", "note_id % 6", "note_id % 9", "12"), ("3", "note_id % 4 + 1", "8", "note_id % 4 + 4")))
_PIXELS = f"""SELECT r.note_id, r.expect, avg(hit::INT) AS cov FROM ({_RECTS}) r JOIN (SELECT p.note_id, x, y, bool_or(b.x0 IS NOT NULL) AS hit
  FROM (SELECT note_id, unnest(range(100)) // 10 AS x, unnest(range(100)) % 10 AS y FROM vals) p
    LEFT JOIN ({_OVER}) b ON b.note_id = p.note_id AND b.x0 <= x AND x < b.x1 AND b.y0 <= y AND y < b.y1 GROUP BY p.note_id, x, y) h ON h.note_id = r.note_id
  GROUP BY ALL"""


@query(fixtures.duck(f"""SELECT note_id, expect, round(cov, 6)::DOUBLE AS coverage, CASE WHEN cov >= CASE expect WHEN 'redact' THEN 0.8 ELSE 0.3 END THEN 'hit' ELSE 'miss' END AS outcome
  FROM ({_PIXELS}) c"""))
def region_coverage(spark, sf_dir):
    rects = fixtures.sql_over_keys(spark, sf_dir, _RECTS)
    pairs = rects.join(fixtures.sql_over_keys(spark, sf_dir, _OVER), "note_id", "left")
    out = evaluate.region_outcomes(evaluate.rect_coverage(pairs, ["note_id", "expect"]))
    return out.select("note_id", "expect", F.round("coverage", 6).alias("coverage"), "outcome")


@query(fixtures.duck("""SELECT CAST(note_id AS STRING) AS key, CASE WHEN note_id % 4 = 0 THEN 'hit' ELSE 'miss' END AS old,
  CASE WHEN note_id % 4 = 0 THEN 'miss' ELSE 'hit_mislabel' END AS new, CASE WHEN note_id % 4 = 0 THEN 'regression' ELSE 'fixed' END AS change FROM vals
  WHERE note_id % 4 IN (0, 1) AND note_id % 3 > 0"""))
def baseline_delta(spark, sf_dir):
    base = "SELECT CAST(note_id AS STRING) AS key, {} AS outcome FROM vals WHERE note_id % 3 {}"
    old = fixtures.sql_over_keys(spark, sf_dir, base.format("CASE WHEN note_id % 4 = 1 THEN 'miss' ELSE 'hit' END", "> 0"))
    new = fixtures.sql_over_keys(spark, sf_dir, base.format("CASE note_id % 4 WHEN 0 THEN 'miss' WHEN 1 THEN 'hit_mislabel' ELSE 'hit' END", ">= 0"))
    return evaluate.delta(old, new)


@query(fixtures.duck("SELECT note_id, note_id % 3 <> 2 AS found FROM vals"))
def fuzzy_digits(spark, sf_dir):
    # one changed digit is found, three are not
    rows = fixtures.sql_over_keys(spark, sf_dir, "SELECT note_id, 'n. ' || cns || ' fim' AS text, CASE note_id % 3 WHEN 0 THEN cns WHEN 1 THEN substr(cns, 1, 14) || CAST((CAST(substr(cns, 15, 1) AS INT) + 1) % 10 AS STRING) ELSE '999' || substr(cns, 4) END AS value FROM vals").repartition("note_id")
    return rows.select("note_id", evaluate.fuzzy_contains(F.col("text"), F.col("value")).alias("found"))


_PAGES = "SELECT doc_id, CAST(600 + doc_id % 900 AS INT) AS width, CAST(900 AS INT) AS height, text AS txt, (doc_id % 100) / 100.0 AS confidence FROM documents"


@query(f"""WITH p AS ({_PAGES}), q AS (SELECT doc_id, length(regexp_replace(txt, '\\s', '', 'g')) AS chars,
  round(confidence::DOUBLE, 2) AS confidence, least(width, height) AS min_side FROM p)
SELECT doc_id, chars, confidence, min_side, concat_ws(',', CASE WHEN min_side < 800 THEN 'small' END,
  CASE WHEN chars < 20 THEN 'little_text' WHEN confidence < 0.65 THEN 'low_confidence' END) AS reasons FROM q""")
def quality_gate(spark, sf_dir):
    read(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    pages = spark.sql(_PAGES).withColumn("confidence", F.col("confidence").cast("double"))
    out = layout.quality_gate(pages.select("doc_id", "width", "height"), pages.select("doc_id", "txt", "confidence"), ["doc_id"])
    return out.select("doc_id", "chars", "confidence", "min_side", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT substr(sha256('in/' || page_id || '.' || CASE page_id % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'PDF' ELSE 'doc' END), 1, 24) AS doc_key, sha256(html) AS sha256, octet_length(encode(html))::BIGINT AS n_bytes, CASE WHEN page_id % 3 = 2 THEN 'unsupported' ELSE 'pending' END AS status FROM pages""")
def batch_inventory(spark, sf_dir):
    name = F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit("."), F.element_at(F.array(F.lit("txt"), F.lit("PDF"), F.lit("doc")), (F.col("page_id") % 3 + 1).cast("int")))
    return batch.inventory(read(spark, sf_dir, "pages").select(name.alias("relpath"), F.col("html").cast("binary").alias("content"))).select("doc_key", "sha256", "n_bytes", "status")


@query("SELECT sha256(CAST(page_id AS VARCHAR)) AS doc_key, CAST(page_id % 5 AS INT) AS unit FROM pages WHERE page_id % 4 <> 0 OR page_id % 8 = 0")
def batch_resume(spark, sf_dir):
    units = read(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("page_id").cast("string"), 256).alias("doc_key"), (F.col("page_id") % 5).cast("int").alias("unit"), F.sha2("html", 256).alias("sha256"))
    # every fourth unit is done, but the content of every second of those has changed since
    ledger = units.where("page_id % 4 = 0").withColumn("sha256", F.when(F.col("page_id") % 8 == 0, "old").otherwise(F.col("sha256"))).withColumn("status", F.lit("done")).withColumn("signature", F.lit("s1")).drop("page_id")
    return batch.pending(units.drop("page_id"), ledger, "s1").select("doc_key", "unit")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{labels.COLOUR.get(k, labels.DEFAULT_COLOUR)}', '{v}')" for k, v in labels.PLACEHOLDER.items()) + ") t(label, colour, placeholder)")
def label_dimension(spark, sf_dir):
    return labels.dimension(spark)


# The events' own kinds are in no table of labels; every user stands for a label of a model, some of them unknown.
_RAW = "SELECT DISTINCT CASE user_id % 4 WHEN 0 THEN upper(event_type) ELSE {pick} END AS raw FROM events"
_RAW_LABELS = [*labels.REMAP, "UNKNOWN_A", "UNKNOWN_B"]


@query(
    "SELECT raw, coalesce(target, raw) AS label FROM (" + _RAW.format(pick="([" + ", ".join(f"'{k}'" for k in _RAW_LABELS) + f"])[(user_id % {len(_RAW_LABELS)} + 1)::BIGINT]") + ") e LEFT JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in labels.REMAP.items())
    + ") t(k, target) ON raw = k"
)
def label_remap(spark, sf_dir):
    read(spark, sf_dir, "events").createOrReplaceTempView("events")
    raw = spark.sql(_RAW.format(pick="element_at(array(" + ", ".join(f"'{k}'" for k in _RAW_LABELS) + f"), CAST(user_id % {len(_RAW_LABELS)} + 1 AS INT))"))
    return raw.select("raw", labels.remap(F.col("raw")).alias("label"))


@query("""SELECT c_custkey, CASE WHEN length(w) <= 4 THEN repeat('*', length(w)) ELSE left(w, 2) || repeat('*', length(w) - 4) || right(w, 2) END AS masked
  FROM (SELECT c_custkey, substr(c_name, 1, (c_custkey % 18 + 1)::BIGINT) AS w FROM customer)""")
def mask_text(spark, sf_dir):
    w = read(spark, sf_dir, "customer").select("c_custkey", F.substring("c_name", F.lit(1), (F.col("c_custkey") % 18 + 1).cast("int")).alias("w"))
    return w.select("c_custkey", tx.mask(F.col("w")).alias("masked"))


@query("""SELECT conv_id, CASE WHEN count(*) = 1 THEN max(text) ELSE string_agg('--- página ' || (i + 1) || ' ---' || chr(10) || text, chr(10) || chr(10)
  ORDER BY i, text) END AS text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS i FROM conversations)
  GROUP BY conv_id""")
def join_pages(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    pages = read(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("redacted"), (F.row_number().over(order) - 1).alias("page_index"))
    return batch.join_pages(pages, "conv_id")


@query(fixtures.duck("""SELECT note_id, email AS value, 'EMAIL' AS label, true AS located FROM vals UNION ALL SELECT note_id, person AS value, 'ID' AS label, true AS located FROM vals
  UNION ALL SELECT note_id, 'nada disso' AS value, 'ID' AS label, false AS located FROM vals"""))
def suggestions(spark, sf_dir):
    rows = fixtures.sql_over_keys(spark, sf_dir, "SELECT note_id, email AS value, 'email' AS label FROM vals UNION ALL SELECT note_id, replace(person, ' ', '  ') AS value, 'something' AS label FROM vals UNION ALL SELECT note_id, 'nada disso' AS value, 'x' AS label FROM vals UNION ALL SELECT note_id, 'a' AS value, 'x' AS label FROM vals")
    out = seams.suggested(fixtures.notes(spark, sf_dir), rows, "note_id")
    return out.select("note_id", F.replace("value", F.lit("  "), F.lit(" ")).alias("value"), "label", "located").distinct()


@query(fixtures.duck("SELECT note_id, 'PERSON' AS label, 2 AS start, 6 AS \"end\", 0.9::DOUBLE AS score FROM vals WHERE note_id % 3 = 0"))
def model_normalise(spark, sf_dir):
    kinds = F.element_at(F.array(F.lit("b-FIRSTNAME"), F.lit("LABEL_3"), F.lit("AMOUNT")), (F.col("note_id") % 3 + 1).cast("int"))
    raw = F.struct(kinds.alias("entity_group"), F.lit(0.9).alias("score"), F.lit(2).alias("start"), F.lit(6).alias("end"), F.lit("w").alias("word"), F.lit(0).alias("chunk_offset"))
    rows = fixtures.sql_over_keys(spark, sf_dir, "SELECT note_id FROM vals").select("note_id", pipeline.normal_model_spans(raw, 0.15).alias("e"))
    return rows.where("e is not null").select("note_id", "e.label", "e.start", "e.end", "e.score")
