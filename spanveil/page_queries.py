"""Queries of pages, replies, batches and what goes out, over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions import text as tx
from spanveil.operators import evaluate, layout, outputs, seams
from spanveil.plans import batch, pipeline
from spanveil.queries import flat, query, read
from spanveil.sources import markers, readers

def _words(spark, sf_dir) -> DataFrame:
    """Words of the turns as a recogniser's table would have them, right to left, some of them blank or of another level."""
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id"), F.col("turn").alias("par"), F.posexplode(F.split("text", " ")).alias("i", "text"))
    return turns.select(
        "conv_id", (F.when(F.col("i") % 11 == 10, 4).otherwise(5)).alias("level"), F.lit(1).alias("block"), "par", F.lit(1).alias("line"), (F.col("i") * 10).alias("left"), (F.col("par") * 20 + F.col("i") % 3).cast("int").alias("top"),
        F.lit(8).alias("width"), F.lit(12).alias("height"), (F.col("i") * 7 % 101 - 1).cast("double").alias("conf"), "text", (F.col("par") * 100_000 - F.col("i")).cast("long").alias("row"),
    )


_WORD_SQL = """SELECT conv_id, turn AS par, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations"""


@query(f"""SELECT conv_id, par, string_agg(trim(w), ' ' ORDER BY i) AS txt, min(i * 10)::DOUBLE AS x0, min(par * 20 + i % 3)::DOUBLE AS y0, max(i * 10 + 8)::DOUBLE AS x1,
  max(par * 20 + i % 3 + 12)::DOUBLE AS y1,
  round(avg(greatest(i * 7 % 101 - 1, 0) / 100.0), 6)::DOUBLE AS confidence, (sum(length(trim(w))) + count(*) - 1)::INT AS last_word_end FROM ({_WORD_SQL}) t
  WHERE i % 11 <> 10 AND trim(w) <> '' GROUP BY conv_id, par""")
def ocr_tsv_lines(spark, sf_dir):
    words = _words(spark, sf_dir)
    out = layout.tsv_lines(words, ["conv_id"], keep=["par"])
    return out.select("conv_id", "par", "txt", "x0", "y0", "x1", "y1", F.round("confidence", 6).alias("confidence"), F.element_at("words", -1)["b"].alias("last_word_end"))


# A detector's output: every second one in a list a page, each with entries that are malformed.
@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END::INT AS line_idx, 'linha "' || turn || '"' AS txt, turn::DOUBLE AS x0, 2::DOUBLE AS y0, (turn + 50)::DOUBLE AS x1, 12::DOUBLE AS y1, (turn % 10) / 10.0::DOUBLE AS confidence FROM conversations""")
def ocr_detections(spark, sf_dir):
    t = F.col("turn").cast("string")
    box = F.concat(F.lit("[["), t, F.lit(",2],["), (F.col("turn") + 50).cast("string"), F.lit(",2],["), (F.col("turn") + 50).cast("string"), F.lit(",12],["), t, F.lit(",12]]"))
    good = F.concat(F.lit("["), box, F.lit(',["linha \\"'), t, F.lit('\\"",'), (F.col("turn") % 10 / 10.0).cast("string"), F.lit("]]"))
    bare = F.concat(F.lit("["), good, F.lit(",null,[],[[[1,2]],[\"x\"]]]"))
    wrapped = F.concat(F.lit("[[null,"), good, F.lit(",[[[\"a\",2]],[\"x\",0.5]]]]"))
    wrapped = F.concat(F.lit("[["), F.lit("[[[0,0]],[\"no score\",\"high\"]],"), good, F.lit("]]"))
    raw = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, bare).otherwise(wrapped).alias("json"))
    out = readers.detections(raw, ["conv_id", "turn"])
    return out.select("conv_id", "turn", "line_idx", "txt", "x0", "y0", "x1", "y1", "confidence")


_CONF = "((turn * 37 + conv_id * 11) % 60 + 40) / 100.0"


@query(f"""SELECT conv_id, min({_CONF}) >= 0.65 AS accepted FROM conversations GROUP BY conv_id UNION ALL SELECT DISTINCT -conv_id - 1 AS conv_id, false AS accepted
  FROM conversations""")
def any_line_gate(spark, sf_dir):
    lines = read(spark, sf_dir, "conversations").select("conv_id", F.expr(_CONF).cast("double").alias("confidence"))
    pages = lines.select("conv_id").distinct()
    return layout.any_line_gate(pages.unionByName(pages.select((-F.col("conv_id") - 1).alias("conv_id"))), lines, ["conv_id"])


# Two spans a template, one of them optional and hard.
@query("""WITH c AS (SELECT c_custkey AS k, c_name AS name, c_custkey::VARCHAR AS num FROM customer)
SELECT k, 4 AS start, (4 + length(name))::INT AS "end", 'PATIENT_NAME' AS label, 'NAME' AS grp, name AS txt, false AS optional, 'normal' AS difficulty FROM c
UNION ALL SELECT k, (7 + length(name))::INT, (7 + length(name) + length(num))::INT, 'CPF', 'DOC_NUM', num, true, 'hard' FROM c""")
def gold_markers(spark, sf_dir):
    template = F.concat(F.lit("Pac {PATIENT_NAME|"), "c_name", F.lit("} n {CPF?#hard|"), F.col("c_custkey").cast("string"), F.lit("} fim"))
    out = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.inline(markers.gold_spans(template)))
    return out.withColumnRenamed("group", "grp")


@query("SELECT c_custkey AS k, 'Pac ' || c_name || ' n ' || c_custkey || ' fim' AS text FROM customer")
def gold_marker_texts(spark, sf_dir):
    template = F.concat(F.lit("Pac {PATIENT_NAME|"), "c_name", F.lit("} n {CPF?#hard|"), F.col("c_custkey").cast("string"), F.lit("} fim"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), markers.clean(template).alias("text"))


# A level line of three words of five characters, ten pixels a character; the span touches the second word.
@query("""SELECT c_custkey AS k, round(60 - 0.6 * 50 / 5, 6)::DOUBLE AS x0, round(k0 - 0.08 * 20, 6)::DOUBLE AS y0, round(110 + 0.6 * 50 / 5, 6)::DOUBLE AS x1,
  round(k0 + 20 + 0.08 * 20, 6)::DOUBLE AS y1 FROM (SELECT c_custkey, (c_custkey % 100)::DOUBLE AS k0 FROM customer)""")
def word_boxes(spark, sf_dir):
    y = (F.col("c_custkey") % 100).cast("double")
    words = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(a + 5).alias("b"), F.lit(a * 10.0).alias("x0"), F.lit(a * 10.0 + 50).alias("x1")) for a in (0, 6, 12)])
    line = F.struct(F.lit("alpha bravo delta").alias("txt"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(170.0).alias("x1"), (y + 20).alias("y1"), F.lit(100).alias("char_start"), F.lit(117).alias("char_end"), words.alias("words"))
    at = (F.col("c_custkey") % 4).cast("int")
    box = layout.line_box(line, 106 + at, F.lit(111))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), box.alias("b")).select("k", *[F.round(F.col(f"b.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


# A line of ten wide small letters, turned: it rises by k % 5 tenths of its length; the span is its second half.
@query("""SELECT k, round(tx, 6)::DOUBLE AS top_x, round(ty, 6)::DOUBLE AS top_y, round(tx + 20 * h * 1.16, 6)::DOUBLE AS base_x, round(ty + 20 * 1.16, 6)::DOUBLE AS base_y
  FROM (
SELECT c_custkey AS k, h, 100 * t - 20 * h * 0.08 AS tx, 10 + 10 * (c_custkey % 5) * t - 20 * 0.08 AS ty
  FROM (SELECT c_custkey, (c_custkey % 3) / 10.0 AS h, greatest(0, 0.5 - 0.06) AS t FROM customer))""")
def turned_line_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    h, rise = (k % 3) / 10.0, 10.0 * (k % 5)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    quad = F.array(point(F.lit(0.0), F.lit(10.0)), point(F.lit(100.0), 10 + rise), point(100 + 20 * h, 30 + rise), point(20 * h, F.lit(30.0)))
    line = F.struct(F.lit("aeosnaeosn").alias("txt"), quad.alias("quad"), F.lit(0).alias("char_start"), F.lit(10).alias("char_end"))
    q = read(spark, sf_dir, "customer").select(k.alias("k"), layout.line_quad(line, F.lit(5), F.lit(10)).alias("q"))
    corner = lambda i, c: F.round(F.element_at("q", i)[c], 6)
    return q.select("k", corner(1, "x").alias("top_x"), corner(1, "y").alias("top_y"), corner(4, "x").alias("base_x"), corner(4, "y").alias("base_y"))


@query("""SELECT c_custkey AS k, abs(x2 - x1) >= 8 AND abs(y2 - y1) >= 8 AS drawn,
  CASE WHEN abs(x2 - x1) >= 8 AND abs(y2 - y1) >= 8 THEN greatest(0, least(100, least(x1, x2)))::DOUBLE END AS x0,
  CASE WHEN abs(x2 - x1) >= 8 AND abs(y2 - y1) >= 8 THEN greatest(0, least(80, greatest(y1, y2)))::DOUBLE END AS y1
FROM (SELECT c_custkey, c_custkey % 31 - 5 AS x1, c_custkey % 17 AS x2, c_custkey % 23 AS y1, c_custkey % 97 AS y2 FROM customer)""")
def drawn_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    out = read(spark, sf_dir, "customer").select(k.alias("k"), layout.drawn_box(k % 31 - 5, k % 23, k % 17, k % 97, F.lit(100), F.lit(80)).alias("b"))
    return out.select("k", F.col("b").isNotNull().alias("drawn"), F.col("b.x0").alias("x0"), F.col("b.y1").alias("y1"))


@query("SELECT c_custkey AS k, c_custkey % 4 < 2 AS level FROM customer")
def upright_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lean = (k % 4) * 0.5
    quad = F.array(point(F.lit(0), F.lit(0)), point(F.lit(50), lean), point(F.lit(50), F.lit(20)), point(F.lit(0), F.lit(20)))
    return read(spark, sf_dir, "customer").select(k.alias("k"), layout.upright(quad).isNotNull().alias("level"))


@query("""SELECT c_custkey AS k, round(least(x, -x) * abs(cos(r)) - y * abs(sin(r)) + 50, 4)::DOUBLE AS x0, round(x * abs(cos(r)) + y * abs(sin(r)) + 50, 4)::DOUBLE AS x1
  FROM (SELECT c_custkey, (10 + c_custkey % 20)::DOUBLE AS x, (5 + c_custkey % 7)::DOUBLE AS y, radians(c_custkey % 360) AS r FROM customer)""")
def rotated_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = (10 + k % 20).cast("double"), (5 + k % 7).cast("double")
    box = F.struct((50 - x).alias("x0"), (40 - y).alias("y0"), (50 + x).alias("x1"), (40 + y).alias("y1"))
    out = read(spark, sf_dir, "customer").select(k.alias("k"), layout.rotate(box, (k % 360).cast("double"), F.lit(50.0), F.lit(40.0)).alias("b"))
    return out.select("k", F.round("b.x0", 4).alias("x0"), F.round("b.x1", 4).alias("x1"))


@query("""SELECT c_custkey AS k, greatest(0, floor(a))::INT AS x0, least(100, ceil(b))::INT AS x1
  FROM (SELECT c_custkey, c_custkey % 50 / 4.0 - 3 AS a, c_custkey % 50 / 3.0 + 90 AS b FROM customer)""")
def outward_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    box = F.struct((k % 50 / 4.0 - 3).alias("x0"), F.lit(0.0).alias("y0"), (k % 50 / 3.0 + 90).alias("x1"), F.lit(1.0).alias("y1"))
    out = read(spark, sf_dir, "customer").select(k.alias("k"), layout.outward(box, F.lit(100), F.lit(100)).alias("b"))
    return out.select("k", "b.x0", "b.x1")


_ENTITIES = "SELECT conv_id AS page_id, turn AS idx, CASE turn % 3 WHEN 0 THEN 'cpf' WHEN 1 THEN 'CPF' ELSE 'Person' END AS label, turn % 5 = 4 AS unmapped, turn * 7 % 40 AS y, turn * 11 % 50 AS x FROM conversations"


def _entities(spark, sf_dir) -> DataFrame:
    read(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return spark.sql(_ENTITIES)


@query(f"""SELECT page_id, upper(label) AS label, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS members, row_number() OVER (PARTITION BY page_id
  ORDER BY count(*) DESC, min(idx)) AS rank FROM ({_ENTITIES}) e WHERE NOT unmapped GROUP BY page_id, upper(label)""")
def display_groups(spark, sf_dir):
    out = layout.display_groups(_entities(spark, sf_dir).withColumnRenamed("idx", "index"), ["page_id"])
    return out.select("page_id", "label", "n", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("members"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT page_id, idx, row_number() OVER (PARTITION BY page_id ORDER BY unmapped, floor(y / 6.0), x, idx) AS rank FROM ({_ENTITIES}) e")
def visual_order(spark, sf_dir):
    e = _entities(spark, sf_dir).select("page_id", "idx", "unmapped", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("idx").alias("start"))
    return layout.visual_order(e, ["page_id"]).select("page_id", "idx", F.col("rank").cast("long").alias("rank"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'unsupported_media' WHEN size = 0 THEN 'empty' WHEN size > 20971520 THEN 'too_large' WHEN pages = 0 THEN 'no_pages' WHEN pages > 50 THEN 'too_many_pages' END AS reason
FROM (SELECT page_id, CASE page_id % 7 WHEN 1 THEN 0 WHEN 2 THEN 20971521 ELSE 20971520 END AS size, page_id % 53 AS pages FROM pages)""")
def admission(spark, sf_dir):
    k = F.col("page_id")
    media = F.element_at(F.array(*[F.lit(m) for m in (*batch.MEDIA, "text/html")]), (k % 5 + 1).cast("int"))
    size = F.when(k % 7 == 1, 0).when(k % 7 == 2, 20 * 1024 * 1024 + 1).otherwise(20 * 1024 * 1024)
    return read(spark, sf_dir, "pages").select("page_id", batch.admission(media, size, k % 53).alias("reason"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'laudo-' || page_id || '.png' ELSE 'doc_2024-05-06_' || page_id || '.png' END AS name FROM pages")
def neutral_names(spark, sf_dir):
    k = F.col("page_id").cast("string")
    template = F.when(F.col("page_id") % 3 == 0, "laudo-{id}.{ext}").when(F.col("page_id") % 3 == 1, "  ")
    return read(spark, sf_dir, "pages").select("page_id", batch.neutral_name(template, F.lit("doc"), F.lit("2024-05-06"), k, F.lit("png")).alias("name"))


@query("""SELECT lang, count(*) AS units, sum(n_chars)::BIGINT AS chars, sum(doc_id % 3)::BIGINT AS substitutions,
  CASE WHEN bool_or(doc_id % 50 = 7) THEN 'pending' ELSE 'review' END AS state FROM documents GROUP BY lang""")
def batch_totals(spark, sf_dir):
    units = read(spark, sf_dir, "documents").select("lang", F.col("n_chars").alias("chars"), (F.col("doc_id") % 3).alias("n_spans"), F.when(F.col("doc_id") % 50 == 7, "failed").otherwise("done").alias("status"))
    return batch.totals(units, ["lang"])


@query(f"""SELECT page_id, idx AS entity_index, label FROM ({_ENTITIES}) e WHERE idx % 4 <> 1 UNION ALL SELECT page_id, NULL, 'MANUAL' FROM (SELECT DISTINCT page_id
  FROM ({_ENTITIES}) d) m""")
def user_overrides(spark, sf_dir):
    e = _entities(spark, sf_dir).select("page_id", F.col("idx").alias("entity_index"), "label")
    left_out = e.where("entity_index % 4 = 1")
    manual = e.select("page_id").distinct().withColumn("label", F.lit("MANUAL"))
    return seams.apply_overrides(e, left_out, manual, ["page_id"])


# Replies of six kinds, three of which must not be read as "nothing found".
@query("""SELECT c_custkey AS k, [NULL, 'bad_shape', 'no_json', 'bad_json', NULL, NULL][(c_custkey % 6 + 1)::BIGINT] AS error, [1, NULL, NULL, NULL, 0, 2][(c_custkey % 6 + 1)::BIGINT]::INT AS n,
CASE c_custkey % 6 WHEN 0 THEN 'CPF:' || c_name WHEN 5 THEN 'ID:x,ID:y' WHEN 4 THEN '' END AS found FROM customer""")
def model_replies(spark, sf_dir):
    kinds = [
        F.concat(F.lit('Sure: {"entities": [{"text": "'), "c_name", F.lit('", "label": "cpf"}, {"text": 3}, {"label": "x"}, "no"]} ok')),
        F.lit('{"entities": {"text": "a"}}'), F.lit("nothing here"), F.lit('{"entities": [}'), F.lit('{"entities": []}'), F.lit('{"entities": [{"text": "x"}, {"text": "y", "label": "id"}]}'),
    ]
    out = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), seams.parse_response(F.element_at(F.array(*kinds), (F.col("c_custkey") % 6 + 1).cast("int"))).alias("r"))
    found = F.array_join(F.transform("r.entities", lambda e: F.concat(e["label"], F.lit(":"), e["text"])), ",")
    return out.select("k", "r.error", F.when(F.col("r.entities").isNotNull(), F.size("r.entities")).alias("n"), found.alias("found"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'detector_absent' WHEN c_custkey % 3 <> 0 THEN 'ocr_lost' WHEN c_custkey % 5 <> 0 THEN 'model_miss' WHEN c_custkey % 7 <> 0 THEN 'mapping_loss' END AS cause FROM customer""")
def miss_causes(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("k"), evaluate.miss_cause(k % 3 == 0, k % 5 == 0, k % 7 == 0, k % 2 == 0).alias("cause"))


_PAGE_CHARS = "SELECT conv_id, turn AS page_index, CASE WHEN turn % 4 = 3 THEN 5 ELSE 40 END AS chars FROM conversations"


@query(f"""WITH p AS ({_PAGE_CHARS}), k AS (SELECT page_id, count(*) FILTER (upper(label) = 'CPF') AS cpf, count(*) AS n FROM ({_ENTITIES}) e WHERE page_id % 3 > 0
  GROUP BY page_id)
SELECT p.conv_id, count(*) AS pages, coalesce(any_value(n), 0) AS covered, any_value(cpf) AS cpf,
  CASE WHEN count(*) > 1 THEN count(*) FILTER (chars < 20) ELSE 0 END + CASE WHEN any_value(n) IS NULL THEN 1 ELSE 0 END AS warnings FROM p LEFT
  JOIN k ON k.page_id = p.conv_id GROUP BY p.conv_id""")
def summaries(spark, sf_dir):
    read(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    e = _entities(spark, sf_dir).where("page_id % 3 > 0").select(F.col("page_id").alias("conv_id"), F.concat(F.lit("["), F.upper("label"), F.lit("]")).alias("redacted"))
    out = outputs.summary(spark.sql(_PAGE_CHARS), e, "conv_id")
    return out.select("conv_id", "pages", "covered", F.try_element_at("by_placeholder", F.lit("[CPF]")).alias("cpf"), F.size("warnings").cast("long").alias("warnings"))


# A stand-in model that knows names in mixed case only: lines in capitals are found in its second look.
def title_case_model(chunks: DataFrame) -> DataFrame:
    spans = tx.matches(F.col("chunk"), r"(?U)\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+")
    return chunks.select("at", F.inline(spans)).select("at", F.lit("B-PERSON").alias("entity_group"), F.lit(0.8).alias("score"), "start", "end")


_CAPS = "SELECT c_custkey AS k, 'exame sem achados' || chr(10) || CASE c_custkey % 3 WHEN 0 THEN 'ANTONIA RIBEIRO' WHEN 1 THEN 'BENTO CARDOSO LIMA' ELSE 'Celia Duarte' END || chr(10) || 'fim de pagina' AS text FROM customer"


@query("""SELECT c_custkey AS k, 18 AS start, (18 + [15, 18, 12][(c_custkey % 3 + 1)::BIGINT])::INT AS "end", 'PERSON' AS label, ['ANTONIA RIBEIRO', 'BENTO CARDOSO LIMA', 'Celia Duarte'][(c_custkey % 3 + 1)::BIGINT] AS txt FROM customer""")
def caps_retry(spark, sf_dir):
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    texts = spark.sql(_CAPS).repartition("k")
    return flat(pipeline.detect_with(texts, "k", title_case_model), "k").select("k", "start", "end", "label", "txt")


# What a language model suggests enters the same steps as a model's spans.
@query("""SELECT c_custkey AS k, x.start::INT AS start, (x.start + length(x.txt))::INT AS "end", x.label, x.txt
  FROM customer, (VALUES (6, 'INSURANCE_ID', 'AB-77'), (24, 'INSURANCE_ID', 'AB-77'), (41, 'PERSON', 'Rita')) x(start, label, txt) WHERE c_custkey % 2 = 0""")
def detect_with_suggestions(spark, sf_dir):
    texts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("ficha AB-77 aberta, ver AB-77; falou com Rita").alias("text")).repartition("k")
    rows = texts.where("k % 2 = 0").select("k", F.inline(F.array(*[F.struct(F.lit(v).alias("value"), F.lit(n).alias("label")) for v, n in (("AB-77", "insurance_id"), ("Rita", "person"), ("nowhere", "person"))])))
    return flat(pipeline.detect_with(texts, "k", suggestions=rows), "k").select("k", "start", "end", "label", "txt")
