import json

import pytest
from pyspark.sql import functions as F

from spanveil.config import EngineConfig
from spanveil.operators import evaluate, layout, rules, seams
from spanveil.page_queries import title_case_model
from spanveil.plans import batch, evaluation, pipeline
from spanveil.sources import fixtures, markers, readers


def gold_page(text, spans, optional=()):
    made = lambda xs: [{"id": f"s{i}", "label": n, "group": g, "text": text[a:b], "char_start": a, "char_end": b} for i, (n, g, a, b) in enumerate(xs)]
    return {"width": 10, "height": 10, "canonical_text": text, "spans": made(spans), "optional_spans": made(optional), "regions": []}


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gold")
    text = "Nasc 01/02/1980 CPF 529.982.247-25 fim 12.345 ok"
    page = gold_page(text, [("DATE_OF_BIRTH", "DATE", 5, 15), ("CPF", "DOC_NUM", 20, 34)], [("NUMERO", "DOC_NUM", 39, 45)])
    (folder / "a.json").write_text(json.dumps({"doc_id": "a", "doc_type": "x", "schema_version": 1, "pages": [page, gold_page("Tel (11) 98888-7777", [("PHONE", "CONTACT", 4, 19)])]}))
    return readers.gold(spark, str(folder))


def test_text_level(spark, pages):
    # 7 of 10 characters of a date are enough, of a number they are not; the second of two that overlap is no false positive for the first one's sake
    rows = [("a", 0, 5, 12, "DATE"), ("a", 0, 20, 30, "BR_CPF"), ("a", 0, 39, 45, "ID"), ("a", 0, 40, 45, "ID"), ("a", 0, 0, 4, "PERSON"), ("a", 1, 4, 19, "DATE")]
    spans = spark.createDataFrame(rows, "doc_id string, page_index int, start int, end int, label string")
    level = evaluation.text_level(pages, spans=spans)
    assert {r.key: (r.outcome, r.cause) for r in level.outcomes.collect()} == {"a#p0#s0": ("hit", ""), "a#p0#s1": ("miss", "model_miss"), "a#p1#s0": ("hit_mislabel", "")}
    assert [(r.label, r.text) for r in level.false.collect()] == [("PERSON", "Nasc")]
    assert [(r.label, r.gold, r.miss) for r in level.recall.collect()] == [("CPF", 1, 1), ("DATE_OF_BIRTH", 1, 0), ("PHONE", 1, 0), ("TOTAL", 3, 1)]
    assert [(r.label, r.n) for r in level.false_by_label.collect()] == [("PERSON", 1)]
    old = spark.createDataFrame([("a#p0#s1", "hit"), ("a#p0#s0", "miss"), ("gone", "hit")], "key string, outcome string")
    lines = [r.line for r in evaluation.report(level, old).collect()]
    assert lines[0].startswith("[a] s1 CPF") and "cov=0.71" in lines[0] and lines[-2:] == ["regression a#p0#s1", "fixed a#p0#s0"]
    assert evaluation.exit_status(level, old) == 1 and evaluation.exit_status(level, None) == 0


def test_text_level_of_the_rules(pages):
    level = evaluation.text_level(pages)
    assert {r.key: r.outcome for r in level.outcomes.collect()} == {"a#p0#s0": "hit", "a#p0#s1": "hit", "a#p1#s0": "hit"}
    assert level.false.count() == 0


def test_overlapping_predictions_count_by_span(spark):
    gold = spark.createDataFrame([(1, 0, 15)], "page int, gs int, ge int")
    predicted = spark.createDataFrame([(1, 0, 10, "X"), (1, 1, 10, "X"), (1, 14, 40, "X")], "page int, start int, end int, label string")
    assert [(r.start, r.end) for r in evaluate.false_positives(gold, predicted, ["page"]).collect()] == [(14, 40)]


@pytest.mark.parametrize("text, limit, want", [("aaaa\nbbbb", 8, ["aaaa\n", "bbbb"]), ("aaa\nbbbbb", 8, ["aaa\nbbbb", "b"]), ("x" * 17, 8, ["x" * 8, "x" * 8, "x"]), ("aaaaaaa\nbb", 8, ["aaaaaaa\n", "bb"])])
def test_parts_are_cut_at_the_break_unless_it_lies_in_the_first_half(spark, text, limit, want):
    df = spark.createDataFrame([(1, text)], "k int, text string")
    assert [(r.part, r.part_text) for r in batch.numbered_parts(df, "k", limit).orderBy("part").collect()] == list(enumerate(want, 1))


def test_tsv_files_keep_their_pages(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    row = lambda page, left, conf, text: f"5\t{page}\t1\t1\t1\t1\t{left}\t10\t20\t8\t{conf}\t{text}\n"
    (tmp_path / "a.tsv").write_text(head + row(1, 40, 90, 'dois "x') + row(1, 10, -1, "um") + row(2, 10, 50, "outra"))
    (tmp_path / "b.tsv").write_text(head + row(1, 10, 50, "mais"))
    got = layout.tsv_lines(readers.tsv_words(spark, str(tmp_path)), ["file", "page"]).collect()
    assert sorted((r.file[-5:], r.page, r.txt, r.confidence) for r in got) == [("a.tsv", 1, 'um dois "x', 0.45), ("a.tsv", 2, "outra", 0.5), ("b.tsv", 1, "mais", 0.5)]


def test_markers(spark):
    df = spark.createDataFrame([("😀 {CPF|1} e {DATE?#hard|02/03} fim",), ("sem nada",)], "t string")
    one, two = df.select(markers.clean(F.col("t")).alias("c"), markers.gold_spans(F.col("t")).alias("s")).collect()
    assert one.c == "😀 1 e 02/03 fim" and [(one.c[x.start : x.end], x.label, x.group, x.optional, x.difficulty) for x in one.s] == [("1", "CPF", "DOC_NUM", False, "normal"), ("02/03", "DATE", "DATE", True, "hard")]
    assert two.c == "sem nada" and two.s == []
    with pytest.raises(Exception, match="unknown gold label"):
        spark.createDataFrame([("{NADA|x}",)], "t string").select(markers.gold_spans(F.col("t"))).collect()


def test_rule_with_context(spark):
    rule = rules.Rule("X", r"\d{4}", 50, 0.5, (4, 4), ("X",), context=("senha",))
    need = rules.Rule("X", r"\d{4}", 50, 0.5, (4, 4), ("X",), context=("senha",), context_required=True)
    df = spark.createDataFrame([("SENHA 1234",), ("outro 1234",), ("1234 " + "x" * 20 + " senha",)], "t string")
    assert [[round(e.score, 2) for e in r.s] for r in df.select(rules.rule_spans(F.col("t"), rule).alias("s")).collect()] == [[0.55], [0.5], [0.5]]
    assert [len(r.s) for r in df.select(rules.rule_spans(F.col("t"), need).alias("s")).collect()] == [1, 0, 0]


def test_guards_lose_no_match(spark):
    values = ["529.982.247-25", "52998224725", "11.222.333/0001-81", "11222333000181", "a@b.co", "(11)91234-5678", "11 1234-5678", "crm/sp 1234", "CRM-RJ 654321", "01310-100", "1/2/34", "7 anos", "99ANO", "1.234.567-x", "٣ anos", "nada"]
    df = spark.createDataFrame([(f"x {v} y",) for v in values], "t string")
    for rule in rules.RULES:
        if rule.guard:
            plain = rules.matches(F.col("t"), rule.pattern)
            assert df.where(plain != rules.guarded(F.col("t"), rule)).count() == 0


def test_second_look_can_be_left_out(spark):
    texts = spark.createDataFrame([(1, "exame\nANTONIA RIBEIRO LIMA\nfim"), (2, ""), (3, None)], "k int, text string")
    found = lambda on: {r.k: len(r.spans) for r in pipeline.detect_with(texts, "k", title_case_model, config=EngineConfig(caps_retry=on)).collect()}
    assert found(True) == {1: 1, 2: 0, 3: 0} and found(False) == {1: 0, 2: 0, 3: 0}


def test_replies_fail_closed(spark):
    df = spark.createDataFrame([(None,), ("",), ("{}",), ('{"entities": null}',), ('{"entities": [{"text": "a", "label": null}]}',)], "r string")
    got = [r.p for r in df.select(seams.parse_response(F.col("r")).alias("p")).collect()]
    assert [g.error for g in got] == ["no_json", "no_json", "bad_shape", "bad_shape", None] and got[4].entities[0].text == "a"


def test_corpus_hash(spark):
    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "relpath string, content binary")
    assert readers.corpus_hash(files).first()[0] == readers.corpus_hash(files.orderBy("relpath")).first()[0] != readers.corpus_hash(files.limit(1)).first()[0]


def test_any_weak_line_refuses_the_page(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    lines = spark.createDataFrame([(1, 0.9), (1, 0.64), (2, 0.65)], "p int, confidence double")
    assert {r.p: r.accepted for r in layout.any_line_gate(pages, lines, ["p"]).collect()} == {1: False, 2: True, 3: False}


def test_level_quads_equal_boxes(spark):
    lines = layout.with_offsets(layout.reading_order(fixtures.mock_page(spark), ["page_id"]), ["page_id"]).withColumn("words", F.lit(None).cast("array<struct<a:int,b:int,x0:double,x1:double>>"))
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = lines.withColumn("quad", F.array(point("x0", "y0"), point("x1", "y0"), point("x1", "y1"), point("x0", "y1")))
    line = F.struct("txt", "x0", "y0", "x1", "y1", "char_start", "char_end", "words", "quad")
    out = both.select(layout.line_box(line, F.col("char_start") + 3, F.col("char_start") + 9).alias("b"), layout.line_quad(line, F.col("char_start") + 3, F.col("char_start") + 9).alias("q")).collect()
    for r in out:
        assert [round(v, 6) for v in (r.b.x0, r.b.y0, r.b.x1, r.b.y1)] == [round(v, 6) for v in (r.q[0].x, r.q[0].y, r.q[2].x, r.q[2].y)]
