import hashlib
import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from spanveil import queries
from spanveil.config import EngineConfig
from spanveil.operators import evaluate, layout, seams
from spanveil.plans import batch, chunking, pipeline
from spanveil.sources import fixtures, readers


def test_values_on_window_edges_are_found(spark):
    value = "529.982.247-25"
    text = list("x " * 13_000)
    for at in (11_994, 12_994, 23_994):
        text[at : at + len(value) + 2] = f" {value} "
    text = "".join(text)
    df = spark.createDataFrame([(1, text), (2, "")], "doc int, text string")
    rows = {r.doc: r for r in batch.redact_long(df, "doc").collect()}
    assert rows[1].n_spans == 3 and value not in rows[1].redacted and rows[1].redacted.count("[CPF]") == 3
    assert rows[1].redacted.replace("[CPF]", value) == text and (rows[2].n_spans, rows[2].redacted) == (0, "")


def test_redact_long_reads_all_documents(spark, tmp_path):
    values = {"529.982.247-25": "[CPF]", "ana@mail.example.org": "[EMAIL]"}
    texts, want = {}, {}
    for i in range(6):
        parts = ["x " * (5_990 + i)]
        for value in list(values) * (i % 3):
            parts += [value, " ", "x " * 6_000]
        texts[i] = "".join(parts)
        want[i] = texts[i]
        for value, placeholder in values.items():
            want[i] = want[i].replace(value, placeholder)
    real = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    whole = spark.createDataFrame([(100 + i, t) for i, t in real.items()], "doc_id long, text string")
    for r in pipeline.detect(whole, "text").select("doc_id", pipeline.redact(F.col("text"), F.col("spans")).alias("redacted")).collect():
        want[r.doc_id] = r.redacted
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(whole).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["redact_long"](spark, str(tmp_path)).collect()}
    assert {i: r.redacted_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert [got[i].n_spans for i in texts] == [0, 2, 4, 0, 2, 4] and any(len(t) > 12_000 for t in real.values())


def test_redact_long_of_repeated_and_null_ids_equals_its_sql(spark, tmp_path):
    mail = "ana@mail.example.org"
    rows = [(1, f"um {mail}"), (1, "outro texto sem nada"), (1, f"um {mail}"), (None, f"{mail} x"), (None, f"y {mail}"), (None, None), (2, f"{mail} {'z ' * 12_000} {mail}"), (2, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.QUERIES["redact_long"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, got)) == sorted(map(repr, con.sql(queries.ORACLE["redact_long"]).fetchall()))


@pytest.mark.parametrize("text", ["", "abc", "a\n" * 4000, "x" * 2500, "ab\n" + "x" * 3000, "x" * 600 + "\n" + "y" * 900])
def test_parts(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(batch.parts(F.col("t"), 1000).alias("p")).first().p
    assert "".join(got) == text and all(0 < len(p) <= 1000 for p in got)


def test_chunks_begin_with_the_line_break(spark):
    got = spark.createDataFrame([("aaaa\nbbbb\ncc",)], "t string").select(chunking.chunks(F.col("t"), 7).alias("p")).first().p
    assert [(c.start, c.chunk) for c in got] == [(0, "aaaa"), (4, "\nbbbb"), (9, "\ncc")]


def test_resume_and_signature(spark):
    units = spark.createDataFrame([("d", 0, "h0"), ("d", 1, "h1"), ("d", 2, "h2")], "doc_key string, unit int, sha256 string")
    ledger = spark.createDataFrame([("d", 0, "h0", "done", "s"), ("d", 1, "changed", "done", "s"), ("d", 2, "h2", "failed", "s")], "doc_key string, unit int, sha256 string, status string, signature string")
    assert sorted(r.unit for r in batch.pending(units, ledger, "s").collect()) == [1, 2]
    with pytest.raises(ValueError):
        batch.pending(units, ledger, "other")
    a, b = EngineConfig(), EngineConfig(threshold=0.6)
    assert batch.signature(a, "r", "i") == batch.signature(a, "r", "i") != batch.signature(b, "r", "i")


def test_settings(spark):
    got = EngineConfig.from_env({"SPANVEIL_THRESHOLD": "0.7", "SPANVEIL_MAX_PAGES": "many", "SPANVEIL_MODE": " ", "SPANVEIL_CAPS_RETRY": "0"})
    assert (got.threshold, got.max_pages, got.mode, got.caps_retry) == (0.7, 50, "rules", False)


def docx(parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, lines in parts.items():
            z.writestr(name, f"<w:x {w}>" + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in lines) + "</w:x>")
    return out.getvalue()


def test_docx(spark):
    good = docx({"word/footnotes.xml": ["nota"], "word/document.xml": ["um", "dois"], "word/header1.xml": ["topo"], "word/header2.xml": [" "]})
    rows = readers.docx_units(spark.createDataFrame([("a.docx", good), ("b.docx", b"broken")], "relpath string, content binary")).orderBy("relpath", "unit").collect()
    assert [(r.part, r.text) for r in rows[:3]] == [("word/document.xml", "um\ndois"), ("word/footnotes.xml", "nota"), ("word/header1.xml", "topo")]
    assert rows[3].text is None and rows[3].error == "BadZipFile"


def test_text_files_and_gold(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("﻿olá\nfim".encode())
    assert [r.text for r in readers.text_files(spark, str(tmp_path / "t")).collect()] == ["olá\nfim"]
    page = {"width": 10, "height": 10, "canonical_text": "Ana", "spans": [{"id": "s1", "label": "PATIENT_NAME", "text": "Ana", "char_start": 0, "char_end": 3}], "optional_spans": [], "regions": []}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text(json.dumps({"doc_id": "a", "doc_type": "x", "schema_version": 1, "page": page}))
    (tmp_path / "g/b.json").write_text(json.dumps({"doc_id": "b", "doc_type": "x", "schema_version": 1, "pages": [page, page]}))
    assert sorted((r.doc_id, r.page_index) for r in readers.gold(spark, str(tmp_path / "g")).collect()) == [("a", 0), ("b", 0), ("b", 1)]
    (tmp_path / "g/c.json").write_text(json.dumps({"doc_id": "c", "schema_version": 2, "page": page}))
    with pytest.raises(Exception, match="schema version"):
        readers.gold(spark, str(tmp_path / "g")).collect()


def test_stream_repeats_nothing(spark, tmp_path):
    from spanveil.streaming import ingest

    src, sink, ckpt = (tmp_path / n for n in ("in", "out", "ck"))
    src.mkdir()
    (src / "a.txt").write_text("CPF 529.982.247-25")
    ingest.start(spark, str(src), str(sink), str(ckpt)).awaitTermination()
    (src / "b.txt").write_text("nada")
    ingest.start(spark, str(src), str(sink), str(ckpt)).awaitTermination()
    assert sorted(r.redacted for r in spark.read.parquet(str(sink)).collect()) == ["CPF [CPF]", "nada"]


def test_caps_retry_offsets(spark):
    text = "Laudo normal\nKELI DE SOUZA FRAGA\nx\nANA MARIA LIMA 3"
    texts = spark.createDataFrame([(1, text)], "doc int, text string")
    none = spark.createDataFrame([], "doc int, start int, end int, label string")
    probe = seams.caps_probe(texts, none, "doc")
    rows = probe.orderBy("line_no").collect()
    assert [r.probe for r in rows] == ["Keli De Souza Fraga", "Ana Maria Lima 3"]
    found = spark.createDataFrame([(1, 0, 19, "PERSON"), (1, 20, 34, "PERSON")], "doc int, start int, end int, label string")
    assert sorted(text[r.start : r.end] for r in seams.caps_back(found, probe, "doc").collect()) == ["ANA MARIA LIMA", "KELI DE SOUZA FRAGA"]
    assert seams.caps_probe(texts, spark.createDataFrame([(1, 14, 18, "PERSON")], none.schema), "doc").count() == 1


def test_layout_of_the_mock_page(spark):
    lines = layout.with_offsets(layout.reading_order(fixtures.mock_page(spark), ["page_id"]), ["page_id"])
    got = lines.orderBy("line_no").collect()
    text = "\n".join(fixtures.MOCK_LINES)
    assert [text[r.char_start : r.char_end] for r in got] == list(fixtures.MOCK_LINES)
    spans = spark.createDataFrame([(1, got[1].char_start + 10, got[1].char_end, "PERSON"), (1, 99_000, 99_010, "CPF")], "page_id int, start int, end int, label string")
    boxed = {r.label: r for r in layout.span_boxes(spans, lines.withColumn("words", F.lit(None).cast("array<struct<a:int,b:int,x0:double,x1:double>>")), ["page_id"]).collect()}
    assert boxed["CPF"].unmapped and not boxed["PERSON"].unmapped
    box = boxed["PERSON"].boxes[0]
    assert got[1].x0 < box.x0 < box.x1 <= got[1].x1 and box.y0 < got[1].y0 and box.y1 > got[1].y1


def test_tsv_words(spark):
    rows = [(5, 1, 1, 1, 50, 10, 30, 8, 90.0, "dois", 2), (5, 1, 1, 1, 10, 12, 30, 8, 70.0, "um", 3), (5, 1, 1, 2, 10, 30, 20, 8, -1.0, "so", 4), (4, 1, 1, 2, 0, 0, 9, 9, 0.0, "", 1), (5, 1, 1, 2, 60, 30, 5, 8, 50.0, " ", 5)]
    words = spark.createDataFrame(rows, "level int, block int, par int, line int, left int, top int, width int, height int, conf double, text string, row long").withColumn("page", F.lit(1))
    got = layout.tsv_lines(words, ["page"]).orderBy("line_idx").collect()
    assert [(r.txt, r.x0, r.x1, round(r.confidence, 2)) for r in got] == [("um dois", 10.0, 80.0, 0.8), ("so", 10.0, 30.0, 0.0)]
    assert [(w.a, w.b) for w in got[0].words] == [(0, 2), (3, 7)]


def test_fuzzy_contains(spark):
    df = spark.createDataFrame([("n. 123.456-7", "1234567"), ("n. 1234067", "1234567"), ("n. 1230067", "1234567"), ("  JOÃO  da", "joao DA"), ("x", "123456")], "t string, v string")
    assert [r[0] for r in df.select(evaluate.fuzzy_contains(F.col("t"), F.col("v"))).collect()] == [True, True, False, True, False]
