import json

import numpy as np
from pyspark.sql import functions as F

from spanveil.operators import outputs

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def test_response_and_summary(spark):
    pages = spark.createDataFrame([(1, 0, 10, 20, "Ana", "[NOME]", 3), (1, 1, 10, 20, "x" * 30, "x" * 30, 30), (2, 0, 5, 5, "y", "y", 1)], "doc int, page_index int, width int, height int, text string, redacted string, chars int")
    ents = spark.createDataFrame([(1, 0, 0, 3, "PERSON", "[NOME]", [], True)], f"doc int, page_index int, start int, end int, label string, redacted string, boxes array<{BOX}>, unmapped boolean")
    out = {r.doc: json.loads(r.json) for r in outputs.response(pages, ents, "doc").collect()}
    assert out[1]["page_count"] == 2 and out[1]["stats"] == {"total_entities": 1, "by_label": {"PERSON": 1}, "unmapped": 1}
    assert out[1]["pages"][0]["deidentified_text"] == "[NOME]" and "original_text" not in out[1]["pages"][0] and out[2]["pages"][0]["entities"] == []
    assert "Ana" in outputs.response(pages, ents, "doc", reveal=True).where("doc = 1").first().json
    got = {r.doc: r for r in outputs.summary(pages, ents, "doc").collect()}
    assert (got[1].covered, got[1].by_placeholder, got[1].warnings) == (1, {"[NOME]": 1}, ["little text on page 1"])
    assert (got[2].covered, got[2].warnings) == (0, ["nothing found"])


def test_baseline(spark):
    rows = spark.createDataFrame([("a", "hit"), ("b", "miss"), ("c", "hit_mislabel")], "key string, outcome string")
    b = outputs.baseline(rows, rows.limit(2))
    r = b.first()
    assert (r.gold, r.recall_label, r.recall_covered, r.fn, r.fp, r.region_miss) == (3, 0.3333, 0.6667, 1, 2, 0)
    assert sorted(map(tuple, outputs.read_baseline(b).collect())) == [("a", "hit"), ("b", "miss"), ("c", "hit_mislabel")]


def test_region_overlap(spark):
    df = spark.createDataFrame([([], [(0.0, 0.0, 1.0, 1.0)]), ([(0.0, 0.0, 10.0, 10.0)], [(0.0, 0.0, 5.0, 10.0), (0.0, 0.0, 2.0, 10.0)]), ([(0.0, 0.0, 4.0, 4.0)], [(0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 9.0, 9.0)])], f"b array<{BOX}>, g array<{BOX}>")
    assert [r[0] for r in df.select(outputs.region_overlap(F.col("b"), F.col("g"))).collect()] == [1.0, 0.7, 1.0]


def test_token_windows(spark):
    for n in (0, 1, 10, 11, 18, 19, 100):
        df = spark.createDataFrame([([3 * i for i in range(n)], [3 * i + 2 for i in range(n)])], "s array<int>, e array<int>")
        got = df.select(outputs.token_windows(F.col("s"), F.col("e"), 10, 2).alias("w")).first().w
        want = []
        for i in range(0, n, 8):
            want.append((3 * i, 3 * min(n, i + 10) - 1))
            if i + 10 >= n:
                break
        assert [tuple(x) for x in got or []] == want


def test_burn_and_hint(spark):
    raster = np.full((4, 5, 3), 200, np.uint8)
    df = spark.createDataFrame([(1, 5, 4, raster.tobytes(), [(1, 1, 3, 9)])], "page int, width int, height int, raster binary, boxes array<struct<x0:int,y0:int,x1:int,y1:int>>")
    out = np.frombuffer(bytes(outputs.burn(df).first().raster), np.uint8).reshape(4, 5, 3)
    assert (out[1:, 1:3] == 0).all() and out.sum() == raster.sum() - 200 * 3 * 6
    names = spark.createDataFrame([("My_SAMPLE.png",), ("exame.pdf",)], "n string")
    assert [r[0] for r in names.select(outputs.looks_synthetic(F.col("n"))).collect()] == [True, False]
