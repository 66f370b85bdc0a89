"""The stages and the queries of the training-data operators."""

import glob
import os
import re
import zlib
from collections import Counter

import brute
import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from spanveil.llm import queries as q
from spanveil.llm import tokens
from spanveil.llm.scratch import keep

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = q.QUERIES[name](spark, SF), con.sql(q.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rs)
    assert rows(map(tuple, got.select(*cols).collect())) == rows(want.select(*cols).fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))


def test_stages(spark):
    docs = q.table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, SF), f"t-{name}")
        seen[name] = docs
        if name != "packed":
            assert docs.columns == columns
        if name in ("quality", "exact", "near"):
            assert docs.exceptAll(before).count() == 0 and 0 < docs.count() <= before.count()
    raw = [(r.doc_id, r.text) for r in q.table(spark, SF, "documents").collect()]
    marks = [(r.doc_id, r.quality, r.toxic) for r in q.table(spark, SF, "labels").collect()]
    judged = brute.resampled(spark, raw, marks)
    close = {i for i, _, _, key, kth in judged if key is not None and abs(key - kth) < 0.2}
    kept = {i for i, _, _, key, kth in judged if key is None or key >= kth}
    assert {r.doc_id for r in seen["quality"].collect()} ^ kept <= close
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    texts = lambda name: {r.doc_id: (r.text or "") for r in seen[name].collect()}
    quality, exact, near = texts("quality"), texts("exact"), texts("near")
    norm = {}
    for i, t in quality.items():
        norm.setdefault(t.encode().translate(low), []).append(i)
    assert sorted(exact) == sorted(min(v) for v in norm.values())

    def shingles(t):
        w = t.encode().translate(low).split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in exact.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(near) == sorted(i for i in sets if top(i) == i)
    con = duckdb.connect()
    con.register("documents", seen["near"].toArrow())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = Counter()
    for i, taken in con.sql(q.ORACLE["op7_mix_sources"]).select("doc_id, taken").fetchall():
        words = word.findall(near[i])
        if taken:
            want[i, near[i]] += taken // len(words)
            want[i, " ".join(words[: taken % len(words)])] += taken % len(words) > 0
    mixed = Counter((r.doc_id, r.text) for r in seen["mixed"].collect())
    assert mixed == +want
    tok = Tokenizer.from_file(q.tokenizer_path())
    tokens = {}
    for (i, t), n in mixed.items():
        tokens[i] = tokens.get(i, Counter()) + Counter([*tok.encode(t, add_special_tokens=False).ids, 2] * n)
    pieces = seen["packed"].collect()
    assert all(len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids) for r in pieces)
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, Counter()) + Counter(np.frombuffer(bytes(r.ids), "<u4").tolist())
    assert got == tokens
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in pieces}


def test_stages_of_an_empty_table(spark):
    docs = q.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), f"e-{name}")
        assert docs.count() == 0


def test_packing_reads_texts_in_small_batches(spark):
    docs = q.table(spark, SF, "documents").limit(20)
    # the caller's write would take batches of the session's size
    assert "MapInArrow" not in corpus_pipeline.packed(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()


def test_pieces_are_encoded_some_at_a_time():
    tok, _ = tokens.tokenizer(q.tokenizer_path())
    asked = []

    class Counted:
        def encode_batch(self, texts, **kw):
            asked.append(len(texts))
            return tok.encode_batch(texts, **kw)

    words = [f"w{i}x.".encode() for i in range(5000)]
    known = tokens.Pieces(Counted(), lambda e: tuple(e.ids)).learn([words])
    assert max(asked) <= tokens.MOST_AT_ONCE < len(words)
    assert all(known[w] == tuple(tok.encode(w.decode(), add_special_tokens=False).ids) for w in words)
