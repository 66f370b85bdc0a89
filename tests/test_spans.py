import pytest
from pyspark.sql import functions as F

from spanveil.config import EngineConfig
from spanveil.operators import names, numeric, spans
from spanveil.plans import pipeline
from spanveil.schemas import SPANS


def run(spark, text, found, fn):
    rows = [(s, e, label, text[s:e], float(score), origin, validated, strong) for s, e, label, score, origin, validated, strong in found]
    df = spark.createDataFrame([(text, rows)], f"t string, x {SPANS}")
    return [tuple(r)[:3] + (r.score, r.validated) for r in df.select(fn(F.col("t"), F.col("x")).alias("r")).first().r]


def s(start, end, label, score=0.5, origin="model", validated=False, strong=False):
    return (start, end, label, score, origin, validated, strong)


def test_dedup_winner_keeps_the_highest_score_seen(spark):
    # a maximum over the three would give the last one
    got = run(spark, "x" * 20, [s(0, 5, "AAA", 0.5, validated=True), s(0, 5, "BR_CPF", 0.99), s(0, 5, "CCC", 0.9, validated=True)], lambda t, x: spans.dedup(x))
    assert got == [(0, 5, "AAA", 0.99, True)]


def test_dedup_first_wins_ties(spark):
    got = run(spark, "x" * 20, [s(3, 5, "ONE"), s(0, 9, "LONG"), s(3, 5, "TWO")], lambda t, x: spans.dedup(x))
    assert [g[:3] for g in got] == [(0, 9, "LONG"), (3, 5, "ONE")]


@pytest.mark.parametrize(
    "text, found, want",
    [
        ("Ana Lima", [s(0, 3, "PERSON"), s(4, 8, "PERSON")], [(0, 8)]),
        ("Ana de Melo Lima", [s(0, 3, "PERSON"), s(12, 16, "PERSON")], [(0, 16)]),  # name filler
        ("Ana\nLima", [s(0, 3, "PERSON"), s(4, 8, "PERSON")], [(0, 8)]),  # white space of three or fewer
        ("54, 198", [s(0, 2, "NUMERO"), s(4, 7, "NUMERO")], [(0, 2), (4, 7)]),  # numbers never across a gap
        ("54198", [s(0, 2, "NUMERO"), s(2, 5, "NUMERO")], [(0, 5)]),  # but when they touch
        ("Ana x Lima", [s(0, 3, "PERSON"), s(4, 5, "DATE"), s(6, 10, "PERSON")], [(0, 3), (4, 5), (6, 10)]),  # another label breaks the chain
    ],
)
def test_merge(spark, text, found, want):
    assert [g[:2] for g in run(spark, text, found, spans.merge)] == want


def test_contained_and_trimmed(spark):
    text = "abcdefghijklmnopqrst"
    assert [g[:2] for g in run(spark, text, [s(0, 10, "A"), s(2, 5, "B"), s(0, 10, "C")], lambda t, x: spans.drop_contained(x))] == [(0, 10), (0, 10)]
    assert [g[:3] for g in run(spark, text, [s(0, 8, "DATE"), s(5, 12, "BR_CPF")], spans.finalize)] == [(0, 5, "DATE"), (5, 12, "BR_CPF")]
    assert [g[:3] for g in run(spark, text, [s(0, 8, "BR_CPF"), s(5, 12, "DATE")], spans.finalize)] == [(0, 8, "BR_CPF"), (8, 12, "DATE")]


def test_finalized_spans_are_disjoint(spark):
    import random

    rnd = random.Random(1)
    text = "".join(rnd.choice("abc d1") for _ in range(200))
    for _ in range(5):
        found = [s(a, a + rnd.randint(1, 30), rnd.choice(["DATE", "PERSON", "BR_CPF"]), rnd.random()) for a in (rnd.randint(0, 160) for _ in range(25))]
        got = run(spark, text, found, lambda t, x: spans.finalize(t, spans.dedup(x)))
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


NAMES = [
    ("Paciente: Maria da Silva", ["Maria da Silva"]),
    ("Paciente: MARIA DE", ["MARIA"]),
    ("Medico: Dra. Ana E. Lima CRM 123", ["Ana E. Lima"]),
    ("Nome: Ana Amaral   Registro: 20", ["Ana Amaral"]),
    ("Paciente\n: JOSE NASCIMENTO FILHO", ["JOSE NASCIMENTO FILHO"]),
    ("Paciente\n\nJose", []),
    ("Paciente: D'Avila Souza", []),
    ("Paciente: Ana D'Avila", ["Ana"]),
    ("paciente relata dor", []),
    ("Titular: Um Dois Tres Quatro Cinco Seis Sete Oito Nove", ["Um Dois Tres Quatro Cinco Seis Sete Oito"]),
    ("Nome: Ana Lima: x", ["Ana"]),
]


@pytest.mark.parametrize("text, want", NAMES)
def test_labelled_names(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(names.labelled_names(F.col("t")).alias("r")).first().r
    assert [text[g.start : g.end] for g in got] == want


@pytest.mark.parametrize("text, part, want", [("x APARECIDO SILVERIO BORGES, 1", "SILVERIO", "APARECIDO SILVERIO BORGES"), ("Dr. Ana Lima", "Lima", "Ana Lima"), ("imagem Ana de\nLima", "Ana", "Ana"), ("Setor Ana Lima", "Lima", "Ana Lima")])
def test_expand(spark, text, part, want):
    a = text.index(part)
    got = run(spark, text, [s(a, a + len(part), "PERSON")], lambda t, x: F.transform(x, lambda e: names.expand(t, e)))
    assert text[got[0][0] : got[0][1]] == want


@pytest.mark.parametrize(
    "text, number, want",
    [
        ("Prontuario 12345", "12345", "MEDICAL_RECORD"), ("peso 12345", "12345", None), ("x 1234 mg", "1234", None), ("n 12345 ", "12345", "NUMERO"), ("n 123 ", "123", None), ("tem 44 anos", "44", "AGE"),
        ("peso guia 5555", "5555", "TISS_GUIDE"), ("guia peso 5555", "5555", None), ("micro 7777", "7777", "ID"), ("dia 12/2020 ", "12/2020", "DATE"), ("as 10:30 ", "10:30", None), ("2,5 x 3456", "3456", None), ("CID J45.0", "45.0", None),
    ],
)
def test_numeric(spark, text, number, want):
    a = text.rindex(number)
    got = spark.createDataFrame([(text, [(a, a + len(number), "NUM_CANDIDATE", number, 0.3, "model", False, False)])], f"t string, x {SPANS}").select(F.transform("x", lambda e: numeric.classify(F.col("t"), e)).alias("r")).first().r[0]
    assert (got and got.label) == want


def detect(spark, text, model=None, **config):
    df = spark.createDataFrame([(text, model)], f"text string, model {SPANS}")
    return [(x.start, x.end, x.label) for x in pipeline.detect(df, model_col="model" if model else None, config=EngineConfig(**config)).first().spans]


def test_pipeline_survival(spark):
    cpf = "CPF 529.982.247-25"
    assert detect(spark, cpf, [(4, 10, "CPF", "", 0.16, "model", False, False)], threshold=1.0) == [(4, 18, "BR_CPF")]
    assert detect(spark, "Foo Bar", [(0, 3, "CITY", "", 0.4, "model", False, False)]) == []
    assert detect(spark, "Foo Bar", [(0, 3, "CITY", "", 0.9, "llm", False, False)], threshold=0.95) == []
    assert detect(spark, "Foo Bar", [(0, 3, "CITY", "", 0.6, "model", False, False)]) == [(0, 3, "CITY")]
    # a weak fragment of a name is carried by the strong one beside it, as the threshold comes after the merge
    assert detect(spark, "xx Ana Lima", [(3, 6, "PERSON", "", 0.2, "model", False, False), (7, 11, "PERSON", "", 0.9, "model", False, False)]) == [(3, 11, "PERSON")]
    # eight digits without check digits stay as a document, fewer go
    assert detect(spark, "n 1234567", [(2, 9, "BR_DOC", "", 0.9, "model", False, False)]) == []


def test_blank_texts(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "text string")
    assert [r.spans for r in pipeline.detect(df).collect()] == [[], [], []]


def test_model_spans_are_normalised(spark):
    raw = [("B-FIRSTNAME", 0.9, 0, 3, "a", 10), ("LABEL_1", 0.9, 0, 3, "a", 0), ("AMOUNT", 0.9, 0, 3, "a", 0), ("NUMBER", 0.1, 0, 3, "a", 0), ("cardinal", None, 0, 3, "a", 0), (None, 0.9, 0, 3, "a", 0)]
    df = spark.createDataFrame(raw, "entity_group string, score double, start int, end int, word string, chunk_offset int")
    got = [r.e and (r.e.label, r.e.start, r.e.score) for r in df.select(pipeline.normal_model_spans(F.struct("*"), 0.15).alias("e")).collect()]
    assert got == [("PERSON", 10, 0.9), None, None, None, ("NUM_CANDIDATE", 0, 1.0), None]
