import random
import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions import checks
from spanveil.functions import text as tx
from spanveil.operators import rules


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("r")).first().r


@pytest.mark.parametrize("label", ["EMAIL", "PHONE", "DATE", "DIGIT_RUN", "BR_RG", "AGE"])
def test_matches_have_python_offsets(spark, label):
    rnd = random.Random(label)
    bits = ["😀", " ", "\n", "a@b.co", "(11) 91234-5678", "12/03/1980", "44 anos", "12.345.678-X", "1", "23.4", " ", "x", "٣", "é"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 9))) for _ in range(300)]
    rule = rules.BY_LABEL[label]
    flags = re.IGNORECASE if "(?i" in rule.pattern else 0
    plain = re.compile(re.sub(r"^\(\?i?u?U\)", "", rule.pattern), flags)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.matches(F.col("t"), rule.pattern).alias("m")).collect()
    for r in rows:
        assert [(m.start, m.end, m.txt) for m in r.m] == [(m.start(), m.end(), m.group()) for m in plain.finditer(texts[r.i])]


def test_check_digits(spark):
    df = spark.createDataFrame([("529.982.247-25",), ("529.982.247-24",), ("111.111.111-11",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(checks.cpf_valid(F.col("t"))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([("11.222.333/0001-81",), ("11.222.333/0001-80",)], "t string")
    assert [r[0] for r in df.select(checks.cnpj_valid(F.col("t"))).collect()] == [True, False]


def test_mask_and_caps(spark):
    assert [one(spark, tx.mask(F.col("t")), t=t) for t in ("", "abcd", "abcde", "MARIA SILVA")] == ["", "****", "ab*de", "MA*******VA"]
    assert one(spark, tx.caps_line(F.col("t")), t="KELI DE SOUZA 12") and not one(spark, tx.caps_line(F.col("t")), t="Keli de Souza")


def test_normal_context(spark):
    assert one(spark, tx.normal_context(F.col("t")), t="Pr0ntuári0  Nº\n51") == "prontuario nº 51"
