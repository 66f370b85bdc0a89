import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from spanveil import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, float):  # whole numbers of a column with nulls come as floats
            return int(v) if v.is_integer() else round(v, 9)
        return v.item() if hasattr(v, "item") else v

    cols = sorted(df.columns)
    return sorted(repr([plain(v) if not (isinstance(v, float) and math.isnan(v)) else None for v in r]) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got, want = engine.QUERIES[name](spark, SF).toPandas(), duck.sql(engine.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    got = entry.entry(spark).limit(3).collect()
    assert got and all(r.n_spans > 5 and "[NOME]" in r.redacted for r in got)


def test_imports_without_the_training_data_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.stdout.split() == [str(len(engine.QUERIES)), "False"], out.stderr
