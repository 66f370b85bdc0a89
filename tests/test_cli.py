import json

from spanveil import cli


def test_batch_resumes(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("CPF 529.982.247-25 fim")
    (src / "b.docx").write_bytes(b"broken")
    args = ["batch", "--input", str(src), "--output", str(out)]
    assert cli.main(args, spark) == 1
    parts = lambda: sorted((r.part, r.name, r.part_text) for r in spark.read.parquet(f"{out}/parts").collect())
    assert parts() == [(1, "parte-0001.txt", "CPF [CPF] fim")]
    ledger = lambda: sorted(r.status for r in spark.read.parquet(f"{out}/ledger").collect())
    assert ledger() == ["BadZipFile", "done"]
    # what is done is not done again, what failed is tried again
    assert cli.main(args, spark) == 1 and len(parts()) == 1 and ledger() == ["BadZipFile", "BadZipFile", "done"]
    (src / "b.docx").unlink()
    assert cli.main(args, spark) == 0
    assert cli.main([*args, "--part-chars", "10"], spark) == 2


def test_evaluate(spark, tmp_path, capsys):
    span = {"id": "s1", "label": "CPF", "group": "DOC_NUM", "text": "529.982.247-25", "char_start": 4, "char_end": 18}
    page = {"width": 1, "height": 1, "canonical_text": "CPF 529.982.247-25", "spans": [span, span | {"id": "s2", "label": "RG", "char_start": 0, "char_end": 3, "text": "CPF"}], "optional_spans": [], "regions": []}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/a.json").write_text(json.dumps({"doc_id": "a", "doc_type": "x", "schema_version": 1, "page": page}))
    args = ["evaluate", "--corpus", str(tmp_path / "g")]
    assert cli.main([*args, "--save-baseline", str(tmp_path / "base")], spark) == 0
    assert "TOTAL" in capsys.readouterr().out
    assert cli.main([*args, "--baseline", str(tmp_path / "base")], spark) == 0
    assert capsys.readouterr().err == "" and cli.main([*args, "--baseline", str(tmp_path / "absent")], spark) == 0
    (tmp_path / "old.json").write_text(json.dumps({"outcomes": {"a#p0#s2": "hit"}, "corpus_hash": "x"}, indent=1))
    assert cli.main([*args, "--baseline", str(tmp_path / "old.json")], spark) == 1
    said = capsys.readouterr()
    assert "regression a#p0#s2" in said.out and "another corpus" in said.err
