"""The command line over a small folder."""

import json

from corpusloom.__main__ import main


def test_index_and_ask(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("The harvest festival begins in September near the old mill.")
    (tmp_path / "in" / "b.md").write_text("# Notes\n\nWinter tyres are stored in the garage.")
    assert main(["index", str(tmp_path / "in"), str(tmp_path / "ix")]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["documents"] == 2 and told["files"] == 2
    assert main(["ask", str(tmp_path / "ix"), "where are winter tyres stored?"]) == 0
    assert "garage" in capsys.readouterr().out
    assert main(["inspect", str(tmp_path / "ix")]) == 0 and json.loads(capsys.readouterr().out) == told


def test_validate_and_doctor(tmp_path, capsys):
    (tmp_path / "c.json").write_text('{"retrieval": {"top_k": 0}}')
    assert main(["validate", str(tmp_path / "c.json")]) == 1
    (tmp_path / "c.json").write_text('{"retrieval": {"top_k": 2}}')
    assert main(["validate", str(tmp_path / "c.json")]) == 0
    assert main(["doctor"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["pyspark"]
