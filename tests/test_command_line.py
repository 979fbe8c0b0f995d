import json

from plumbline.__main__ import main
from plumbline.operators.controller import Controller
from tests.test_data import write


def test_import_select_validate_evaluate(spark, tmp_path, capsys):
    listed = write(tmp_path / "list.txt", [f"v{k}_label_B{k % 6 + 1}" for k in range(12)])
    at = lambda n: str(tmp_path / n)
    tax = ["--taxonomy", "xdviolence"]
    assert main(["import-data", "--input", listed, "--output", at("a.jsonl"), "--format", "list", *tax]) == 0
    assert json.loads((tmp_path / "a.jsonl.manifest.json").read_text())["rows"] == 12
    assert main(["import-data", "--input", listed, "--output", at("a.jsonl"), "--format", "list", *tax]) == 2
    assert main(["select", "--data", at("a.jsonl"), "--output", at("b.jsonl"), "--n", "5", "--seed", "3", "--write-manifest", at("ids.txt"), *tax]) == 0
    assert main(["select", "--data", at("b.jsonl"), "--output", at("c.jsonl"), "--manifest", at("ids.txt"), *tax]) == 0
    assert (tmp_path / "b.jsonl").read_text() == (tmp_path / "c.jsonl").read_text()
    assert main(["validate-data", "--data", at("a.jsonl"), *tax]) == 0
    assert main(["validate-data", "--data", at("a.jsonl"), at("b.jsonl"), *tax]) == 1
    rows = [json.loads(x) for x in (tmp_path / "a.jsonl").read_text().splitlines()]
    predictions = write(tmp_path / "p.jsonl", [{"id": r["id"], "status": "ok", "labels": r["labels"]} for r in rows[:-1]])
    command = ["evaluate", "--data", at("a.jsonl"), "--predictions", predictions, "--invalid-policy", "negative", *tax]
    assert main(command) == 2
    capsys.readouterr()
    assert main([*command, "--missing-policy", "exclude", "--output", at("m.json")]) == 0
    assert "Scored 11 of 12" in capsys.readouterr().out
    assert json.loads((tmp_path / "m.json").read_text())["metrics"]["micro_f1"] == 1.0


def test_states_and_configuration(tmp_path, capsys):
    c = Controller({"mode": "category", "invalid_prediction_policy": "exclude"}, ["a", "b"])
    c.update([0.1, 0.2], [0.3, 0.4])
    path = write(tmp_path / "state.json", [c.state_dict()])
    assert main(["inspect-state", "--state", path]) == 0
    assert "category, 1 updates" in (out := capsys.readouterr().out) and "fn_ema 0.4" in out
    tree = write(tmp_path / "c.yaml", ["a: ${n}", "variables: {n: {default: 2}}"])
    assert main(["show-config", "--config", tree, "--var", "n=5"]) == 0
    assert json.loads(capsys.readouterr().out) == {"a": 5}
    assert main(["show-config", "--config", tree, "--var", "m=5"]) == 2
