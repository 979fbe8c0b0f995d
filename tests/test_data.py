import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline import config
from plumbline.operators import builders, predict, records, selection
from plumbline.plans.recipe import RecipeError, run_recipe
from plumbline.sources import adapters, sinks
from plumbline.sources import records as source
from plumbline.sources.lines import read_id_manifest
from plumbline.taxonomy import load_taxonomy
from tests.backends import Echo
from tests.responses import TAX

XD = load_taxonomy("xdviolence")
REC = "ord bigint, id string, video string, labels array<string>"


def table(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], REC)


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_records_load_and_fail_loudly(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", [{"id": 7, "video": "é.mp4", "labels": [2.0, "C1"], "more": {"x": 1}}, "", {"id": "b", "video": "v", "labels": []}])
    rows = source.load_records(spark, good, TAX).orderBy("ord").collect()
    assert [(r.ord, r.id, r.video, r.labels) for r in rows] == [(1, "7", "é.mp4", ["C1", "C2"]), (3, "b", "v", [])]
    assert rows[0].extra.toPython()["more"] == {"x": 1}
    cases = ["{", "[1]", {"id": "x"}, {"id": True, "video": "v", "labels": []}, {"id": "", "video": "v", "labels": []}, {"id": "x", "video": "", "labels": []}, {"id": "x", "video": "v", "labels": "C1"}, {"id": "x", "video": "v", "labels": ["C9"]}, {"id": "x", "video": "v", "labels": [True]}, {"id": "x", "video": "v", "labels": [1.5]}, {"id": "x", "video": "v", "labels": [1, "C1"]}]
    bad = write(tmp_path / "b.jsonl", cases)
    with pytest.raises(source.DataError, match="b.jsonl:1: invalid JSON"):
        source.load_records(spark, bad, TAX)
    parsed = source.parse_records(source.lines(spark, bad), TAX)
    assert parsed.where("error is null").count() == 0 and parsed.count() == len(cases)


def test_report_tells_the_first_errors():
    report = records.ValidationReport(3)
    report.raise_if_errors()
    report.errors += [f"e{k}" for k in range(25)]
    report.cardinality_counts.update({2: 1, 0: 2})
    with pytest.raises(source.DataError, match="e0; .*e19; 5 errors besides"):
        report.raise_if_errors()
    document = report.to_dict()
    assert list(document) == records.DOCUMENT and document["num_benign"] == 2 and document["label_cardinality"] == {"0": 2, "2": 1}


def test_validation(spark):
    recs = table(spark, ("a", "x.mp4", ["C1"]), ("b", "/x/x.mp4", ["C1", "C2"]), ("a", "x.mp4", []), ("c", "s3://v", []))
    report = records.validate_records(recs, TAX, "/nowhere")
    assert not report.ok and report.repeated_ids == {"a": 2} and report.repeated_videos == {"/nowhere/x.mp4": 2}
    assert report.label_counts["C1"] == 2 and report.to_dict()["num_benign"] == 2 and len(report.warnings) == 2
    with pytest.raises(source.DataError, match="repeated ids"):
        report.raise_if_errors()
    lenient = records.validate_records(recs, TAX, "/nowhere", "allow", "allow", "exists", True)
    assert lenient.missing_media == ["/nowhere/x.mp4", "/x/x.mp4"] and len(lenient.errors) == 2
    other = table(spark, ("c", "y", []), ("d", "x.mp4", []))
    assert records.overlap_messages({"train": recs, "val": other}) == ["1 id(s) in both train and val, e.g. 'c'", "1 video(s) in both train and val, e.g. 'x.mp4'"]


def test_samples_are_the_seeded_ones(spark):
    from random import Random

    recs = table(spark, *((f"v{k}", f"v{k}", []) for k in range(50)))
    ids = lambda df: [r.id for r in df.orderBy("ord").collect()]
    assert ids(selection.select_records(recs, 7, 123, "random_sample")) == [f"v{k}" for k in Random(123).sample(range(50), 7)]
    assert ids(selection.select_records(recs, 7, 42, "sorted_index_sample")) == [f"v{k}" for k in sorted(Random(42).sample(range(50), 7))]
    assert selection.select_records(recs, 99, 1, "random_sample").count() == selection.select_records(recs, 99, 1, "sorted_index_sample").count() == 50


def test_manifests(spark, tmp_path):
    recs = table(spark, ("a", "1", []), ("b", "2", []), ("a", "3", []), ("c", "4", []))
    path = str(tmp_path / "ids.txt")
    sinks.write_id_manifest(recs.where("id <> 'c'"), path, ("made here",))
    listed = read_id_manifest(spark, path)
    assert [r.video for r in selection.select_by_manifest(recs, listed).orderBy("ord").collect()] == ["1", "2", "3"]
    for wrong, text in ((["b", "a", "a"], "order or repeats"), (["a", "b", "z"], "1 listed ids are absent")):
        with pytest.raises(source.DataError, match=text):
            selection.select_by_manifest(recs, spark.createDataFrame(list(enumerate(wrong)), "ord bigint, id string"))
    with pytest.raises(source.DataError):
        sinks.write_id_manifest(table(spark, ("a\nb", "v", [])), str(tmp_path / "x.txt"))


def test_media_filter(spark, tmp_path):
    recs = table(spark, ("a", "16.mp4", []), ("b", "24.mp4", []), ("c", "1.mp4", []), ("d", "gone.mp4", []), ("e", "x.unknown_video", []), ("f", "16.mp4", []))
    for name in ("16", "24", "1"):
        (tmp_path / f"{name}.mp4").write_text(name)

    def probe(path):
        return int(path.rsplit("/", 1)[1][:-4]), 8.0, None

    probes = selection.probe_media(recs, probe, str(tmp_path)).cache()
    assert probes.count() == 4
    kept, dropped = selection.filter_by_media(recs, probes, "drop", video_root=str(tmp_path), max_duration=2.0, min_frames=2)
    assert {r.id for r in kept.collect()} == {"a", "f"}
    assert {r.id: r.reason for r in dropped.collect()} == {"b": "too_long", "c": "too_few_frames", "d": "unreadable", "e": "suffix"}
    with pytest.raises(source.DataError, match="gone.mp4"):
        selection.filter_by_media(recs, probes, "error", video_root=str(tmp_path))

    def never(path):
        raise AssertionError(path)

    again = selection.probe_media(recs, never, str(tmp_path), probes.where("key is not null")).collect()
    assert {(r.path, r.frames) for r in again} == {(r.path, r.frames) for r in probes.collect()}


def test_oversampling(spark):
    recs = table(spark, *((f"v{k}", f"v{k}.mp4", TAX.resolve_labels(x)) for k, x in enumerate([[2], [], [1, 2], [3], [2, 6], [2]])), ("v0__aug_cls2_1", "v0.mp4", ["C2"]), ("v5", "v5.mp4", ["C2"]))
    rows = builders.rl_rows(recs, TAX, "task", "index")
    out = builders.oversample(rows, 2).orderBy("ord").collect()
    assert [r.id for r in out[:8]] == [r.id for r in recs.collect()]
    assert [r.id for r in out[8:]] == ["v0__aug_cls2_2", "v2__aug_cls2_1", "v4__aug_cls2_1", "v5__aug_cls2_1", "v0__aug_cls2_1__aug_cls2_1", "v5__aug_cls2_2"]


def test_oversampling_of_one_id_with_many_counters(spark):
    rng = random.Random(8)
    taken = sorted(rng.sample(range(1, 60_000), 20_000))
    copies = 30_000
    named = spark.createDataFrame([(k, f"x__aug_cls2_{n}", [1]) for k, n in enumerate(taken)], "ord bigint, id string, response array<bigint>")
    named = named.unionByName(spark.createDataFrame([(-1, "x__aug_cls2_7x", [1]), (-2, "x__aug_cls2_07", [1]), (-3, "x__aug_cls2_", [1])], named.schema))
    hits = spark.range(copies).select((F.col("id") + 50_000).alias("ord"), F.lit("x").alias("id"), F.array(F.lit(2).cast("bigint")).alias("response"))
    out = builders.oversample(named.unionByName(hits), 2).where(f"ord >= {50_000 + copies}").orderBy("ord").collect()
    free = iter(sorted(set(range(1, 200_000)) - set(taken)))
    assert [r.id for r in out] == [f"x__aug_cls2_{next(free)}" for _ in range(copies)]
    assert [r.ord for r in out] == list(range(50_000 + copies, 50_000 + 2 * copies))


def test_list_and_folder_adapters(spark, tmp_path):
    path = write(tmp_path / "list.txt", ["m__#1_label_B1-G-0", "", "n_label_A.mp4"])
    rows = adapters.label_list(spark, path, XD, "basename", "p/").orderBy("ord").collect()
    assert [(r.id, r.video, r.labels) for r in rows] == [("m__#1_label_B1-G-0.mp4", "p/m__#1_label_B1-G-0.mp4", ["B1", "B3"]), ("n_label_A.mp4", "p/n_label_A.mp4", [])]
    with pytest.raises(source.DataError, match=":1: missing"):
        adapters.label_list(spark, write(tmp_path / "bad.txt", ["nothing"]), XD, "id")
    root = tmp_path / "ann"
    for folder, videos, truth in (("b", ["dataset/full/2.mp4", "dataset/clip/3.mp4"], []), ("a", ["dataset/full/1.mp4", "dataset/full/1.mp4"], [("dataset/full/1.mp4", [1]), ("dataset/full/1.mp4", [2])])):
        write(root / folder / "full.json", [[{"id": n, "video": v} for n, v in enumerate(videos)]])
        write(root / folder / "full_gt.json", [[{"video_path": v, "labels": x, "subcategories": ["s"]} for v, x in truth]])
    rows = adapters.folder_annotations(spark, str(root), TAX, video_prefix="v/").orderBy("ord").collect()
    assert [(r.id, r.video, r.labels, r.subcategories) for r in rows] == [("full/1.mp4", "v/full/1.mp4", ["C2"], ["s"])] * 2 + [("full/2.mp4", "v/full/2.mp4", [], [])]


@pytest.mark.parametrize(("mode", "benign"), [("folder", ["C4"]), ("empty", [])])
def test_benchmark_adapter(spark, tmp_path, mode, benign):
    write(tmp_path / "real/C1/a_benchmark.json", [{"items": [{"video_path": "real/C1/videos/x_benchmark/1.mp4"}, {"video": "real/C1/q.unknown_video"}, {"none": 1}]}])
    write(tmp_path / "real/C1.b/z.json", [[{"videoPath": "real/C2/2.mp4", "labels": [3], "subcategories": ["t"]}]])
    write(tmp_path / "genai/C4/benign.json", [{"video": "genai/C4/benign_benchmark/3.mp4", "x": 1}])
    rows = adapters.benchmark_annotations(spark, str(tmp_path), TAX, mode).orderBy("ord").collect()
    assert [(r.id, r.labels, r.subcategories, r.harmfulness) for r in rows] == [("genai/C4/benign_benchmark/3.mp4", benign, ["benign"], 0), ("real/C1/x_benchmark/1.mp4", ["C1"], ["x"], 1), ("real/C2/2.mp4", ["C3"], ["t"], 1)]


RECIPE = """
taxonomy: safewatch
variables: {{dir: {{default: {d}}}}}
splits: {{train: "${{dir}}/train.jsonl", val: "${{dir}}/val.jsonl"}}
outputs:
  - {{kind: rl, split: train, path: "${{dir}}/out/rl", prompt: {{render: true}}, label_format: index, oversample: [2, 1]}}
  - {{kind: chat, split: val, path: "${{dir}}/out/chat.jsonl", prompt: {{text: look}}, target_style: json, dataset_name: d}}
"""


def test_recipe_end_to_end(spark, tmp_path):
    write(tmp_path / "train.jsonl", [{"id": k, "video": f"{k}.mp4", "labels": x} for k, x in enumerate([[1], [2], [1, 2], []])])
    write(tmp_path / "val.jsonl", [{"id": "w", "video": "w.mp4", "labels": ["C3"]}])
    path = write(tmp_path / "recipe.yaml", [RECIPE.format(d=tmp_path)])
    done = run_recipe(spark, path)
    assert [o["rows"] for o in done["outputs"]] == [9, 1] and done["outputs"][0]["label_counts"] == {"1": 6, "2": 6}
    rl = adapters.rl_parquet(spark, str(tmp_path / "out/rl"), TAX)
    assert rl.count() == 9 and rl.where("source_prompt_sha256 is null").count() == 0
    (chat,) = adapters.chat_jsonl(spark, str(tmp_path / "out/chat.jsonl"), TAX).collect()
    assert (chat.id, chat.video, chat.labels) == ("w", "w.mp4", ["C3"])
    assert json.loads((tmp_path / "out/dataset_info.json").read_text())["d"]["file_name"] == "chat.jsonl"
    with pytest.raises(Exception, match="exist"):
        run_recipe(spark, path)
    assert sinks.rows_fingerprint(spark.read.parquet(str(tmp_path / "out/rl")).orderBy("id"))[1] == 9
    write(tmp_path / "val.jsonl", [{"id": 0, "video": "w.mp4", "labels": []}])
    with pytest.raises(RecipeError, match="overlap"):
        run_recipe(spark, path, overwrite=True)


def test_predictions_resume(spark, tmp_path):
    names = ["a", "broken", "fail", "none", "words", "part", "b"]
    inputs = source.load_inputs(spark, names)
    path = str(tmp_path / "predictions")
    first = predict.run_predictions(inputs.where("ord < 3"), Echo, TAX, path, batch_size=2)
    assert first["status"] == "complete" and first["counts"] == {"ok": 1, "video_error": 1, "generation_error": 1}
    with pytest.raises(FileExistsError):
        predict.run_predictions(inputs, Echo, TAX, path)
    done = predict.run_predictions(inputs, Echo, TAX, path, resume=True)
    assert done["resumed_from"] == 3 and done["counts"] == {"ok": 2, "video_error": 1, "generation_error": 2, "parse_error": 1, "partial": 1}
    rows = {r.id: r for r in spark.read.parquet(path).collect()}
    assert rows["a"].labels == ["C2"] and rows["a"].label_names == ["Harassment & Bullying"] and rows["a"].unsafe is True
    assert rows["part"].unsafe is None and len(rows["part"].missing_categories) == 5 and rows["words"].labels is None
    assert rows["broken"].error == "OSError: cannot open" and rows["none"].error == "no output"
    with pytest.raises(source.DataError, match="not in the input"):
        predict.run_predictions(inputs.where("id = 'a'"), Echo, TAX, path, resume=True)


def test_inputs(spark, tmp_path):
    path = write(tmp_path / "in.jsonl", [{"video": "a.mp4"}, {"id": "x", "video": "/b.mp4"}])
    assert [(r.id, r.video) for r in source.load_inputs(spark, path=path).orderBy("ord").collect()] == [("a.mp4", f"{tmp_path}/a.mp4"), ("x", "/b.mp4")]
    with pytest.raises(ValueError):
        source.load_inputs(spark)
    with pytest.raises(source.DataError, match="duplicate"):
        source.load_inputs(spark, path=write(tmp_path / "two.jsonl", [{"video": "a"}, {"video": "a"}]))


def test_checksums(spark, tmp_path):
    for n in ("a", "b/c d", "b/é"):
        write(tmp_path / f"{n}.txt", [n])
    sinks.write_checksums(spark, str(tmp_path))
    assert sinks.verify_checksums(spark, str(tmp_path)) == []
    (tmp_path / "a.txt").write_text("other")
    (tmp_path / "b/c d.txt").unlink()
    assert sinks.verify_checksums(spark, str(tmp_path)) == ["a.txt", "b/c d.txt"]


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "o.jsonl")
    df = spark.createDataFrame([(2, "b", None), (1, "é", [1])], "ord bigint, id string, x array<int>")
    assert sinks.write_json_lines(df, path) == 2
    assert open(path, encoding="utf-8").read() == '{"id": "é", "x": [1]}\n{"id": "b", "x": null}\n'
    with pytest.raises(FileExistsError):
        sinks.write_json_lines(df, path)


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("HERE", "env")
    assert config.expand_variables({"a": ["${n}", "x${n}", "${HERE}"]}, {"n": 3}) == {"a": [3, "x3", "env"]}
    with pytest.raises(config.ConfigError):
        config.expand_variables("${nowhere_at_all}", {})
    write(tmp_path / "base.yaml", ["a: {x: 1, y: [1, 2]}", "variables: {p: {default: 1}}"])
    write(tmp_path / "top.yaml", ["extends: base.yaml", "a: {y: [3]}", "variables: {q: {}}"])
    assert config.load_yaml(tmp_path / "top.yaml") == {"a": {"x": 1, "y": [3]}, "variables": {"p": {"default": 1}, "q": {}}}
    write(tmp_path / "base.yaml", ["extends: top.yaml"])
    with pytest.raises(config.ConfigError):
        config.load_yaml(tmp_path / "top.yaml")
    assert config.resolve_variables({"p": {"default": 1}}, {}) == {"p": 1} and config.parse_scalar("[1, x]") == [1, "x"]
    with pytest.raises(config.ConfigError):
        config.resolve_variables({"p": {}}, {"q": 1})
