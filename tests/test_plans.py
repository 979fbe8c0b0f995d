"""Inference settings, requests, preflight, and what earlier versions lost or collected without a bound."""

import json
from random import Random

import pytest

from plumbline.operators import evaluate, predict, selection
from plumbline.plans import inference, preflight, prompts
from plumbline.sources import shared, sinks
from plumbline.taxonomy import TaxonomyError, UnknownLabelError, load_taxonomy
from tests.backends import Batch

TAX = load_taxonomy("safewatch")


def config(**more):
    return inference.InferenceConfig(TAX, "say it", "plain", more)


def test_settings_have_defaults_and_bounds():
    c = config(video={"fps": 2.0})
    assert c["video.fps"] == 2.0 and c["generation.max_new_tokens"] == 1024 and c["processor.source"] == "checkpoint"
    for bad in ({"video": {"fps": 0}}, {"video": {"min_pixels": 9, "max_pixels": 8}}, {"video": {"depth": 1}}, {"video": {"position": "placeholder"}}, {"parser": {"scope": "x"}}, {"generation": {"temperature": -1}}, {"colour": 1}):
        with pytest.raises(inference.InferenceError):
            config(**bad)
    for prompt, fmt in (("", "plain"), ("see <video>", "plain"), ("x", "other")):
        with pytest.raises(inference.InferenceError):
            inference.InferenceConfig(TAX, prompt, fmt)


def test_settings_round_trip_and_pin_hashes(tmp_path):
    c = config(description="one")
    path = c.save(tmp_path)
    assert inference.InferenceConfig.from_file(path) == c and path.name == inference.FILE_NAME
    assert config(description="two", provenance={"a": 1}).fingerprint() == c.fingerprint() != config(system_prompt="s").fingerprint()
    for key, value in (("taxonomy_fingerprint", "0"), ("prompt", {"text": "x", "sha256": "0"}), ("format", "v0"), ("strange", 1)):
        with pytest.raises(inference.InferenceError):
            inference.InferenceConfig.from_dict(c.to_dict() | {key: value})
    other = c.with_overrides({"video.max_pixels": 50176, "prompt": "new", "system_prompt": "s"})
    assert (other["video.max_pixels"], other.prompt, other["system_prompt"]) == (50176, "new", "s")
    for name in ("video.depth", "nothing", "video.fps.x"):
        with pytest.raises(inference.InferenceError):
            c.with_overrides({name: 1})


def test_which_settings_win(tmp_path):
    bare, own = tmp_path / "bare", tmp_path / "own"
    bare.mkdir(), own.mkdir()
    config(system_prompt="own").save(own)
    source = lambda *a, **k: inference.resolve_settings(*map(str, a), **k)[1]["source"]
    assert source(own) == "model" and source(bare, fallback="safewatch_json") == "fallback:safewatch_json"
    assert source(bare, preset="xdviolence_json") == "preset:xdviolence_json" and source(bare, config=config().to_dict()) == "config"
    with pytest.warns(UserWarning, match="differs"):
        found, info = inference.resolve_settings(str(own), preset="safewatch_json", overrides={"video.fps": 3.0})
    assert info["model_settings_overridden"] and found["video.fps"] == 3.0 and info["overrides"] == {"video.fps": 3.0}
    for bad in ({}, {"preset": "x"}, {"preset": "safewatch_json", "config": config()}):
        with pytest.raises(inference.InferenceError):
            inference.resolve_settings(str(bare), **bad)
    assert set(inference.list_presets()) == {"safewatch_json", "xdviolence_json"}


def test_requests_put_the_video_where_they_should():
    kinds = lambda c: [x["type"] if x["type"] == "video" else x["text"] for x in inference.build_messages(c, "v")[-1]["content"]]
    assert kinds(config()) == ["say it", "video"] and kinds(config(video={"position": "before"})) == ["video", "say it"]
    inside = lambda prompt: kinds(inference.InferenceConfig(TAX, prompt, "plain", {"video": {"position": "placeholder"}}))
    assert inside("see <video> now") == ["see ", "video", " now"] and inside("<video>") == ["video"]
    messages = inference.build_messages(config(system_prompt="s"), "v")
    assert messages[0] == {"role": "system", "content": "s"} and messages[1]["content"][1]["max_pixels"] == 200704


def test_bundled_prompts():
    assert prompts.format_template_path("think_answer").read_text() == "{{ content | trim }}" + prompts.SUFFIXES["think_answer"]
    assert prompts.read_resource("formats/triple_newline.jinja").endswith(prompts.SUFFIXES["triple_newline"])
    for name in ("../taxonomies/safewatch.yaml", "formats/none.jinja"):
        with pytest.raises(prompts.PromptError):
            prompts.read_resource(name)


def test_preflight(spark, tmp_path):
    (tmp_path / "a.mp4").write_text("x")
    path = str(tmp_path / "train.parquet")
    spark.createDataFrame([("1", "a.mp4", "p", ["C1"])], "id string, video_path string, prompt string, response array<string>").write.parquet(path)
    reward = {"taxonomy": "safewatch", "reward": "jaccard"}
    assert preflight.check_rl(spark, path, "hub@val", reward, image_dir=str(tmp_path)) == []
    pinned = sinks.rows_fingerprint(spark.read.parquet(path))[0]
    assert preflight.check_rl(spark, path, path, reward, image_dir=str(tmp_path), pinned={"train_files": pinned, "val_files": "0"}) == ["val_files isn't the pinned data"]
    with pytest.raises(preflight.PreflightError) as e:
        preflight.check_rl(spark, path, str(tmp_path / "no.parquet"), {"taxonomy": "safewatch", "reward": "none"}, model="/no/model", optional={"format_prompt": "/no/file"})
    assert len(e.value.problems) == 4
    with pytest.raises(preflight.PreflightError, match="training videos"):
        preflight.check_rl(spark, path, path, reward, image_dir=str(tmp_path / "train.parquet"))
    sinks.upsert_dataset_entry(str(tmp_path), "one", "one.json")
    with pytest.raises(preflight.PreflightError) as e:
        preflight.check_chat(str(tmp_path), "one, two")
    assert len(e.value.problems) == 2
    (tmp_path / "one.json").write_text("{}")
    preflight.check_chat(str(tmp_path), "one")


def test_ranks_of_wide_rows_are_exact(spark):
    records = spark.range(60_000).selectExpr("(id * 7919) % 60000 AS ord", "CAST(id AS STRING) AS id", "repeat(md5(CAST(id AS STRING)), 16) AS wide")
    ranked = selection.with_rank(records)
    assert ranked.where("rank <> ord").count() == 0 and ranked.count() == 60_000
    drawn = selection.select_records(records, 100, 5, "random_sample").orderBy("ord").collect()
    at = {(k * 7919) % 60_000: str(k) for k in range(60_000)}
    assert [r.id for r in drawn] == [at[x] for x in Random(5).sample(range(60_000), 100)]


def test_failed_batches_are_tried_one_by_one_and_resume_wins(spark, tmp_path):
    inputs = spark.createDataFrame([(str(k), f"v{k}") for k in range(5)], "id string, video string")
    made = {r.id: (r.response, r.status) for r in predict.generate(inputs, Batch, 4).collect()}
    assert made["1"] == ("BLOCK v1", None) and made["2"] == (None, "generation_error") and len(made) == 5
    path = str(tmp_path / "out")
    for more in ({}, {"resume": True}, {"resume": True, "overwrite": True}, {"overwrite": True}):
        done = predict.run_predictions(inputs, Batch, TAX, path, **more)
        assert done["num_records"] == 5 and done["status"] == "complete"
    saved = json.loads((tmp_path / "out.meta.json").read_text())
    assert saved["counts"] == done["counts"] and saved["versions"]["pyspark"] and saved["taxonomy_fingerprint"] == TAX.fingerprint()


def test_names_of_truth_columns_may_clash(spark):
    truth = spark.createDataFrame([("a", ["C1"], 1, "x", "y"), ("b", [], 2, "x", "y")], "id string, labels array<string>, of int, found string, status string")
    made = spark.createDataFrame([("a", "ok", ["C1"]), ("c", "ok", [])], "id string, status string, labels array<string>")
    rows = {r.id: r for r in evaluate.join_predictions(truth, made).collect()}
    assert rows["a"].status == "ok" and rows["b"].status == "missing" and rows["a"].of == 1
    found = evaluate.evaluate(truth.drop("status"), made, TAX, "negative", "negative", listed=1)
    assert found["coverage"]["missing_ids"] == ["b"] and found["coverage"]["extra_prediction_ids"] == ["c"]


def test_labels_that_are_unknown_are_taxonomy_errors():
    with pytest.raises(TaxonomyError):
        TAX.resolve_label("nothing")
    assert issubclass(UnknownLabelError, KeyError)


def test_shared_folder_is_refused_off_one_machine():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared._FOLDERS.pop(None, None)
        shared.shared_folder(Session())


def test_streamed_predictions_are_made_once(spark, tmp_path):
    from plumbline.plans.run_queries import NumberBackend
    from plumbline.streaming import predictions as streaming
    from tests.responses import TAX

    def files(name, ids):
        spark.createDataFrame([(str(k), f"v{k}.mp4") for k in ids], "id string, video string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema("id string, video string").parquet(str(tmp_path / "in"))
        sink = streaming.StreamingPredictions(NumberBackend, TAX, f"file://{tmp_path}/out", scope="answer_only")
        sink.start(stream, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
        return sink

    put, broken = streaming.put_text, []

    def breaks_off(spark, uri, text):
        broken.append(uri)
        raise OSError("lost before the commit")

    files("a", [*range(1, 20), 3, 3])
    assert run().made(spark).count() == 19
    files("b", range(10, 40))
    streaming.put_text = breaks_off
    try:
        with pytest.raises(Exception, match="lost before the commit"):
            run()
    finally:
        streaming.put_text = put
    reader = streaming.StreamingPredictions(NumberBackend, TAX, f"file://{tmp_path}/out")
    assert broken and reader.committed(spark) == [0] and reader.made(spark).count() == 19  # the folder of the broken batch is there, and not seen
    sink = run()
    found = [r.id for r in sink.made(spark).collect()]
    assert sink.committed(spark) == [0, 1] and sorted(found, key=int) == [str(k) for k in range(1, 40)]
    files("c", [])
    files("d", [1, 2])
    assert run().made(spark).count() == 39


def test_records_may_have_columns_of_any_name(spark):
    from plumbline.operators import builders, selection
    from tests.responses import TAX

    names = ["rank", "__at", "__of", "__start", "__rank", "__place", "__own", "row", "x", "at", "passed", "n", "__name", "__top"]
    rows = spark.createDataFrame([(k, f"i{k}", "v", [2], *["kept"] * len(names)) for k in range(20)], f"ord bigint, id string, video string, response array<bigint>, {', '.join(f'`{n}` string' for n in names)}")
    some = selection.select_records(rows, 7, 3, "sorted_index_sample")
    assert some.columns == rows.columns and {tuple(r)[4:] for r in some.collect()} == {("kept",) * len(names)} and some.count() == 7
    more = builders.oversample(rows.drop("__top", "__name"), 2)
    assert more.count() == 40 and {r["rank"] for r in more.collect()} == {"kept"}


def test_simple_style_takes_every_legal_id():
    import re

    from plumbline.functions.parsing import Parser
    from plumbline.taxonomy import load_taxonomy

    taxonomy = load_taxonomy({"name": "odd", "block_name": "RESULT", "categories": [{"id": i, "name": i} for i in ("a.", "b-", "c")]})
    parser = Parser(taxonomy, "plain", "simple", "full_response", False)
    for text in ("a.b", "a. b", "b-c", "B- c", "abc", "a.", "", "xa.y", "c"):
        assert parser.decisions(text) == [re.search(rf"\b{re.escape(i)}\b", text, re.I) is not None for i in taxonomy.ids]
