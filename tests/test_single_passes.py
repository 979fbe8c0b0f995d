"""Steps that work row by row do so once a row, and on all cores."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.functions.labels import resolve_labels
from plumbline.operators import evaluate, predict
from plumbline.operators import records as checks
from plumbline.plans.recipe import run_recipe
from plumbline.sources import records, sinks, stores
from tests.backends import Echo
from tests.responses import TAX

RECIPE = """
taxonomy: safewatch
splits: {{train: "{d}/train.jsonl"}}
outputs:
  - {{kind: rl, split: train, path: "{d}/rl", label_format: index, oversample: [2], prompt: {{text: rate}}}}
  - {{kind: chat, split: train, path: "{d}/chat.jsonl", target_style: simple, prompt: {{text: task}}}}
"""


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def jobs_of(spark, group, run):
    """How many jobs an action starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_line_is_parsed_once(spark, tmp_path):
    lines = [{"id": k, "video": f"{k}.mp4", "labels": [1, "C3"][: k % 3]} for k in range(50)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = spark.read.text(str(tmp_path / "a.jsonl")).withColumnRenamed("value", "line")
    plan = optimized(records.parse_records(rows, TAX))
    assert plan.lower().count("parsejson") == 1 and plan.count("ArrayType(VariantType") == 1
    found = records.load_records(spark, str(tmp_path / "a.jsonl"), TAX)
    assert "parsejson" not in optimized(found).lower()  # later steps read what was parsed
    assert [(r.ord, r.id, r.labels) for r in found.orderBy("ord").collect()] == [(k + 1, str(k), ["C1", "C3"][: k % 3]) for k in range(50)]
    own = spark.createDataFrame([('{"id": "a", "video": "v", "labels": [null]}', 1, 2)], "line string, __data int, __spelled int")
    row = records.parse_records(own, TAX).first()
    assert (row["__data"], row["__spelled"], row.id) == (1, 2, None) and row.error.startswith("unknown label in ")


def test_an_array_of_labels_is_resolved_once(spark):
    rows = spark.createDataFrame([(["C3", "1", "C3"],), ([],), (None,)], "x array<string>")
    found = rows.select(resolve_labels(F.col("x"), TAX).alias("y"))
    assert optimized(found).count("transform(") == 1 and [r.y for r in found.collect()] == [["C1", "C3"], [], None]


def test_policies_are_counted_in_one_pass(spark):
    rows = [("a", ["C1"], "ok"), ("b", None, "missing"), ("c", None, "parse_error"), ("d", None, "missing")]
    samples = spark.createDataFrame(rows, "id string, pred array<string>, status string")
    good = samples.where("id = 'a'").coalesce(1)
    one = jobs_of(spark, "one aggregate", lambda: good.agg(F.count("*")).first())
    assert jobs_of(spark, "both policies", lambda: evaluate.check_policies(good, "error", "error")) == one
    with pytest.raises(evaluate.EvaluationError, match=r"2 samples have no prediction, e.g. \['b', 'd'\]"):
        evaluate.check_policies(samples, "error", "error")
    with pytest.raises(evaluate.EvaluationError, match=r"1 predictions are invalid, e.g. \['c'\]"):
        evaluate.check_policies(samples, "error", "negative")
    evaluate.check_policies(samples, "exclude", "negative")


def test_predictions_use_all_cores(spark):
    inputs = spark.createDataFrame([(str(k), f"v{k}") for k in range(400)], "id string, video string").coalesce(1)
    made = predict.generate(inputs, Echo, 8)
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    assert sorted(r.id for r in made.collect()) == sorted(str(k) for k in range(400))
    assert len({r[0] for r in made.select(F.spark_partition_id()).collect()}) > 1
    assert predict.generate(inputs.limit(1), Echo, 8).count() == 1 and predict.generate(inputs.where("false"), Echo, 8).count() == 0
    with pytest.raises(ValueError, match="unique"):
        predict.generate(inputs.unionByName(inputs), Echo, 8)


def test_rows_are_sorted_before_they_become_text(spark):
    rows = spark.createDataFrame([(k, f"i{k}") for k in range(9)], "ord bigint, id string")
    plan = optimized(sinks._sorted_lines(rows, "ord"))
    assert plan.index("MapInArrow") < plan.index("Sort")


def test_overlap_of_many_splits(spark):
    shared = {("i1", "v1"): (0, 33, 64), ("i2", "v2"): (31, 32), ("i3", "v3"): (64,)}
    splits = {f"s{k}": spark.createDataFrame([(i, v) for (i, v), at in shared.items() if k in at] + [(f"own{k}", f"own{k}")], "id string, video string") for k in range(65)}
    found = checks.split_overlap(splits)
    assert "collect_set" not in optimized(found)
    pairs = {(r["first"], r.second, r.kind): (r.n, r.examples) for r in found.collect()}
    assert pairs == {(f"s{a}", f"s{b}", kind): (1, [kind[0] + n]) for a, b, n in ((0, 33, "1"), (0, 64, "1"), (33, 64, "1"), (31, 32, "2")) for kind in ("id", "video")}


def test_a_recipe_reads_no_file_whole_in_the_driver(spark, tmp_path, monkeypatch):
    driver, real = os.getpid(), stores.digest

    def elsewhere(address, kind="sha256"):
        if os.getpid() == driver:
            raise AssertionError("a digest in the driver")
        return real(address, kind)

    lines = "".join(json.dumps({"id": k, "video": f"{k}.mp4", "labels": [k % 3 + 1]}) + "\n" for k in range(30))
    (tmp_path / "train.jsonl").write_text(lines)
    (tmp_path / "recipe.yaml").write_text(RECIPE.format(d=tmp_path))
    monkeypatch.setattr(stores, "digest", elsewhere)
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    done = run_recipe(spark, str(tmp_path / "recipe.yaml"))
    rl, chat = done["outputs"]
    assert rl["rows"] == 40 and chat["rows"] == 30 and rl["inputs"]["train"]["sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert chat["sha256"] == hashlib.sha256((tmp_path / "chat.jsonl").read_bytes()).hexdigest()
    assert [json.loads(x)["id"] for x in (tmp_path / "chat.jsonl").read_text().splitlines()] == [str(k) for k in range(30)]
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == kept
