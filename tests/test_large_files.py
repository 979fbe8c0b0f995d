"""Files that are split, read piece by piece, or written part by part, against plain reading and writing of the whole."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.plans.fixtures import TAXONOMY as TAX
from plumbline.sources import adapters, arrays, ordered, sinks, stores
from plumbline.sources.lines import lines
from plumbline.sources.records import DataError, load_json_lines, load_records


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "500"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    r, wanted = random.Random(1), {}
    for name in ("a.txt", "b.txt", "empty.txt"):
        text = "" if name == "empty.txt" else "".join("x" * r.randint(0, 60) + r.choice(["\n", "\r\n", "\r", "\n\n", " \n"]) for _ in range(5000)) + "no end"
        (tmp_path / name).write_text(text, newline="")
        wanted |= {(name, k): x for k, x in enumerate(re.split(r"\r\n|\n|\r", text), 1) if x.strip()}
    found = lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert {(x.path.rpartition("/")[2], x.ord): x.line for x in found.collect()} == wanted


def test_bad_lines_are_named_over_splits(spark, tmp_path, small_splits):
    good = [json.dumps({"id": f"r{k}", "video": "v", "labels": []}) for k in range(3000)]
    (tmp_path / "good.jsonl").write_text("\n".join(good) + "\n\n")
    found = load_records(spark, str(tmp_path / "good.jsonl"), TAX)
    assert [(x.ord, x.id) for x in found.orderBy("ord").collect()] == [(k + 1, f"r{k}") for k in range(3000)]
    (tmp_path / "bad.jsonl").write_text("\n".join([*good[:2500], "{", *good[2500:], "["]))
    with pytest.raises(DataError, match=r"bad\.jsonl:2501: invalid JSON"):
        load_records(spark, str(tmp_path / "bad.jsonl"), TAX)
    with pytest.raises(Exception, match=r"bad\.jsonl:(2501|3002): invalid JSON"):
        load_json_lines(spark, str(tmp_path / "bad.jsonl"), "id string").collect()


VALUES = [1, -2.5, True, None, "é \" \\ ] } {", {"a": [1, {"b": "]"}]}, [], {}, [[1], [2]], "x" * 200, 1e300, " \n\t"]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_items_of_arrays_piece_by_piece(tmp_path, size):
    path, r = tmp_path / "a.json", random.Random(size)
    for indent in (None, 2):
        for n in (0, 1, 40):
            wanted = [r.choice(VALUES) for _ in range(n)]
            for document, unwrap in ((wanted, False), (wanted, True), ({"items": wanted}, True)):
                path.write_text(" " + json.dumps(document, indent=indent, ensure_ascii=size % 2 == 0) + "\n", encoding="utf-8")
                assert [json.loads(x) for x in arrays.items(str(path), unwrap, size)] == wanted
    for document in ({}, {"a": 1}, {"a": [1], "b": [2]}, {"a": [1], "b": 2}, {"b": 2, "a": [1]}, "text", 12345678, None):
        path.write_text(json.dumps(document))
        assert [json.loads(x) for x in arrays.items(str(path), True, size)] == [document]
        with pytest.raises(arrays.ArrayError, match="array is needed"):
            list(arrays.items(str(path), False, size))


@pytest.mark.parametrize("text", ["", "[", "[1", "[1,", "[1 2]", "[1,]", '["a', "[tru]", "[1] 2", '[{"a": 1]', '{"a": [1, 2}', '{"a" [1]}'])
@pytest.mark.parametrize("size", [1, 1 << 20])
def test_broken_arrays_name_their_file(tmp_path, text, size):
    (tmp_path / "odd.json").write_text(text)
    with pytest.raises(arrays.ArrayError, match=r"odd\.json"):
        list(arrays.items(str(tmp_path / "odd.json"), True, size))


def test_a_large_array_comes_in_small_rows(spark, tmp_path):
    videos = [{"id": k, "video": f"dataset/full/{k}.mp4", "text": "é" * (k % 90)} for k in range(60_000)]
    truth = [{"video_path": v["video"], "labels": [f"C{v['id'] % 6 + 1}"], "subcategories": ["s"]} for v in videos if v["id"] % 2]
    (tmp_path / "in" / "f1").mkdir(parents=True)
    (tmp_path / "in" / "f1" / "full.json").write_text(json.dumps(videos, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "in" / "f1" / "full_gt.json").write_text(json.dumps(truth))
    items = arrays.array_items(spark, str(tmp_path / "in"), size=1 << 14)
    assert items.agg(F.max(F.length("item"))).first()[0] < 1000
    assert [json.loads(r.item) for r in items.where("path LIKE '%full.json'").orderBy("place").collect()] == videos
    found = adapters.folder_annotations(spark, str(tmp_path / "in"), TAX).orderBy("ord").collect()
    assert [(r.ord, r.id, r.labels) for r in found] == [(k + 1, f"full/{k}.mp4", [f"C{k % 6 + 1}"] if k % 2 else []) for k in range(60_000)]


def test_one_ordered_file_of_many_parts(spark, tmp_path):
    n = 20_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("ord"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("line")).repartition(9)
    wanted = {r.ord: r.line for r in df.collect()}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = tmp_path / "new" / "all.txt"
        assert ordered.write_ordered(df, "ord", str(path), ("# one", "# two")) == n
        assert path.read_text(encoding="utf-8") == "# one\n# two\n" + "".join(wanted[k] + "\n" for k in range(n))
        with pytest.raises(FileExistsError):
            ordered.write_ordered(df, "ord", str(path))
        assert ordered.write_ordered(df.where("ord < 3"), "ord", f"file://{path}", overwrite=True) == 3
        assert path.read_text(encoding="utf-8") == "".join(wanted[k] + "\n" for k in range(3))
        assert ordered.write_ordered(df.where("false"), "ord", str(tmp_path / "none.txt")) == 0 and (tmp_path / "none.txt").read_bytes() == b""
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".")) == ["all.txt", "none.txt"]


def test_parts_are_streamed_where_offsets_cannot_be_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "AT_OFFSETS", ())
    df = spark.range(50).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("line")).repartition(5)
    ordered.write_ordered(df, "ord", str(tmp_path / "x.txt"), ("# h",))
    assert (tmp_path / "x.txt").read_text() == "# h\n" + "".join(f"{k}\n" for k in range(50))


def test_json_rows_keep_every_kind_of_value(spark, tmp_path):
    rows = [(2, "é", [1, 2], {"a": 1.5}, (1, None), '{"ord": 9, "more": [1.5, null, "x"]}'), (1, None, [], {}, (None, "s"), None)]
    df = spark.createDataFrame(rows, "ord int, text string, list array<int>, m map<string,double>, s struct<a:int,b:string>, v string")
    df = df.withColumn("extra", F.parse_json("v")).drop("v")
    assert sinks.write_json_lines(df, str(tmp_path / "x.jsonl")) == 2
    assert (tmp_path / "x.jsonl").read_text(encoding="utf-8").splitlines() == [
        '{"text": null, "list": [], "m": {}, "s": {"a": null, "b": "s"}}',
        '{"text": "é", "list": [1, 2], "m": {"a": 1.5}, "s": {"a": 1, "b": null}, "more": [1.5, null, "x"], "ord": 9}',
    ]


def test_digests_are_taken_where_the_rows_are(spark, tmp_path):
    import hashlib

    (tmp_path / "deep").mkdir()
    data = {"a.bin": b"", "deep/b c.bin": random.Random(1).randbytes(3 << 20)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        assert {r.name: r.sha256 for r in sinks.checksums(spark, folder).collect()} == {k: hashlib.sha256(v).hexdigest() for k, v in data.items()}
    assert stores.digest(str(tmp_path / "deep/b c.bin"), "md5") == hashlib.md5(data["deep/b c.bin"]).hexdigest()
