"""The pipeline and its stages on rows that a corpus shouldn't have, and on none."""

import hashlib

import pytest

import corpus_pipeline
from plumbline.llm import decontaminate, simhash, toxicity

GOOD = "A quiet morning by the river, with boats and birds, and people who walk along the water. " * 3
WINDOW = "these ten words stand in one item of the benchmark"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, item string, text_key binary"


def folder(spark, path, rows, labels=((1, 1, 0), (2, 1, 0)), items=((1, WINDOW), (2, None), (None, ""))):
    """Tables of documents with columns whose names the operators use themselves."""
    table = spark.createDataFrame([(i, t, None, None, None, 0.5, "f", "i", b"k") for i, t in rows], SCHEMA)
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_no_rows_at_all(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, GOOD), (2, GOOD), (2, GOOD),  # copies, and a repeated row
        (3, None), (4, ""), (5, " \n\t "),  # nothing
        (6, GOOD + " " + WINDOW + " " + GOOD),
        (7, "You are an idiot and a worthless loser. You moron! You are scum."),
        (8, "long " * 60_000), (9, "x"), (9, "y z w v u t"),  # very long; one id, two texts
        (None, GOOD), (None, None), (None, "Something of its own that nobody else has written down."),
        (10, "é ü   日本 🙂 " * 4),
    ]
    sf = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    found = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [x[:2] for x in ids]
    assert {6, 7, 2}.isdisjoint(r.doc_id for r in found) and {1, 8, 10} <= {r.doc_id for r in found}
    texts = {hashlib.sha256(t.encode()).hexdigest() for _, _, t in ids}
    assert {r.decoded_sha256 for r in found} == texts
    assert [r.n_tokens for r in found if r.doc_id in (3, 4)] in ([], [0])


def test_labels_without_rows_and_one_kind_only(spark, tmp_path):
    for k, labels in enumerate(([(1, None, None), (99, 1, 1)], [(1, 0, 0), (2, 0, 0)], [(1, 1, 1), (2, 1, 1)])):
        sf = folder(spark, tmp_path / str(k), [(1, GOOD), (2, "Some other text of good words, with a full stop.")], labels)
        assert corpus_pipeline.run(spark, sf).count() >= 1


@pytest.mark.parametrize("text", ["idiot " * 50_000, '"' * 50_000 + " idiot", "." * 50_000, "you " * 50_000 + "will kill you"])
def test_long_clauses_are_read_whole(text):
    assert (toxicity.Grammar().channels(text)[:5] > 0).any() == any(w in text for w in ("idiot idiot", "kill"))


def test_columns_of_any_name_are_carried(spark, tmp_path):
    names = ["_key", "__key", "key", "fp", "root", "rank", "place", "N", "__drawn", "kept_id", "near", "y"]
    rows = [(1, GOOD), (2, GOOD), (3, GOOD + " " + WINDOW + " " + GOOD), (4, "Some other text of good words, with a full stop."), (None, GOOD)]
    table = spark.createDataFrame([(i, t, *names) for i, t in rows], f"doc_id bigint, text string, {', '.join(f'`{n}` string' for n in names)}")
    folder(spark, tmp_path, [])
    sf = str(tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, sf)
        assert kept.columns == table.columns, name
        assert {tuple(r)[2:] for r in kept.collect()} == {tuple(names)}, name
    assert sorted(r.doc_id or 0 for r in simhash.near_dedup(table, spark).collect()) == [0, 1, 3, 4]
    assert sorted(r.doc_id or 0 for r in simhash.near_dedup(table, spark, similar=0.8).collect()) == [0, 1, 3, 4]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    for small in (8 << 20, 0):  # both plans
        assert sorted(r.doc_id or 0 for r in decontaminate.clean_documents(table, items, spark, small=small).collect()) == [0, 1, 2, 4]
