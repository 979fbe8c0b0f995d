"""The registered queries: columns and rows as agreed, and the pipeline against plain steps."""

import hashlib
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plumbline.llm import bpe, quality, simhash, toxicity
from plumbline.llm.common import table
from plumbline.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_text_operators import PATH, brute_hits

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id held_out score predicted",
    "op2": "doc_id held_out score predicted",
    "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5": "doc_id fingerprint component_id",
    "op6": "page_id url text n_chars",
    "op7": "conv_id n_turns n_copies chat",
    "op8": "doc_id size text_crc32 law shard slot grown_shard",
    "op9": "query_id rank vec_id score",
    "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op12": "vec_id component n deviation whitened explained identity_error",
    "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    op = name.split("_")[0]
    wanted = COLUMNS[op].split()
    assert df.columns[: len(wanted)] == wanted
    rows = df.collect()
    source = {"op6": "pages", "op7": None, "op9": None, "op12": None, "op13": None}.get(op, "documents")
    if source:
        assert len(rows) == table(spark, SF, source).count()
    modulus = {"op1": (5, 0), "op2": (3, 1), "op3": (10, 0)}.get(op)
    if modulus:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus[0] == modulus[1]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in order) for r in QUERIES[name](spark, SF).collect())


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash_dedup", "decontamination", "byte_bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_plain_steps(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    grammar = toxicity.learn_grammar(docs, labels, spark, toxicity.train_rows(3, 1))
    rows = {i: t for i, t in rows.items() if grammar.score(grammar.channels(t)) < 0.7}
    kept = docs.where(docs.doc_id.isin(list(rows)))
    model = quality.learn(kept, labels, spark, quality.train_rows(5, 0))
    rows = {i: t for i, t in rows.items() if model.score(quality.features(t)[None])[0] >= 0.3}
    fps = {i: simhash.fingerprint(t) for i, t in rows.items()}
    component = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i in rows:
            least = min(component[j] for j in rows if (fps[i] ^ fps[j]).bit_count() <= 3)
            if least < component[i]:
                component[i], changed = least, True
    rows = {i: t for i, t in rows.items() if component[i] == i}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = {i: t for i, t in rows.items() if not brute_hits(t, items)[1]}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})
    wanted = {i: encoding.encode_ordinary(t) for i, t in rows.items()}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.ids for i, r in found.items()} == wanted
    assert all(r.decoded_sha256 == hashlib.sha256(rows[i].encode()).hexdigest() for i, r in found.items())
