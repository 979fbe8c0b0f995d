"""Word BPE against the library, whitening against a dense decomposition, the prefix trie against plain dictionaries."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import prefixtrie, whitening, wordbpe
from plumbline.llm.common import table
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["the", "Hello", "ΣΑΣ", "é", "é", "中文", "한국", "\U00010d50", "࣏࣍", "<|endoftext|>", "<|startoftext|>", "<|ENDOF", "aaaa", "====", "'S", "'ll", "12", " ", "\n", " ", "\x85", "İ", "ﬁ", "😀", "\0", "</w>", "x" * 50]


TOKENIZER = Tokenizer.from_file(WORDS)


def library(text):
    t = TOKENIZER
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_words_equal_the_library(spark):
    r = random.Random(5)
    texts = [None, "", " ", "a" * 3001, "ab" * 2000, "=-" * 2000, "".join(r.choice("abcdefgh") for _ in range(4000)), "<|endoftext|>", *("".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(300))]
    rows = [(i % 200, t, "x", "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, ids string")
    found = wordbpe.encode_table(df, WORDS, ids=True, decoded=True).collect()
    assert len(found) == len(rows)
    wanted = Counter()
    for i, t, *_ in rows:
        ids, decoded = library(t)
        wanted[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids), decoded] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, tuple(x.ids), x.decoded) for x in found) == wanted
    assert wordbpe.encode_table(df.where("false"), WORDS).collect() == []


def test_words_of_whole_table_equal_the_library(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op11_word_bpe"](spark, SF).collect():
        ids, decoded = library(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_no_token_lies_over_a_forced_boundary():
    vocab = wordbpe.vocabulary(WORDS)
    words = [w.encode() for w in ("hello", "x=y", "q中文z", "zzzqj", "~~==")]
    symbols, start, counts = wordbpe.fragments(vocab, words)
    assert counts.sum() == len(start) and len(start) > len(words)
    ends = set(np.cumsum([len(w) for w in words]).tolist())
    inside = {i for i in range(1, len(symbols)) if i not in ends and i not in set(start.tolist())}
    for i in range(1, len(symbols)):
        if i not in ends:
            assert (i in inside) == vocab.inside[symbols[i - 1] * 512 + symbols[i]]
    r = random.Random(3)
    long = [np.array([r.randrange(97, 105) for _ in range(n)]) for n in (3, 40, 900)]
    flat, sizes = wordbpe.merge_fragments(vocab, np.concatenate(long), np.array([0, 3, 43]))
    assert flat.tolist() == [t for x in long for t in wordbpe.merge_long(vocab, x)] and sizes.sum() == len(flat)


def test_other_tokenizer_files_are_refused(tmp_path):
    with pytest.raises((ValueError, KeyError, AttributeError, TypeError)):
        wordbpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    file = json.loads(open(WORDS, encoding="utf-8").read())
    file["model"]["merges"][:2] = file["model"]["merges"][700:702]
    (tmp_path / "odd.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="build on earlier"):
        wordbpe.Vocabulary(str(tmp_path / "odd.json"))


def plain_whitening(vectors, k=8):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return n, deviations, centred @ basis / np.sqrt(values), values / np.linalg.eigvalsh(centred.T @ centred / n).sum()


def test_whitening_equals_dense_decomposition(spark):
    vectors = table(spark, SF, "embeddings").orderBy("vec_id").collect()
    n, deviations, white, explained = plain_whitening([r.embedding for r in vectors])
    found = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    place = {r.vec_id: i for i, r in enumerate(vectors)}
    signs = {r.component: math.copysign(1, r.whitened * white[place[r.vec_id], r.component - 1]) for r in found if r.vec_id == vectors[0].vec_id}
    for r in found:
        i, j = place[r.vec_id], r.component - 1
        assert r.deviation == deviations[i]
        assert r.whitened * signs[r.component] == pytest.approx(white[i, j], abs=1e-9)
        assert r.explained == pytest.approx(explained[j], rel=1e-10)
        assert 0 <= r.identity_error < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    r = random.Random(2)
    good = [(i % 30, [r.gauss(0, 1), r.gauss(5, 2), r.gauss(-3, 0.5)], "a") for i in range(40)]
    bad = [(1, None, "a"), (2, [], "a"), (3, [1.0, None, 2.0], "a"), (4, [1.0, nan, 2.0], "a"), (5, [1.0, 2.0, -inf], "a"), (6, [1.0, 2.0], "a"), (None, [0.5, 0.5, 0.5], "a")]
    df = spark.createDataFrame([*good, *bad], "vec_id bigint, embedding array<double>, n string").withColumn("component", F.lit("x"))
    found = whitening.whitened_table(df, spark).collect()
    kept = [v for i, v, _ in good] + [[0.5, 0.5, 0.5]]
    n, deviations, white, _ = plain_whitening(kept)
    assert {x.n for x in found} == {41} and {x.component for x in found} == {1, 2, 3} and len(found) == 123
    assert sorted(x.deviation for x in found) == sorted(d for d in deviations for _ in range(3))
    assert sorted(abs(x.whitened) for x in found if x.component == 2) == pytest.approx(sorted(map(abs, white[:, 1])))
    assert {x.vec_id for x in found} == {*range(30), None}
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whitened_table(spark.createDataFrame(rows, schema), spark).collect() == []
    line = whitening.whitened_table(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], schema), spark).collect()
    assert {x.component for x in line} == {1} and len(line) == 4 and line[0].explained == pytest.approx(1)
    huge = whitening.whitened_table(spark.createDataFrame([(i, [1e30 * i, float(i * i)]) for i in range(-2, 3)], "vec_id bigint, embedding array<double>"), spark).collect()
    assert max(x.deviation for x in huge) == (1 << 63) - 1 and {x.component for x in huge} >= {1}


def plain_trie(rows):
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            conversations[c].append((t is not None, t or 0, said[0], hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest(), said))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in conversations.items()}
    whole, members = {}, defaultdict(list)
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == p).encode()).hexdigest() for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def tries(df, spark):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in prefixtrie.prefix_trie(df, spark).collect())


def test_trie_equals_plain_dictionaries(spark):
    df = table(spark, SF, "conversations")
    assert tries(df, spark) == plain_trie([tuple(r) for r in df.collect()])


def test_trie_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "AHEAD", 3)  # so that following turns are fetched more than once
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["", None, "é", "hi"])) for c in range(-7, 25) for t in range(r.randint(1, 9))]
    rows += [(None, 1, "user", "nobody"), (3, None, "user", "first"), (3, None, None, None), (4, 1, "user", "tie"), (4, 1, "user", "tie"), (4, 1, "bot", "tie")]
    rows += [(50, t, "user", f"turn {t}") for t in range(20)] + [(c, t, "user", f"turn {t}") for c in (51, 55) for t in range(7 + c % 5)]
    rows += [(100 + c, 0, "system", "the same") for c in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)
    extra = df.withColumns({"depth": F.lit("x"), "place": F.lit(1), "key": F.lit("k"), "node": F.lit(2)})
    assert tries(extra, spark) == plain_trie(rows)
    assert tries(df.where("false"), spark) == []
    assert tries(df.where("conv_id is null"), spark) == []
    for turns in ([(9, 0, "user", "one")], [(7, t, "u", "x") for t in range(2)]):
        assert tries(spark.createDataFrame(turns, df.schema), spark) == plain_trie(turns)


def test_trie_of_a_conversation_over_many_ranges(spark):
    rows = [(6, t % 50, "user", "again") for t in range(300)] + [(c, t, "user", str(t)) for c in range(9) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefixtrie.turn_rows(df, spark)
        six = turns.where("conv_id = 6").agg(F.min("place"), F.max("place"), F.count_distinct("place"), F.max("cum")).first()
        assert tuple(six) == (1, 305, 305, 5 * 300 + 5)
        assert tries(df, spark) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
