"""Operators that see the corpus as a whole, against brute-force versions, and the defined edge cases of each."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import lm, quality, sharding, simhash, snapshots, topk, toxicity
from plumbline.llm.common import remainder
from plumbline.llm.components import connected_components
from plumbline.llm.eliasfano import EliasFano, Folder

DOCS = "doc_id bigint, text string, fp string, rep string, node string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum((2 * v > len(shingles)) << b for b, v in enumerate(votes))


def closed(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and (p := find(a)) != (q := find(b)):
                parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in (None, "", " \t", "One", "one two", "a b c", "a b c a b c", "É é\x0bx\x1cy z w", "q " * 70_000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choices("abcdefghij", k=120)) for _ in range(6)]
    texts = [None, "", "  ", "one", "one"]
    for t in base:
        for _ in range(12):
            w = t.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("klm")
            texts.append(" ".join(w))
    rows = [(n * 3 % 101, t) for n, t in enumerate(texts)] + [(None, base[0]), (None, "alone without id"), (0, None)]
    found = simhash.simhash_components(docs(spark, rows), spark).collect()
    fps = defaultdict(list)
    for i, t in rows:
        fps[plain_fingerprint(t)].append(i)
    named = [f for f in fps if any(i is not None for i in fps[f])]
    root = closed(named, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {r: min(i for f in named if root[f] == r for i in fps[f] if i is not None) for r in set(root.values())}
    assert len(found) == len(rows)
    for r in found:
        f = r.fp & (2**64 - 1)
        assert r.component_id == (least[root[f]] if f in root else None)
    kept = simhash.near_dedup(docs(spark, rows), spark)
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(least.values())
    assert kept.where("doc_id is null").count() == 2 and kept.columns == docs(spark, rows).columns


@pytest.mark.parametrize("n", [20, 900])
def test_buckets_lose_no_link(n):
    rng = np.random.default_rng(n)
    fp = np.unique(rng.integers(0, 2**13, n).astype(np.uint64) | (rng.integers(0, 3, n).astype(np.uint64) << np.uint64(50)))
    links = simhash.spanning_links(fp, 3)
    assert all(int(fp[a] ^ fp[b]).bit_count() <= 3 for a, b in links)
    sets = closed(list(range(len(fp))), lambda a, b: int(fp[a] ^ fp[b]).bit_count() <= 3)
    assert len(links) == len(fp) - len(set(sets.values()))


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (200, 201)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), spark).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 130), 100), 201: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), spark).count() == 0


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(docs(spark, []), spark).count() == 0
    assert simhash.near_dedup(docs(spark, []), spark).count() == 0


# conversations


def test_snapshots(spark):
    chat = ["hi", "hello", "more", "done"]
    rows = []
    for conv, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)):
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", chat[t], "x") for t in range(n)]
    rows += [(6, 0, "user", "hi", "x"), (6, 1, "assistant", "hello there", "x"), (7, 5, None, None, "x"), (8, 5, "", "", "x"), (None, 0, "user", "lost", "x"), (3, 0, "user", "hi", "y")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string")
    found = {r.conv_id: r for r in snapshots.render(table, snapshots.maximal(snapshots.prefixes(table))).collect()}
    assert {k: (r.n_turns, r.n_copies) for k, r in found.items()} == {3: (4, 2), 6: (2, 1), 7: (1, 1), 8: (1, 1)}
    assert found[6].chat == "<|user|>\nhi\n<|assistant|>\nhello there\n" and found[7].chat == found[8].chat == "<||>\n\n"
    none = table.where("false")
    assert snapshots.render(none, snapshots.maximal(snapshots.prefixes(none))).count() == 0


# sharding


def test_ring_fills_shards_evenly(spark):
    rows = [(n, f"text {n % 50}") for n in range(1003)] + [(None, None), (5, "again"), (5, "text 5")]
    found = sharding.shard_documents(docs(spark, rows), spark).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in found} == texts
    assert sharding.shard_documents(docs(spark, []), spark).count() == 0
    few = sharding.shard_documents(docs(spark, rows[:3]), spark).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_ring_moves_few_rows():
    rng = random.Random(2)
    counts = {c: rng.randint(0, 40) for c in range(4096)}
    places = [{(c, r): s for c, a, b, s, _ in sharding.runs(counts, n, 64, 4096) for r in range(a, b)} for n in (24, 25)]
    moved = sum(places[0][k] != places[1][k] for k in places[0])
    assert moved < 0.35 * len(places[0])  # dealing anew would move 24 of 25


# top-k


def brute_top(vectors, queries, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i in queries}:
        for own in [v for i, v in whole if i == q][:1]:
            scored = sorted(((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q and len(v) == len(own)))
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("block", [8, 8192])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "FIRST_DEPTH", 1)
    rng = random.Random(3)
    vectors = [(n, [rng.gauss(0, 1) for _ in range(6)]) for n in range(150)] + [(n, [1.0, 0.5] * 3) for n in range(200, 212)]
    vectors += [(300, None), (301, [None] * 6), (302, [math.nan] * 6), (303, [math.inf] * 6), (304, [1.0, 2.0]), (None, [1.0] * 6), (305, [0.0] * 6), (400, [1.0, 3.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id bigint, embedding array<double>, score int")
    found = topk.top_k(table, table.where("vec_id % 50 = 0 or vec_id = 304"), spark, 10, chunk=3)
    asked = [i for i, _ in vectors if i is not None and (i % 50 == 0 or i == 304)]
    assert {tuple(r) for r in found.collect()} == brute_top(vectors, asked, 10)
    assert topk.top_k(table.where("false"), table.where("false"), spark).count() == 0


@pytest.mark.parametrize("scale", [1, 2**28])
def test_lists_are_exact(scale):
    rng = np.random.default_rng(4)
    values = rng.integers(-5, 6, (300, 4)).astype(np.float64) * scale
    lists = topk.Lists(np.arange(300), values)
    for q in values[:20]:
        ids, best = lists.top(q, -1, 7)
        plain = sorted((-min(max(sum(int(a) * int(b) for a, b in zip(v, q)), -(2**63)), 2**63 - 1), i) for i, v in enumerate(values))[:7]
        assert list(zip((-best).tolist(), ids.tolist())) == plain


# language model


def plain_model(rows, order_two=True):
    """Counts and probabilities of the model in dictionaries."""
    train = [t for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 10]
    tok = lambda t: (t or "").encode().lower().split()
    grams = [Counter(), Counter(), Counter()]
    for t in train:
        s = ["<s>", *tok(t), "</s>"]
        grams[0].update(s[1:])
        grams[1].update(zip(s, s[1:]))
        grams[2].update(zip(s, s[1:], s[2:]))
    total, types = sum(grams[0].values()), len(grams[0])
    kept, discounts = [dict(grams[0]) | {"<s>": len(train)}], []
    for k in (1, 2):
        counts = grams[k] if k == 1 else {g: c for g, c in grams[2].items() if g[:2] in kept[1] and g[1:] in kept[1]}
        n1, n2 = (sum(c == x for c in counts.values()) for x in (1, 2))
        discounts.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5)
        kept.append({g: c for g, c in counts.items() if c >= 2})

    def probability(context, word):
        if not context:
            return (grams[0].get(word, 0) + 0.1) / (total + 0.1 * (types + 1))
        below = probability(context[1:], word)
        key = context[0] if len(context) == 1 else context
        n = kept[len(context) - 1].get(key, 0)
        if not n:
            return below
        d, nodes = discounts[len(context) - 1], kept[len(context)]
        mass = sum(c - d for g, c in nodes.items() if g[:-1] == context)
        return max(nodes.get((*context, word), 0) - d, 0) / n + (1 - mass / n) * below

    def score(t):
        s = ["<s>", *tok(t), "</s>"]
        return sum(math.log10(probability(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))

    base = lambda t: sum(math.log10(probability((), w)) for w in [*tok(t), "</s>"])
    known = lambda t: sum(w in grams[0] for w in [*tok(t), "</s>"])
    return total, base, score, known


LM_ROWS = [(n, t) for n, t in enumerate(["the cat sat on the mat", "the cat sat on the hat", "The Cat ran", "a dog sat on the mat", "the cat sat", None, "", "new words only", "the cat sat on the mat"] * 4)] + [(None, "the cat"), (3, "the dog sat")]


@pytest.mark.parametrize("small", [False, True])
def test_model_equals_plain_counts(spark, monkeypatch, small):
    if small:  # many shards and files
        for name, size in (("SHARD_COUNTS", 64), ("SHARD_NODES", 4), ("SLICE", 16), ("SHARD_WORDS", 8)):
            monkeypatch.setattr(lm, name, size)
    rows = [*LM_ROWS, (1000, "zebra " * 300)]
    found = lm.language_model_scores(docs(spark, rows), spark, remainder(F.col("doc_id"), 10) != 0).collect()
    total, base, score, known = plain_model(rows)
    by = defaultdict(list)
    for r in found:
        by[r.doc_id, r.n_tokens].append(r)
    assert len(found) == len(rows)
    for i, t in rows:
        n = len((t or "").split()) + 1
        r = by[i, n][0]
        assert r.train == bool(zlib.crc32(str(i if i is not None else "").encode()) % 10)
        assert r.train_tokens == total and r.n_known == known(t)
        assert r.base_score == pytest.approx(base(t), rel=1e-9)
        assert r.score == pytest.approx(score(t), abs=5e-4 * n)


def test_model_without_training_rows(spark):
    found = lm.language_model_scores(docs(spark, [(1, "a b"), (2, None)]), spark, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert lm.language_model_scores(docs(spark, []), spark, F.lit(True)).count() == 0


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (7, 7), (500, 10**6), (3000, 2**64)])
def test_elias_fano(n, universe, tmp_path):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    folder = Folder(f"file://{tmp_path}")
    folder.write("x", EliasFano.build(values, universe))
    e = EliasFano(folder.read("x"))
    assert (e.access(np.arange(n)) == values).all()
    asked = np.r_[values, rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True)].astype(np.uint64)
    assert (e.successor(asked) == np.searchsorted(values, asked)).all()
    assert ((e.find(asked) >= 0) == np.isin(asked, values)).all()


def test_runs_pack():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(0, 2**40, 1000).astype(np.uint64), return_counts=True)
    assert all((a == b).all() for a, b in zip(lm.unpack_run(lm.pack_run(keys, counts)), (keys, counts)))


# trained operators


def test_toxicity_grammar():
    g = toxicity.Grammar()
    score = lambda t: g.score(g.channels(t))
    assert score("You are an idiot and a worthless loser.") > 0.7
    assert score("I will kill you. You idiot!") > 0.5
    assert score(None) == score("") == score("A calm and friendly text.") < 0.2
    assert score("You are not an idiot.") < score("You are an idiot.") > score('She said he called them an idiot.')
    aimed, plain, threat, denied, quoted, _ = g.channels("You idiot! It is trash. I will hurt you. You are no moron. He said scum.")
    assert min(aimed, plain, threat, denied, quoted) > 0
    assert g.channels("idiot " * 50_000)[1] > 1000


def planted(n, rng, good, bad):
    words = [f"w{k}" for k in range(400)]
    for i in range(n):
        y = int(rng.random() < 0.3)
        text = rng.choices(words, k=40) + (rng.choices(bad, k=4) if y else rng.choices(good, k=4))
        rng.shuffle(text)
        yield i, " ".join(text), y


def test_toxicity_learns_terminals(spark):
    rng = random.Random(6)
    rows = list(planted(900, rng, ["kind"], ["zarkou", "zarkel", "zarkim", "zarkan", "blerg"]))
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "blerg"), (5000, None)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (None, 1), (99999, 1)], "doc_id bigint, toxic int")
    grammar = toxicity.learn_grammar(table, labels, spark, toxicity.train_rows(3, 1))
    found = {r.doc_id: r.score for r in toxicity.scores(table, grammar, spark).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((found[i] >= 0.7) == y for i, y in held) > 0.97 * len(held)
    kept = toxicity.keep_clean(table, grammar, spark)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s < 0.7}
    bare = toxicity.learn_grammar(table, labels.where("false"), spark, toxicity.train_rows(3, 1))
    assert bare.stems == {} and toxicity.scores(docs(spark, []), bare, spark).count() == 0


def test_quality_learns_and_handles_edges(spark):
    rng = random.Random(7)
    rows = []
    for i in range(700):
        y = int(rng.random() < 0.8)
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words) + "." if y else " ".join(w + rng.choice(["$$$", "%%%"]) for w in words), y))
    table = docs(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (9002, "w " * 50_000), (None, "x")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None)], "doc_id bigint, quality int")
    model = quality.learn(table, labels, spark, quality.train_rows(5, 0))
    found = {r.doc_id: r.score for r in quality.scores(table, model, spark).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.3) == y for i, y in held) > 0.97 * len(held)
    assert len(found) == 704 and all(0 <= s <= 1 for s in found.values()) and found[9000] == found[9001]
    kept = quality.keep_good(table, model, spark)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s >= 0.3}
    bare = quality.learn(table, labels.where("false"), spark, quality.train_rows(5, 0))
    assert len({r.score for r in quality.scores(table, bare, spark).collect()}) == 1
    assert quality.scores(docs(spark, []), model, spark).count() == 0
