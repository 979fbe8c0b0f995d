"""Operators against plain versions of their methods: densities by recursion, a ring walked row by row, numeric gradients."""

import html
import math
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import eliasfano, htmltext, lm, quality, sharding, simhash
from plumbline.llm.common import about
from tests.llm.test_corpus_operators import docs

# composite text density

BLOCK_TAGS, INLINE_TAGS = ("div", "section", "article"), ("b", "i", "a", "span")


def random_node(rng, depth):
    """(tag, parts): a block of texts, inline elements and blocks."""
    if depth == 0 or rng.random() < 0.3:
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = " ".join(rng.choices(["word", "other", "more", "text,", "end."], k=rng.randint(1, 25)))
            plain = rng.random() < 0.6 and not (parts and isinstance(parts[-1], str))
            parts.append(words if plain else (rng.choice(INLINE_TAGS), [words]))
        return "p", parts
    return rng.choice(BLOCK_TAGS), [random_node(rng, depth - 1) for _ in range(rng.randint(1, 4))]


def markup(node):
    return html.escape(node) if isinstance(node, str) else f"<{node[0]}>{' '.join(map(markup, node[1]))}</{node[0]}>"


def figures(node, linked=False):
    """Characters, tags, link characters and link tags below a node."""
    if isinstance(node, str):
        return np.array([len(node), 0, len(node) if linked else 0, 0])
    linked |= node[0] == "a"
    out = sum((figures(x, linked) for x in node[1]), np.zeros(4, int))
    return out + sum(np.array([0, 1, 0, x[0] == "a"]) for x in node[1] if not isinstance(x, str))


def density(c, t, lc, lt, share):
    if not c:
        return 0.0
    t = max(1, t)
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    inner = max(1.0, c / max(1, lc) * t / max(1, lt))
    return c / t * math.log(inner + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-12 else c / t * math.log(max(1.0, c * t))


def plain_text(body):
    c, _, lc, _ = figures(body)
    share = lc / max(1, c)
    dense = lambda node: density(*figures(node), share)
    is_block = lambda x: not isinstance(x, str) and x[0] in htmltext.BLOCKS
    blocks = []  # with their paths, in page order

    def walk(node, path):
        blocks.append((node, path))
        for x in node[1]:
            if is_block(x):
                walk(x, [*path, node])

    walk(body, [])

    def total(node):
        inner = [x for x in node[1] if is_block(x)]
        if not inner:
            return dense(node)
        rest = (node[0], [x for x in node[1] if not is_block(x)])
        return density(*figures(rest), share) + sum(map(dense, inner))

    best = max(total(b) for b, _ in blocks)
    core, path = next(x for x in blocks if math.isclose(total(x[0]), best, rel_tol=1e-12))
    path = [*path, core]
    least = min(map(dense, path))
    taken = {id(core)}
    for above, below in zip(path, path[1:]):
        taken.update(id(x) for x in above[1] if is_block(x) and x is not below and dense(x) >= least)
    out = []

    def gather(node, inside):
        inside |= id(node) in taken
        if node[0] == "p":
            words = " ".join(x if isinstance(x, str) else x[1][0] for x in node[1])
            if inside and words:
                out.append(words)
            return
        for x in node[1]:
            gather(x, inside)

    gather(body, False)
    return "\n\n".join(out)


def test_text_density_equals_plain_recursion():
    rng, cut = random.Random(12), 0
    for _ in range(300):
        body = ("body", [random_node(rng, rng.randint(1, 4)) for _ in range(rng.randint(1, 4))])
        wanted = plain_text(body)
        assert htmltext.main_text(f"<html>{markup(body)}</html>") == wanted
        cut += wanted != plain_text(("body", [("p", [" "])])) and wanted.count("\n\n") + 1 < markup(body).count("<p>")
    assert cut > 30  # the choice isn't always everything


@pytest.mark.parametrize("page", ["<b>{n}</i>{n}", "<i><div><b>{n}</i>{n}", "<b>{n}<hr>{n}", "<a \"x' {n}", "<p><b>x {n}", "</p>{n}"])
def test_hostile_pages_take_linear_time(page):
    def seconds(n):
        first, *rest = page.split("{n}")
        built = "".join((x + " ") * n if k == 0 else x * n for k, x in enumerate([first, *rest]) if x)
        start = time.process_time()
        htmltext.main_text(built)
        return time.process_time() - start

    small, large = min(seconds(4_000) for _ in range(3)), seconds(32_000)
    assert large < 40 * max(small, 0.005)


def test_density_alone_leaves_menus_and_links_out(monkeypatch):
    for lists in ("NAMES", "HEADERS", "OWN_NAMES", "OWN_TAGS", "ROLES", "DROPPED"):
        monkeypatch.setattr(htmltext, lists, frozenset())
    paragraphs = [f"Paragraph {k} of the story goes on for a good while, with words enough in it to be read as an article." for k in range(6)]
    links = lambda n, word: " ".join(f'<a href="/{k}">{word} {k}</a>' for k in range(n))
    story = "".join(f"<p>{p}</p>" for p in paragraphs)
    for nav, box, foot in (("div", "div", "div"), ("nav", "aside", "footer")):
        page = f"<body><{nav}>{links(8, 'Section')}</{nav}><div><div>{story}</div><{box}>{links(6, 'More stories like this')}</{box}></div><{foot}><span>Terms</span> {links(5, 'Legal')}</{foot}></body>"
        assert htmltext.main_text(page).split("\n\n") == paragraphs


# bounds of a level's files


@pytest.mark.parametrize("parts", [2, 7, 300])
def test_only_bounds_come_to_the_driver(spark, monkeypatch, parts):
    rng = np.random.default_rng(parts)
    keys = np.unique(rng.integers(0, 1 << 64, 900, np.uint64))
    keys = keys[(keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60) == 0]
    rows = spark.createDataFrame([(True, 1, 1, 0.0, [0])] * 3, "train boolean, doc_id bigint, n_tokens bigint, base_score double, ids array<int>")
    monkeypatch.setattr(lm, "_keys", lambda *_: iter([keys]))
    monkeypatch.setattr(lm, "Reader", lambda model: None)
    model = type("M", (), {"tokens": 1})()
    wanted = np.unique(keys[np.arange(1, parts) * len(keys) // parts])
    assert lm._bounds(rows, model, 2, parts).tolist() == wanted.tolist()


# the ring


def plain_shards(rows, shards, vnodes, cells):
    """Row by row: everyone tries the next virtual node, and in further rounds those that found it full go on clockwise."""
    nodes = sharding.ring(shards, vnodes, cells)
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    load, out = [0] * shards, {}
    cell_of = lambda r: r[0] * cells >> 64
    waiting = [(r, next((k for k, (c, _) in enumerate(nodes) if c >= cell_of(r)), 0)) for r in sorted(rows)]
    while waiting:
        later = []
        for r, k in waiting:
            shard = nodes[k % len(nodes)][1]
            if load[shard] < room[shard]:
                out[r] = (shard, load[shard])
                load[shard] += 1
            else:
                later.append((r, k))
        waiting = []
        for r, k in later:
            k += 1
            while load[nodes[k % len(nodes)][1]] == room[nodes[k % len(nodes)][1]]:
                k += 1
            waiting.append((r, k))
    return out


def test_ring_equals_walk_row_by_row(spark):
    rows = [(i, f"text {i % 150}") for i in range(700)]
    table = docs(spark, rows)
    hashes = {r.doc_id: r.h & (1 << 64) - 1 for r in table.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    wanted = plain_shards([(hashes[i], i) for i, _ in rows], 6, 8, 256)
    found = {r.doc_id: r for r in sharding.shard_documents(table, spark, 6, 8, 256).collect()}
    # slots follow the cell; shards are what the walk decides
    assert {i: found[i].shard for i in found} == {i: s for (_, i), (s, _) in wanted.items()}
    for shard in range(6):
        assert sorted(r.slot for r in found.values() if r.shard == shard) == list(range(sum(s == shard for s, _ in wanted.values())))


def test_ring_moves_few_rows(spark):
    table = spark.range(20_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    one, more = ({r.doc_id: r.shard for r in sharding.shard_documents(table, spark, n).collect()} for n in (24, 25))
    assert sum(one[i] != more[i] for i in one) < 0.1 * len(one)


def test_ring_with_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FEW", 10)
    monkeypatch.setattr(sharding, "HOT", 2)
    same = spark.range(0, 900, 1, 8).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text")
    table = same.unionByName(spark.range(300).selectExpr("id AS doc_id", "concat('t', id) AS text"))
    found = sharding.shard_documents(table, spark).collect()
    assert len(found) == 1200 and len({(r.shard, r.slot) for r in found}) == 1200
    sizes = [sum(r.shard == s for r in found) for s in range(24)]
    assert set(sizes) == {50}


def test_places_in_hot_cells_depend_on_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FEW", 50)
    monkeypatch.setattr(sharding, "HOT", 4)
    rows = [(i, f"text {i}") for i in range(1999)] + [(None, "again and again")] * 500 + [(7, None)] * 400
    places = []
    for parts in (3, 16):
        found = sharding.shard_documents(docs(spark, rows).repartition(parts), spark, 6, 2, 32).collect()
        places.append(sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.shard, r.slot) for r in found))
    assert places[0] == places[1] and len({p[2:] for p in places[0]}) == len(rows)


# positive-unlabelled risk


def test_risk_and_gradient_are_those_of_the_formula():
    rng = np.random.default_rng(5)
    p, u = np.c_[rng.normal(1, 1, (40, 3)), np.ones(40)], np.c_[rng.normal(0, 1, (90, 3)), np.ones(90)]
    plus, minus = (lambda g: np.log(1 + np.exp(-g))), (lambda g: np.log(1 + np.exp(g)))
    for prior in (0.2, 0.7, 0.95):
        for scale in (0.1, 1.0, 4.0):
            points = rng.normal(0, scale, (3, 4))
            sums = quality.Sums.of(u[:50], points) + quality.Sums.of(u[50:], points)
            positive, negative = quality.nn_risk(p, sums, prior, points)
            for k, w in enumerate(points):
                part = lambda w: (prior * plus(p @ w).mean(), minus(u @ w).mean() - prior * minus(p @ w).mean())  # noqa: B023, E731
                assert (positive[k], negative[k]) == pytest.approx(part(w))
                # where the negative part is below zero the step climbs on it
                aim = (lambda w: sum(part(w))) if negative[k] >= 0 else (lambda w: -part(w)[1])  # noqa: B023
                numeric = [(aim(w + e) - aim(w - e)) / 2e-5 for e in np.eye(4) * 1e-5]
                assert quality.risk_gradient(p, sums, prior, points, k) == pytest.approx(numeric, abs=1e-6)


def test_prior_is_estimated_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(6)
    for true in (0.2, 0.5, 0.8):
        p = rng.normal(2, 1, 4000)
        u = np.r_[rng.normal(2, 1, int(20_000 * true)), rng.normal(-2, 1, int(20_000 * (1 - true)))]
        found = quality.estimate_prior(p, lambda cuts: (len(u), (u >= cuts[:, None]).sum(1)))  # noqa: B023
        assert found == pytest.approx(true, abs=0.06)


def test_bad_labels_are_never_looked_at(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("".join(rng.choices("abcde", k=rng.randint(2, 8))) + ("%%" if i % 4 == 0 else "") for _ in range(30))) for i in range(300)]
    table = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    one, two = (quality.learn(table, x, spark, F.lit(True)) for x in (labels, labels.where("quality = 1")))
    assert (one.weights == two.weights).all() and one.offset == two.offset


def test_quality_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    model = quality.learn(docs(spark, []), labels, spark, F.lit(True))
    assert quality.scores(docs(spark, [(1, "x"), (2, None)]), model, spark).collect() == [(1, 0.5), (2, 0.5)]


# near-duplicates in hot buckets


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    rng = random.Random(8)
    fps = set()
    for _ in range(60):  # clusters, and a third of all in one segment value
        base = rng.getrandbits(64) if rng.random() < 0.6 else 0xABCDEF12 << 32 | rng.getrandbits(32)
        for _ in range(rng.randint(1, 9)):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f, f) for f in signed], "rep bigint, fp bigint")

    def groups(links):
        parent = {f: f for f in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        by = {}
        for f in signed:
            by.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, by.values()))

    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    wanted = groups([(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if near(a, b)])
    for hot in (4096, 5):
        monkeypatch.setattr(simhash, "HOT", hot)
        assert (len(simhash.hot_values(table)) > 0) == (hot == 5)
        found = [(r.a, r.b) for r in simhash.near_links(table).collect()]
        assert all(near(a, b) for a, b in found) and groups(found) == wanted


def test_ring_hash_places():
    assert sharding.ring(1, 1, 1 << 20) == [(xxhash.xxh64_intdigest("shard 0 node 0", 42) >> 44, 0)]


# files of the trie


def test_few_files_stay_open(tmp_path):
    folder = eliasfano.Folder(f"file://{tmp_path}")
    for k in range(6):
        folder.write(f"f{k}", eliasfano.prefixed("s", eliasfano.EliasFano.build(np.arange(k, 100 + k).astype(np.uint64), 200)))
    opened = eliasfano.Opened(folder, 2)
    for k in [0, 1, 0, 2, 5, 0, 4, 3]:
        assert opened.get(f"f{k}", ("s",))["s"].access(np.array([7])).tolist() == [7 + k] and len(opened.files) <= 2


@pytest.mark.parametrize("width", [1, 7, 21, 32, 63])
def test_nodes_are_found_between_their_pointers(width):
    rng = np.random.default_rng(width)
    words = min(1 << width, 5000)
    keys = np.unique(np.stack([rng.integers(0, 40, 900), rng.integers(0, words, 900)], 1), axis=0).astype(np.uint64)
    contexts = 41 if width < 58 else int(keys[:, 0].max()) % 2 + 1
    keys = keys[keys[:, 0] < contexts]
    e = eliasfano.EliasFano(eliasfano.EliasFano.build((keys[:, 0] << np.uint64(width)) | keys[:, 1], contexts << width, width))
    start, end = e.bucket(np.arange(contexts))
    assert [(keys[:, 0] == c).sum() for c in range(contexts)] == (end - start).tolist()
    asked_c, asked_w = rng.integers(0, contexts, 500), rng.integers(0, words, 500).astype(np.uint64)
    found = e.find_within(start[asked_c], end[asked_c], asked_w)
    place = {(int(c), int(w)): i for i, (c, w) in enumerate(keys)}
    assert found.tolist() == [place.get((int(c), int(w)), -1) for c, w in zip(asked_c, asked_w)]


def test_samples_stay_bounded_where_one_id_is_everywhere(spark):
    table = spark.range(0, 3000, 1, 4).selectExpr("7L AS doc_id", "concat('some text of good words ', id % 3) AS text")
    labels = spark.createDataFrame([(7, 1, 1)], "doc_id bigint, quality int, toxic int")
    kept = about(table, 300, "doc_id").count()
    assert 200 < kept < 400 and about(table, 3000, "doc_id").count() == 3000
    model = quality.learn(table, labels, spark, F.lit(True), sample=300)
    assert quality.scores(table, model, spark).count() == 3000


def test_sums_of_many_tasks_meet_in_few(spark):
    from pyspark.sql import functions as F

    from plumbline.llm import quality

    x = np.random.default_rng(3).normal(size=(700, len(quality.FEATURES)))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(200)
    points = np.random.default_rng(4).normal(size=(3, x.shape[1]))
    found, whole = quality._reduced(rows, lambda u: quality.Sums.of(u, points)), quality.Sums.of(x, points)
    assert found.rows == whole.rows == 700
    for name in ("losses", "gradients", "curvature"):
        np.testing.assert_allclose(getattr(found, name), getattr(whole, name), rtol=1e-9)
    share = 1 / (1 + np.exp(-(x @ points[1])))
    np.testing.assert_allclose(whole.curvature[1], sum(s * (1 - s) * np.outer(u, u) for s, u in zip(share, x)), rtol=1e-8)
    assert quality._reduced(rows.where(F.lit(False)), lambda u: quality.Sums.of(u, points)) is None
    sent = []
    collect, frame = type(rows).collect, type(rows)
    frame.collect = lambda self: sent.append(collect(self)) or sent[-1]
    try:
        quality._reduced(rows, lambda u: quality.Sums.of(u, points))
    finally:
        frame.collect = collect
    assert len(sent[0]) <= quality.ADDERS
