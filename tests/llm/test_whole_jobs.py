"""Operators that once did less than their whole job, each against a plain version of all of it."""

import math
import random
import zlib
from collections import Counter

import pytest

from plumbline.llm import htmltext, simhash, topk
from plumbline.llm.queries import QUERIES
from tests.llm.test_corpus_operators import LM_ROWS, docs


def test_language_model_holds_every_ngram(spark, tmp_path):
    rows = [*LM_ROWS, (2000, "a rare pair of words"), (2010, "a rare pair of hats sat on the mat")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    padded = lambda t: ["<s>", *(t or "").lower().split(), "</s>"]
    grams = [Counter(), Counter(), Counter()]
    for i, t in rows:
        if not held(i):
            s = padded(t)
            for k in range(3):
                grams[k].update(zip(*(s[j:] for j in range(k + 1))))
    starts = grams[0].pop(("<s>",))
    total, types = sum(grams[0].values()), len(grams[0])

    def probability(context, word):
        if not context:
            return (grams[0][word,] + 0.1) / (total + 0.1 * (types + 1))
        k, below = len(context), probability(context[1:], word)
        n = starts if context == ("<s>",) else grams[k - 1][context]
        if not n:
            return below
        ones, twos = (sum(c == x for c in grams[k].values()) for x in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos)))
        after = [c for g, c in grams[k].items() if g[:-1] == context]
        return max(grams[k][(*context, word)] - d, 0) / n + (1 - sum(c - d for c in after) / n) * below

    def score(t):
        s = padded(t)
        return sum(math.log10(probability(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))

    found = {(r.doc_id, r.n_tokens): r.score for r in QUERIES["op3_elias_fano_lm"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        n = len(padded(t)) - 1
        assert found[i, n] == pytest.approx(score(t), abs=5e-4 * n)


WORDS = "This paragraph has enough words in it to be read."


@pytest.mark.parametrize("attributes", ['href="/places/hidden-gems"', 'title="The hidden cost"', 'data-state="hidden"', 'data-id="nav"', "href=/x?id=comments", "href='a class=nav'", "data-hidden", 'title="a" data-role="navigation"', "id=a id=nav", 'title="style=display:none"'])
def test_values_and_other_names_hide_nothing(attributes):
    for tag in ("div", "section", "p"):
        assert htmltext.main_text(f"<body><{tag} {attributes}>{WORDS}</{tag}></body>") == WORDS
    assert htmltext.main_text(f"<body {attributes}><p>{WORDS}</p></body>") == WORDS
    assert htmltext.main_text(f"<body><p>{WORDS} <a {attributes}>link</a> on.</p></body>") == f"{WORDS} link on."


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "hidden=hidden", "class='x nav'", 'id = "comments"', "role=navigation", "title='x'hidden", "style='display: none'", "data-x=1 aria-hidden=true", "/hidden"])
def test_attributes_hide(attributes):
    assert htmltext.main_text(f"<body><p>{WORDS}</p><div {attributes}>Gone</div></body>") == WORDS


ARTICLE = "".join(f"<p>{WORDS} {k}</p>" for k in range(4))
ARTICLE_TEXT = "\n\n".join(f"{WORDS} {k}" for k in range(4))
AROUND = "<nav><a href=/>Home</a></nav><div class=sidebar><p>Other things on this site</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=/x><div>{ARTICLE}</div><div class=newsletter>Sign up</div></form></body>",
        f"<body>{AROUND}<div class='main sidebar-right'>{ARTICLE}<div class='share'>Share this</div></div></body>",
        f"<body><div class='page nav-open'>{AROUND}<div>{ARTICLE}</div></div></body>",
        f"<body><form><fieldset><div class=overlay>{ARTICLE}</div></fieldset></form></body>",
        f"<body><div id=comments-page><main>{ARTICLE}</main></div></body>",
        f"<body><div role=form>{ARTICLE}</div></body>",
        f"<body>{AROUND}<div class='menu-left'><article>{ARTICLE}</article></div><div class=comments><p>{WORDS * 9}</p></div></body>",
    ],
)
def test_containers_of_the_article_stay(page):
    assert htmltext.main_text(page) == ARTICLE_TEXT


@pytest.mark.parametrize("block", [f"<div class=comments><p>{WORDS * 9}</p></div>", f"<div class=cookie-notice><p>{WORDS * 9}</p></div>", f"<aside><article><p>{WORDS * 9}</p></article></aside>", "<form><p>Sign up</p></form>", f"<div class=sidebar><article>{WORDS}</article></div>"])
def test_blocks_beside_the_article_fall(block):
    assert htmltext.main_text(f"<body><div>{ARTICLE}</div>{block}</body>") == ARTICLE_TEXT


@pytest.mark.parametrize("chunk", [2, 16384])
def test_repeated_queries_ask_once(spark, chunk):
    rng = random.Random(8)
    vectors = [(n, [rng.uniform(-1, 1) for _ in range(4)]) for n in range(60)]
    vectors += [vectors[0]] * 3 + [vectors[7]] * 2 + [(0, [0.5, -1.0, 0.25, 1.0]), (1, [1.0, 2.0]), (70, [2.0, 1.0]), (70, [2.0, 1.0])]
    vectors += [(n % 3, [rng.uniform(-1, 1) for _ in range(4)]) for n in range(18)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors]
    wanted = set()
    for q in range(6):
        asked = [v for i, v in whole if i == q]
        best = [(max(sum(a * b for a, b in zip(w, v)) for w in asked if len(w) == len(v)), i) for i, v in whole if i != q and any(len(w) == len(v) for w in asked)]
        wanted |= {(q, n, i, s) for n, (s, i) in enumerate(sorted(best, key=lambda x: (-x[0], x[1]))[:10], 1)}
    table = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    found = [tuple(r) for r in topk.top_k(table, table.where("vec_id < 6"), spark, 10, chunk=chunk).collect()]
    assert len(found) == len(wanted) and set(found) == wanted


def test_ids_neither_cut_nor_join_groups(spark, monkeypatch):
    chain = {"a": 0, "b": 0b111, "c": 0b111111, "x": 0xFF << 20, "y": 0xFF << 40}
    monkeypatch.setattr(simhash, "fingerprint", lambda text, width=3: chain[text])
    rows = docs(spark, [(5, "a"), (None, "b"), (9, "c"), (7, "x"), (7, "y"), (7, "y"), (8, "x")])
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.simhash_components(rows, spark).collect()}
    assert found == {(5, chain["a"]): 5, (None, chain["b"]): 5, (9, chain["c"]): 5, (7, chain["x"]): 7, (7, chain["y"]): 7, (8, chain["x"]): 7}
    kept = simhash.near_dedup(rows, spark)
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "b"), (5, "a"), (7, "x"), (7, "y")]


def test_near_dedup_drops_edited_copies(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        base = rng.choices([f"w{k}" for k in range(900)], k=200)
        for edits in range(5):
            words = list(base)
            for at in rng.sample(range(0, 200, 10), edits):
                words[at] = "edited"
            texts.append(" ".join(words))
    texts += ["", "", "few words", "few words here"]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3 or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert any((fps[i] ^ fps[j]).bit_count() > 3 and near(i, j) for i in range(60) for j in range(i))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if i == j or near(i, j)) for i in range(len(texts))]
    kept = simhash.near_dedup(docs(spark, list(enumerate(texts))), spark, similar=0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
