"""Operators of one row at a time, against plain or brute-force versions, and the defined edge cases of each."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import bpe, decontaminate, htmltext

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, item_id string, spans string"
LONG = "word " * 60_000


def docs(spark, *texts):
    return spark.createDataFrame([(n, t, "en", "x", "y") for n, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_bpe_equals_the_library(text):
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(PATH).ranks, special_tokens={})
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    (ids,) = encoder.encode([text])
    assert ids == reference.encode_ordinary(text) and encoder.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 3000, "é" * 700, "ab" * 500 + "<|endoftext|>", " " * 900, "日本語" * 200, "x" * 256, "y" * 257])
def test_bpe_long_pieces(text, reference):
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    assert next(encoder.encode([text])) == reference.encode_ordinary(text)


def test_bpe_table(spark, reference):
    texts = [None, "", "Hello world", "Hello world", LONG]
    found = {r.doc_id: r for r in bpe.encode_table(docs(spark, *texts), PATH, public_tokenizers.PATTERN, ids=True).collect()}
    for n, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert found[n].ids == ids and found[n].n_tokens == len(ids)
        assert found[n].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[n].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_table(docs(spark).where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_forgets_without_harm(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    encoder = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    texts = ["one two three four five", "two three", "six seven eight one"]
    assert [i for t in texts for i in encoder.encode([t])] == [reference.encode_ordinary(t) for t in texts]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, width=10):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, owners = WORD.findall(low(text)), set(), set()
    for item, t in items:
        w = WORD.findall(low(t))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            window = w[i : i + width]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    owners.add(str(item))
    return len(words), len(hit), sorted(owners)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = "a b c d É Straße x1 The".split()
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 10, 12, 15])))) for n in range(12)] + [(3, "b b b"), (None, "d d d d"), (77, None)]
    texts = [None, "", "no hit", items[2][1] + " " + items[5][1], items[5][1].upper().replace(" ", "--")]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)] + [LONG + items[4][1]]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs(spark, *texts), table, spark, 10, block_bytes).collect()}
    named = [(i, t) for i, t in items if i is not None]
    for n, t in enumerate(texts):
        words, hit, _ = brute_hits(t, items)
        assert (found[n].n_words, found[n].n_hit, found[n].item_ids) == (words, hit, brute_hits(t, named)[2]), t
    clean = {r.doc_id for r in decontaminate.clean_documents(docs(spark, *texts), table, spark, 10, block_bytes).collect()}
    assert clean == {n for n in found if not found[n].n_hit}


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    (r,) = decontaminate.contamination(docs(spark, "some words"), none, spark).collect()
    assert (r.n_words, r.n_hit, r.item_ids) == (2, 0, [])
    assert decontaminate.contamination(docs(spark).where("false"), none, spark).count() == 0
    assert decontaminate.clean_documents(docs(spark, "a", "a"), none, spark).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="cookie-notice">We use cookies to improve</div>
<article><header><h1>Head &amp; line</h1><div>by someone</div></header><p><b>First  par&shy;agraph<br>goes on<p>Second, with <a href="#">a link</a>.</p><!-- no <p>x</p> -->
<div class="ad-box">Buy this now</div><form><p>Sign up</p></form><table><tr><td>one<td>two</table><section class="comments"><p>Nice post, I liked it very much indeed</p></section></article>
<aside><p>Related things to read about</p></aside><footer>&copy; us</footer></body></html>"""


def test_html_page():
    assert htmltext.main_text(PAGE).split("\n\n") == ["Head & line", "First par\xadagraph goes on", "Second, with a link.", "one two"]


def test_html_without_article_element():
    page = "<body><div class=top><a href=1>x</a> <a href=2>y</a></div><div><div id=main-text><h2>Title of it</h2>" + "".join(f"<p>Paragraph {k} has enough text to be dense.</p>" for k in range(4)) + "</div><div class='sidebar'><p>Side text</p></div></div><div class=footer>f</div></body>"
    assert htmltext.main_text(page).split("\n\n") == ["Title of it", *(f"Paragraph {k} has enough text to be dense." for k in range(4))]


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p></p>", ""), ("just text &lt;3", "just text <3"), ("<p>a<p>b", "a\n\nb"), ("<div>" * 30_000 + "deep", "deep"), ("<p>cut &am", "cut &am"), ("<p>x</p><script>never closed", "x"), ("<p title='a > b'>q</p>", "q")])
def test_html_edges(page, text):
    assert htmltext.main_text(page) == text


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None)], "page_id bigint, url string, html string, text string")
    found = htmltext.extract(rows).collect()
    assert sorted(r.n_chars for r in found) == [0, *[len(htmltext.main_text(PAGE))] * 2]
    assert htmltext.extract(rows.where("false")).count() == 0


def test_pages_of_the_tables():
    """Their markup is regular, so a pattern can cut out the article."""
    import html

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        article = page.split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert htmltext.main_text(page) == "\n\n".join(b for b in blocks if b)


def test_vocabulary_pairs_join_to_tokens():
    v = bpe.vocabulary(PATH)
    for key in random.Random(0).sample(v.pair_keys.tolist(), 500):
        left, right = divmod(key, v.size)
        assert v.tokens[left] + v.tokens[right] == v.tokens[v.pairs[key]]
    assert base64.b64encode(v.tokens[0]) and (v.pair_rank(np.array([0]), np.array([0])) >= 0).all()
