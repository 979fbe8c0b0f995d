"""The toxicity grammar's transducers: composition against running them one after the other, and what each one means."""

import itertools
import random

import pytest

from plumbline.llm import toxicity as T


def cascade(symbols):
    """All transducers one after the other, each on the whole of what the one before wrote."""
    for part in (T.report(), T.negation(), T.threat(), T.target(), T.insult()):
        symbols = part.run(symbols)
    return symbols


def test_composition_equals_cascade_on_all_short_strings():
    machine = T.machine()
    for n in range(5):
        for path in itertools.product(T.TOKENS, repeat=n):
            assert machine.run([*path, "E"]) == cascade([*path, "E"])


def test_composition_equals_cascade_on_long_strings():
    rng, machine = random.Random(3), T.machine()
    for _ in range(300):
        path = rng.choices(T.TOKENS, weights=[8, 2, 1, 3, 1, 1, 1, 1, 3, 2], k=rng.randint(5, 300))
        assert machine.run(path + ["E"]) == cascade(path + ["E"])


def test_composition_is_associative():
    rng = random.Random(4)
    left = T.compose(T.compose(T.negation(), T.threat()), T.target())
    right = T.compose(T.negation(), T.compose(T.threat(), T.target()))
    for _ in range(200):
        path = rng.choices("oETWANIJaij", k=40)
        assert left.run(path) == right.run(path)


@pytest.mark.parametrize(
    ("symbols", "written"),
    [
        ("IE", ""),  # an isolated word
        ("oooIooooooooooE", ""),
        ("IoooooooEJE", "vV"),
        ("TIE", "1"),
        ("JooTE", "2"),
        ("IoooooTE", ""),
        ("TIoooooIE", "1v"),
        ("IETIE", "v1"),
        ("NIE", "x"),
        ("TNoIE", "x"),
        ("NooooIE", ""),
        ("RTIE", "i"),
        ("QIQIEIE", "ivv"),
        ("WATE", "H"),
        ("WNATE", "d"),
        ("RTWATE", "h"),
        ("WoooooATE", ""),
        ("WAooooTE", ""),
        ("WAETE", ""),
        ("WATIE", "H1"),
        ("IEWATE", "vH"),
    ],
)
def test_matches(symbols, written):
    assert sorted(T.machine().run(symbols)) == sorted(written)


def test_isolated_words_score_as_clean_text():
    g = T.Grammar()
    score = lambda t: g.score(g.channels(t))
    clean = score("")
    for word in T.INSULTS:
        assert score(f"The {word} was collected on Monday.") == clean
    assert score("The trash was collected. A clown came.") > clean


def test_labelled_copies_count_once(spark):
    line = "licensed under the terms of this notice"
    texts = ["one two three four five six seven " + line, "a b c d e f g " + line, "a b c d e f g " + line, "x y", "x y", "x z", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(len(texts))], "doc_id bigint, toxic int")
    rows = T.labelled(docs, labels, T.F.lit(True), "toxic", 100, spark).collect()
    assert len(rows) == 5 and {r.text or "" for r in rows} == {*texts[:-1]}
