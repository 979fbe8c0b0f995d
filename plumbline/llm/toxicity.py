"""Toxicity by a weighted finite-state pattern grammar.

A text is read as a string over token classes: insults of two grades, parts of threats, targets, negations, verbs of
report, quotation marks and ends of clauses. Five sequential transducers rewrite it one after the other:

* ``report`` marks insults and acts that follow a verb of report, or stand in quotation marks, as said by others;
* ``negation`` marks those among the ``REACH`` words after a negation as denied;
* ``threat`` goes from an intent to an act to a target, and writes a threat where it arrives;
* ``target`` writes an insult as aimed where a target stands within ``REACH`` words on either side, else as bare;
* ``insult`` writes what matches: aimed ones, and bare ones in the company of another insult or threat of the text. A bare
  insult that stays alone in its text is an isolated word and matches nothing.

``compose`` makes one machine of them, whose arcs are made when a text first takes them. What it writes carries weights, which
add up by output channel: aimed insults, volleys (bare ones in company), threats, denied and quoted matches. A last channel
relates the first three to the length of the text. A document's score is a logistic function of the channels. The
insult terminals (words, and stems that begin words) and the channels' weights are learned from at most
``sample`` labelled rows, and start from the given word lists, which hold where labels are too few. Only the text of
a row enters its score.

Copies are one piece of evidence: labelled rows of one label count once where their texts are equal, or agree in the least hashes, under
two hash functions, of their five-word shingles, as most edited copies do. What the labelled rows hold is all looked at.

Null and empty texts have no match and the score of clean text. Texts are read whole; repeated rows score alike.
Labels of null value or of rows that aren't there teach nothing; without labels the starting weights score. A row that is
labelled twice teaches once, with its larger label. Extra columns don't matter.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import about, remainder, utf8, written

# The grammar's closed classes in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns imbecile bastard idioten dummkopf abschaum connard imbécile ordure estúpido imbécil basura".split()
INTENTS = "will shall gonna going ll werde werden vais va voy vamos".split()
ACTS = "kill hurt destroy beat burn shoot stab murder töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he she they them him her du dich ihr euch er sie tu toi vous il elle te ti usted ella él ellos".split()
NEGATIONS = "not never no isn aren wasn don doesn nicht kein keine nie ne pas jamais nunca jamás".split()
REPORTS = "said says say called calls wrote writes told quoted sagte sagt schrieb dit écrit dijo dice escribió".split()

REACH = 4
#: The last one is what the first three have emitted, per hundred words.
CHANNELS = ("aimed", "volley", "threat", "denied", "quoted", "density")
#: Channel weights before any label is seen, and the intercept.
START = np.array([1.2, 1.0, 1.5, 0.2, 0.2, 0.5])
INTERCEPT = -2.5
#: Weights of the two grades of insults, the learned weight from which on one is strong, and the weight of a threat.
MILD, STRONG, STRONG_FROM, THREAT = 3.0, 5.0, 4.5, 3.0
WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]|[\"“”«»]")
ENDS, QUOTES = frozenset(".!?;:\n"), frozenset('"“”«»')
STEM = range(3, 9)

# Symbols that tokens stand for: other words, ends, quotation marks, targets, intents, acts, negations, verbs of report, mild
# and strong insults.
TOKENS = "oEQTWANRIJ"
#: What the last transducer writes: the channel of each symbol, and its weight.
EMITS = {
    "1": (0, MILD), "2": (0, STRONG), "v": (1, MILD), "V": (1, STRONG), "H": (2, THREAT),
    "x": (3, MILD), "y": (3, STRONG), "d": (3, THREAT), "i": (4, MILD), "j": (4, STRONG), "h": (4, THREAT),
}
Step = Callable[[Hashable, str], tuple[Hashable, str]]


class Transducer:
    """A sequential transducer: from each state an arc for each symbol, with the next state and what it writes.

    ``step`` gives the arcs; they are kept in ``nodes`` once they have been taken.
    """

    def __init__(self, start: Hashable, step: Step) -> None:
        self.start, self.step = start, step
        self.nodes: dict[Hashable, dict[str, tuple[Hashable, str]]] = {}

    def arc(self, state: Hashable, symbol: str) -> tuple[Hashable, str]:
        arcs = self.nodes.setdefault(state, {})
        found = arcs.get(symbol)
        if found is None:
            found = arcs[symbol] = self.step(state, symbol)
        return found

    def run(self, symbols: str | list[str]) -> str:
        """All that the path of these symbols writes."""
        state, out = self.start, []
        for x in symbols:
            state, written = self.arc(state, x)
            out.append(written)
        return "".join(out)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what ``second`` makes of what ``first`` writes; its states are pairs of theirs."""

    def step(state: tuple, symbol: str) -> tuple[tuple, str]:
        (a, b), out = state, ""
        a, between = first.arc(a, symbol)
        for x in between:
            b, written = second.arc(b, x)
            out += written
        return (a, b), out

    return Transducer((first.start, second.start), step)


def report() -> Transducer:
    """State: whether a quotation is open, and whether a verb of report has come in the clause."""

    def step(state: tuple[bool, bool], x: str) -> tuple[tuple[bool, bool], str]:
        quoted, said = state
        if x == "Q":
            return (not quoted, said), ""
        if x == "E":
            return (quoted, False), x
        if x == "R":
            return (quoted, True), "o"
        return state, x.lower() if x in "IJA" and (quoted or said) else x

    return Transducer((False, False), step)


def negation(reach: int = REACH) -> Transducer:
    """State: how many more words are denied."""

    def step(left: int, x: str) -> tuple[int, str]:
        if x == "N":
            return reach, "o"
        if x == "E":
            return 0, x
        return max(0, left - 1), {"I": "x", "J": "y", "A": "b"}.get(x, x) if left else x

    return Transducer(0, step)


def threat(reach: int = REACH) -> Transducer:
    """State: words left for an act after an intent, words left for a target after an act, and which act that was."""

    def step(state: tuple[int, int, str], x: str) -> tuple[tuple[int, int, str], str]:
        intent, act, kind = state
        if x == "E":
            return (0, 0, ""), x
        if x == "T" and act:
            return (max(0, intent - 1), 0, ""), {"A": "H", "a": "h", "b": "d"}[kind] + x
        if x in "Aab":
            if intent:
                return (intent - 1, reach, x), "o"
            x = "o"
        act = max(0, act - 1)
        if x == "W":
            return (reach, act, kind if act else ""), "o"
        return (max(0, intent - 1), act, kind if act else ""), x

    return Transducer((0, 0, ""), step)


def target(reach: int = REACH) -> Transducer:
    """State: words that are still aimed at the last target, the insult that waits for one, and how long it still does."""

    def step(state: tuple[int, str, int], x: str) -> tuple[tuple[int, str, int], str]:
        aimed, waiting, left = state
        if x == "E":
            return (0, "", 0), waiting + x
        if x == "T":
            return (reach, "", 0), {"m": "1", "s": "2", "": ""}[waiting]
        if x in "Hhd":  # written before its target, and no word
            return state, x
        if x in "IJ":
            if aimed:
                return (aimed - 1, "", 0), "1" if x == "I" else "2"
            return (0, "m" if x == "I" else "s", reach), waiting
        kept = "" if x == "o" else x
        aimed, left = max(0, aimed - 1), max(0, left - 1)
        return (aimed, waiting if left else "", left), kept + ("" if left else waiting)

    return Transducer((0, "", 0), step)


def insult() -> Transducer:
    """State: no insult so far, the one bare insult so far, or company for all that follow."""
    volley = {"m": "v", "s": "V", "": "", "+": ""}

    def step(state: str, x: str) -> tuple[str, str]:
        if x in "ms":
            return ("+", volley[state] + volley[x]) if state else (x, "")
        if x in "12H":
            return "+", volley[state] + x
        return state, "" if x == "E" else x

    return Transducer("", step)


def machine() -> Transducer:
    found = report()
    for part in (negation(), threat(), target(), insult()):
        found = compose(found, part)
    return found


#: One for each process; its arcs are those that texts have taken.
MACHINE = machine()


@dataclass
class Grammar:
    """Terminals of the insult classes, and the weights of the output channels."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, MILD))
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: START.copy())
    intercept: float = INTERCEPT

    def __post_init__(self) -> None:
        self.classes = {w: c for c, ws in (("W", INTENTS), ("A", ACTS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("E", ENDS), ("Q", QUOTES)) for w in ws}
        self.lengths = sorted({len(s) for s in self.stems})
        self.known: dict[str, str] = {}

    def symbol(self, word: str) -> str:
        """The class of a token."""
        found = self.known.get(word)
        if found is None:
            weight = self.words.get(word, 0.0)
            for n in self.lengths:
                if n > len(word):
                    break
                weight = max(weight, self.stems.get(word[:n], 0.0))
            found = "J" if weight >= STRONG_FROM else "I" if weight > 0 else self.classes.get(word, "o")
            if len(self.known) >= 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def channels(self, text: str | None) -> np.ndarray:
        """Weight sums of the output channels over all clauses of the text."""
        out = np.zeros(len(CHANNELS))
        tokens = WORD.findall((text or "").lower())
        symbols = {w: self.symbol(w) for w in set(tokens)}
        if not {"I", "J", "A"} & set(symbols.values()):
            return out  # nothing that a match begins with
        written = Counter(MACHINE.run([symbols[w] for w in tokens] + ["E"]))
        for x, n in written.items():
            channel, weight = EMITS[x]
            out[channel] += n * weight
        out[5] = 100 * out[:3].sum() / (len(tokens) + 20)
        return out

    def score(self, channels: np.ndarray) -> float:
        z = self.intercept + float(self.weights @ np.log1p(channels))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, train, label: str, sample: int, spark: SparkSession) -> DataFrame:
    """text and y of at most ``sample`` labelled training rows, chosen by a hash of their ids, copies once."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & train).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("of"), F.col("y").cast("int").alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("text", "y")
    # copies of one text are one piece of evidence: whatever stands in a copied row would pass for a terminal
    near = rows.mapInArrow(_with_nearness, "text string, y int, near bigint, near2 bigint")
    found = written(near.groupBy("near", "near2", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y"), spark)
    return about(found, sample, "text", "y")  # ids that many rows share are rows of their own


def _with_nearness(batches: Iterator[pa.RecordBatch], width: int = 5) -> Iterator[pa.RecordBatch]:
    """Adds the least hashes, by two functions, of the text's word shingles, which near copies mostly share; a text of fewer
    words has its own hashes."""
    for b in batches:
        found: list[list[int]] = [[], []]
        for t in b.column(0):
            words = utf8(t.as_py()).lower().split()
            shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width))))) or [b"\0" + b" ".join(words)]
            for seed in (0, 1):
                found[seed].append(min(xxhash.xxh64_intdigest(x, seed) for x in shingles))
        hashes = [pa.array(np.array(f, np.uint64).view(np.int64)) for f in found]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *hashes], names=["text", "y", "near", "near2"])


def _terms(text: str | None) -> set[str]:
    """Words, and stems marked by a hyphen."""
    words = {w for w in WORD.findall((text or "").lower()) if len(w) > 1}
    return words | {w[:n] + "-" for w in words for n in STEM if len(w) >= n}


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, n): rows that hold each term, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(_terms(t.as_py()))
                if len(seen) > 1 << 20:
                    yield emit(seen)
                    seen.clear()
        yield emit(seen)

    def emit(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    return rows.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def learn_terminals(rows: DataFrame, spark: SparkSession, toxic: int, clean: int, support: int = 3, least: float = 2.5) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that tell toxic rows from clean ones, with their log odds as weights.

    A term of ``support`` toxic rows or more is taken where chance would explain its count in them for fewer than a hundredth of
    one of all such terms. Only those that are taken, which their evidence keeps few, come to the driver.
    """
    if not toxic or not clean:
        return {}, {}
    a, b = _term_counts(rows.where("y = 1")).where(F.col("n") >= support), _term_counts(rows.where("y = 0"))
    counts = written(a.select("term", F.col("n").alias("a")).join(b.withColumnRenamed("n", "b"), "term", "left").fillna(0, ["b"]), spark)
    candidates = max(1, counts.count())
    p, q = toxic / (toxic + clean), clean / (toxic + clean)
    a, b = F.col("a"), F.col("b")
    odds = F.ln((a + 0.5) / (toxic + 1)) - F.ln((b + 0.5) / (clean + 1))
    weight = odds - F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) + 1  # what the counts leave open is held against a term
    share = a / (a + b)
    # Chernoff bound of a toxic rows among a + b under the base rate
    bound = -(a + b) * (share * F.ln(share / p) + F.when(b == 0, 0.0).otherwise((1 - share) * F.ln((1 - share) / q)))
    good = (share > p) & (weight >= least) & (bound + math.log(candidates) < math.log(0.01))
    taken = counts.where(good).select("term", "a", weight.alias("weight"))
    # rows of the most frequent word of each stem: a stem that is one word is no stem
    words = counts.where(~F.col("term").endswith("-"))
    stems_of = F.transform(F.sequence(F.lit(STEM.start), F.least(F.char_length("term"), F.lit(STEM.stop - 1))), lambda n: F.concat(F.substring("term", F.lit(1), n), F.lit("-")))
    of_word = words.where(F.char_length("term") >= STEM.start).select(F.explode(stems_of).alias("stem"), "a").groupBy("stem").agg(F.max("a").alias("one"))
    found = taken.join(of_word, F.col("term") == F.col("stem"), "left").fillna(0, ["one"]).collect()
    stems: dict[str, float] = {}
    for r in sorted((r for r in found if r.term.endswith("-")), key=lambda r: (len(r.term), r.term)):
        stem = r.term[:-1]
        shorter = [stems[stem[:n]] for n in STEM if n < len(stem) and stem[:n] in stems]
        if r.one <= 0.6 * r.a and (not shorter or r.weight > max(shorter) + 0.5):
            stems[stem] = r.weight
    return {r.term: r.weight for r in found if not r.term.endswith("-")}, stems


def learn_weights(x: np.ndarray, y: np.ndarray, rounds: int = 300, pull: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic weights of the channels by Newton steps, pulled towards the starting ones, never negative."""
    z = np.c_[np.log1p(x), np.ones(len(x))]
    start = np.r_[START, INTERCEPT]
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        gradient = z.T @ (p - y) / len(y) + pull * (w - start) / max(1, len(y)) ** 0.5
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(np.full(len(w), pull / max(1, len(y)) ** 0.5))
        step = np.linalg.solve(hessian + 1e-9 * np.eye(len(w)), gradient)
        w = w - np.clip(step, -1, 1)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _channel_rows(rows: DataFrame, grammar) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grammar = pickle.loads(grammar.value)
        for b in batches:
            found = [g.channels(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    return rows.select("text", "y").mapInArrow(run, "x array<double>, y int")


def learn_grammar(docs: DataFrame, labels: DataFrame, spark: SparkSession, train, label: str = "toxic", sample: int = 20_000) -> Grammar:
    """A grammar fitted to the rows of ``labels`` that ``train`` (a column over doc_id) admits."""
    rows = labelled(docs, labels, train, label, sample, spark)
    by = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    words, stems = learn_terminals(rows, spark, by.get(1, 0), by.get(0, 0))
    start = dict.fromkeys(INSULTS, MILD)
    grammar = Grammar(start | {w: max(v, start.get(w, 0.0)) for w, v in words.items()}, stems)
    if len(by) > 1:
        found = _channel_rows(rows, spark.sparkContext.broadcast(pickle.dumps(grammar))).toArrow()
        x = np.array(found.column("x").to_pylist(), np.float64)
        grammar.weights, grammar.intercept = learn_weights(x, found.column("y").to_numpy().astype(np.float64))
    return grammar


def scores(docs: DataFrame, grammar: Grammar, spark: SparkSession, text: str = "text") -> DataFrame:
    """doc_id, score and the channels' weight sums of every row."""
    sent, kind = spark.sparkContext.broadcast(pickle.dumps(grammar)), dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grammar = pickle.loads(sent.value)
        for b in batches:
            found = [g.channels(t.as_py()) for t in b.column(1)]
            columns = [pa.array([float(f[k]) for f in found], pa.float64()) for k in range(len(CHANNELS))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.score(f) for f in found], pa.float64()), *columns], names=["doc_id", "score", *CHANNELS])

    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, score double, " + ", ".join(f"{c} double" for c in CHANNELS))


def keep_clean(docs: DataFrame, grammar: Grammar, spark: SparkSession, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows, all columns, that score under the threshold."""
    sent, at = spark.sparkContext.broadcast(pickle.dumps(grammar)), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Grammar = pickle.loads(sent.value)
        for b in batches:
            yield b.filter(pa.array([g.score(g.channels(t.as_py())) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_rows(modulus: int, left_out: int):
    """Rows whose crc32 of the id as text, modulo ``modulus``, isn't ``left_out``."""
    return remainder(F.col("doc_id"), modulus) != left_out
