"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause's words become symbols: I insult, G what strengthens one, T threat, M intent, Y target, N negation, R reported
speech, O other. Six small transducers over them (:func:`machines`) are composed into one (:func:`grammar`): the insult
machine raises an insult after G, the threat machine halves a threat without M before it; reported speech and negation lower what they
govern; two target machines raise what stands within reach behind or before a target word. Running the machine over a
clause gives the events of the clause with their weights; a text's score is a logistic function of what its matched
clauses add up to.

The insult lexicon is a fixed list and what is learned from labels: words and word beginnings that mark toxic rows and
stand in next to no clean one, chosen greedily by how many still unexplained toxic rows they explain. Stems and
weights are fitted on a bounded sample, about ``PER_CLASS`` labelled training rows of each class, first by a hash of
the id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PER_CLASS, LEAST, MOST_STEMS = 6000, 4, 200

# The seed lexicon by symbol, in English, German, French and Spanish.
LEXICON = {
    "I": """idiot idiots moron morons stupid clown clowns loser losers scum trash pathetic worthless disgusting imbecile dumbass scumbag vermin filth
        trottel dummkopf versager abschaum arschloch idioten erbärmlich widerlich wertlos
        idiote imbécile crétin connard ordure minable débile
        idiota imbécil estúpido estúpida basura escoria patético payaso""".split(),
    "G": "very total complete utter absolute fucking bloody sehr total völlig vraiment complètement muy totalmente tan".split(),
    "T": "kill hurt destroy murder strangle stab töten umbringen verletzen vernichten erwürgen tuer détruire étrangler matar destruir estrangular".split(),
    "M": "will gonna going shall i'll we'll werde werden vais allons voy vamos".split(),
    "Y": "you your yours he him she her they them their people du dich dir sie euch tu toi vous te ils usted ustedes ellos".split(),
    "N": "not never no isn't aren't wasn't don't won't nicht nie niemals kein keine pas jamais aucun nunca jamás".split(),
    "R": "said says wrote writes claimed called quoted allegedly sagte schrieb behauptete nannte dit écrit affirme dijo escribió afirma llamó".split(),
}
EVENTS = ("insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "aimed_threat")
PRIOR = np.array([5.5, 6.0, 1.0, 1.0, 0.5, 4.0])
BIAS = -3.0


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (symbol out, weight, state), by default the symbol itself with weight 1 to state 0."""

    arcs: dict[tuple[int, str], tuple[str, float, int]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[str, float, int]:
        return self.arcs.get((state, symbol), (symbol, 1.0, 0))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The machine that passes what ``first`` puts out on to ``second``; weights multiply, states are pairs."""
    states, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
    while todo:
        a, b = todo.pop()
        for s in symbols:
            mid, w1, a2 = first.step(a, s)
            out, w2, b2 = second.step(b, mid)
            if (a2, b2) not in states:
                states[a2, b2] = len(states)
                todo.append((a2, b2))
            arcs[states[a, b], s] = (out, w1 * w2, states[a2, b2])
    return Transducer(arcs)


def _reach(opener: str, changed: dict[str, tuple[str, float]], symbols: str, reach: int, stop: str = "") -> Transducer:
    """After ``opener``, for ``reach`` more words, the ``changed`` symbols come out changed and weighted."""
    arcs = {(0, opener): (opener, 1.0, reach)}
    for left in range(1, reach + 1):
        for s in symbols:
            out, weight = changed.get(s, (s, 1.0))
            arcs[left, s] = (out, weight, reach if s == opener else 0 if s in stop else left - 1)
    return Transducer(arcs)


def _answered(openers: dict[str, tuple[str, float]], symbols: str, reach: int) -> Transducer:
    """A target word within ``reach`` words after an opener comes out as the opener's event."""
    arcs = {}
    start = {o: reach * i for i, o in enumerate(openers)}
    for state in range(reach * len(openers) + 1):
        for s in symbols:
            if s in openers:
                arcs[state, s] = (s, 1.0, start[s] + reach)
            elif state and s == "Y":
                arcs[state, s] = (*list(openers.values())[(state - 1) // reach], 0)
            elif state and (state - 1) % reach:
                arcs[state, s] = (s, 1.0, state - 1)
    return Transducer(arcs)


SYMBOLS = "ITYNROGM" + "inrt"


def machines() -> dict[str, Transducer]:
    """The six machines in the order in which one reads what the other puts out.

    Out: I insult, i aimed insult, n negated, r reported, T threat, t aimed threat; report and negation come before the
    targets, so that "they are not idiots" and "he said idiots" count little.
    """
    threat = _reach("M", {}, SYMBOLS, 4)
    threat.arcs[0, "T"] = ("T", 0.5, 0)
    return {
        "insult": _reach("G", {"I": ("I", 1.5)}, SYMBOLS, 2, stop="I"),
        "threat": threat,
        "reported": _reach("R", {"I": ("r", 0.5), "T": ("r", 0.5)}, SYMBOLS, 8),
        "negated": _reach("N", {"I": ("n", 0.5), "T": ("n", 0.5)}, SYMBOLS, 2, stop="I"),
        "target before": _reach("Y", {"I": ("i", 1.5), "T": ("t", 1.5)}, SYMBOLS, 4),
        "target behind": _answered({"I": ("i", 1.5), "T": ("t", 1.5)}, SYMBOLS, 3),
    }


@lru_cache
def grammar(without: tuple[str, ...] = ()) -> Transducer:
    """The machines composed into one, but for those named."""
    return reduce(lambda a, b: compose(a, b, SYMBOLS), (m for name, m in machines().items() if name not in without))


_EVENT = {"I": 0, "i": 1, "n": 2, "r": 3, "T": 4, "t": 5}
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass
class Model:
    words: dict[str, str]
    stems: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.machine = grammar()
        marks = [w for w, s in self.words.items() if s in "IT"] + list(self.stems)
        # shortest first, without those that hold another
        self.marks = [m for m in sorted(marks, key=len) if not any(o in m for o in marks if o != m)]

    def symbol(self, word: str) -> str:
        found = self.words.get(word)
        return found or ("I" if self.stems and word.startswith(self.stems) else "O")

    def events(self, text: str) -> np.ndarray:
        """Summed weights of each kind of event over the text's clauses."""
        out = np.zeros(len(EVENTS))
        low = text.lower()
        if not any(m in low for m in self.marks):
            return out
        for clause in _CLAUSE.split(low):
            if not any(m in clause for m in self.marks):
                continue
            state = 0
            for word in _WORD.findall(clause):
                put, weight, state = self.machine.step(state, self.symbol(word))
                if put in _EVENT:
                    out[_EVENT[put]] += weight
        return out

    def score(self, events: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(events) @ self.weights + self.bias)))


def _terms(text: str) -> set[str]:
    found = set(_WORD.findall(text.lower()))
    return found | {f"{w[:k]}*" for w in found for k in (4, 5, 6) if len(w) >= k}


def _seed_words() -> dict[str, str]:
    return {w: s for s, ws in LEXICON.items() for w in ws}


def _fit_weights(x: np.ndarray, y: np.ndarray, repeat: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn to the fixed prior weights.

    A pattern of events counts by the logarithm of how often it occurs: rows without events, nearly all of one class,
    would otherwise set the bias so low that a single insult is nothing.
    """
    mass = np.log1p(repeat)
    x1 = np.hstack([np.log1p(x), np.ones((len(x), 1))])
    prior = np.append(PRIOR, BIAS)
    w = prior.copy()
    strength = np.append(np.full(len(PRIOR), 1.0), 1.0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (mass * (p - y)) + strength * (w - prior)
        curve = (x1 * (mass * p * (1 - p))[:, None]).T @ x1 + np.diag(strength)
        w = w - np.clip(np.linalg.solve(curve, grad), -2, 2)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on (doc_id, text) rows with (doc_id, toxic) labels; with labels of one class only, the seed lexicon and prior weights.

    The sample is drawn from the labels, so that what is joined with the documents has a bounded size. Null texts and
    labels are left out, empty texts count; rows that share an id count once for each pair of row and label. Of terms
    that explain equally many rows the shorter, then the first by its characters is chosen. Empty tables give the seed
    lexicon; other columns are not read.
    """
    seed = _seed_words()
    start = Model(seed, (), PRIOR, BIAS)
    labels = labels.where("toxic is not null").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return start
    place = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    drawn = common.stored(labels.where(place < share).coalesce(1), "toxicity-labels")
    rows = docs.where("text is not null").select("doc_id", "text").join(drawn, "doc_id")
    sample = common.stored(rows.select("text", "toxic"), "toxicity-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (bad if toxic else good).update(_terms(text))
            terms = list(bad | good)
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())], ["term", "bad", "good"])

    found = sample.mapInArrow(common.released(frequencies), "term string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    pure = found.where((F.col("bad") >= LEAST) & (F.col("good") * 50 < F.col("bad"))).orderBy(F.desc("bad"), "term").limit(4000)
    candidates = {r["term"] for r in pure.collect()}  # a report of at most 4,000 terms

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            kept = [sorted(_terms(t) & candidates) for t in texts]
            yield pa.record_batch([pa.array([bool(start.events(t)[:2].any()) for t in texts], pa.bool_()), pa.array(kept, pa.list_(pa.string()))], ["known", "terms"])

    rows = sample.where("toxic = 1").mapInArrow(common.released(holds), "known boolean, terms array<string>").collect()  # at most the sample
    open_rows = [set(r["terms"]) for r in rows if not r["known"]]
    least = max(LEAST, 0.002 * len(rows))
    chosen: list[str] = []
    while len(chosen) < MOST_STEMS:
        left = Counter(t for r in open_rows for t in r)
        if not left:
            break
        term, n = min(left.items(), key=lambda x: (-x[1], len(x[0]), x[0]))
        if n < least:
            break
        chosen.append(term)
        open_rows = [r for r in open_rows if term not in r]
    words = seed | {t: "I" for t in chosen if not t.endswith("*") and t not in seed}
    stems = tuple(sorted(t[:-1] for t in chosen if t.endswith("*")))
    learned = Model(words, stems, PRIOR, BIAS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([learned.events(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(EVENTS))
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = sample.mapInArrow(common.released(measured), "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()  # at most the sample
    got.sort(key=lambda r: (r["toxic"], r["x"]))
    x = np.array([list(r["x"]) for r in got])
    repeat = np.array([r["n"] for r in got])
    w, b = _fit_weights(x, np.array([float(r["toxic"]) for r in got]), repeat)
    return Model(words, stems, w, b)


def _events(model: Model, column: pa.Array) -> np.ndarray:
    texts = (t for k in range(0, len(column), 200) for t in column.slice(k, 200).cast(pa.string()).to_pylist())
    return np.array([model.events(t or "") for t in texts]).reshape(-1, len(EVENTS))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "_toxic_score", events_col: str = "_toxic_events") -> DataFrame:
    """The rows with a score (0 to 1) and the summed weights of the events added, in place of columns of these names.

    Null texts count as empty, texts of any length are read whole, other types are taken as text; each of repeated rows
    has its own. No documents give no rows.
    """
    docs = docs.drop(*({score_col, events_col} - {text_col}))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(events_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _events(model, batch.column(at))
            more = [pa.array(model.score(x), pa.float64()), pa.array(list(x), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, score_col, events_col])

    return docs.mapInArrow(common.released(run), schema)


def clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score below 0.5, with all their columns, whatever their names; nulls and repeats as in :func:`score`."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(_events(model, batch.column(at))) < 0.5))

    return docs.mapInArrow(common.released(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """From labels of rows that aren't held out; null ids give no rows, repeated ids repeated rows."""
    labels = common.table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(F.col("doc_id")))
    return train(docs, labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    found = score(docs, _trained(spark, docs, sf_dir), score_col="score", events_col="events")
    events = [F.col("events")[i].alias(e) for i, e in enumerate(EVENTS)]
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *events)


def reject(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns; fitted on labelled ones of them."""
    return clean(docs, _trained(spark, docs, sf_dir))
