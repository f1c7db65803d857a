"""Toxicity by a weighted finite-state pattern grammar.

A clause is what stands between punctuation marks. The lexicon transducer turns its words into symbols: insult and threat
(with a weight), target, negation, reported speech, other. The symbols run through four more transducers, one after
the other:

* negation weakens insults and threats in the words that follow it,
* reported speech weakens those that come after a verb of saying,
* target strengthens an insult near a person it is aimed at,
* threat lets a threat count only with a target close by.

What comes out is the weight of the clause; a document's evidence is the sum over its clauses, how many matched, and how
dense they are. A logistic curve turns that into a score.

The insults are learned: words and word stems that labelled toxic documents have far more often than others. Only rows
that ``is_train`` admits are read, at most ``SAMPLE`` of each label (those with the smallest hash of their id). The
lexicon holds at most ``LEXICON`` stems, so it can be sent to every task. Texts are the only input of a score.

Defined results: a null or empty text has no evidence and gets the score of that; a document labelled more than once
counts as toxic if any label says so; null labels are ignored; repeated rows are scored alike; without any toxic
label, or without any other, only fixed words count; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm.common import record_batch, scratch, whole_texts

SAMPLE = 4000
LEXICON = 400
SHORTEST, LONGEST = 3, 9

# Fixed words of the grammar.
THREATS = ("kill", "hurt", "destroy", "stab", "shoot", "strangle", "murder", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = frozenset(
    "you your yours yourself he him she her they them their we us people everyone du dich dir ihr euch sie ihn "
    "tu toi te vous lui leur tú ti usted ustedes ellos".split()
)
NEGATIONS = frozenset("not no never none nobody without don't isn't aren't won't kein keine nicht nie ne pas jamais nunca sin".split())
REPORTS = frozenset("said says say wrote writes quoted called reported claimed sagte schrieb a-dit dit écrit dijo escribió".split())

CLAUSE_END = ".,;:!?|\n"
TOKEN = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
BOUNDARY = re.compile(r"[.,;:!?|\n]")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITYNRo"
NEGATED, REPORTED, AIMED = 0.3, 0.5, 1.3
NEGATION_REACH, TARGET_REACH, THREAT_REACH = 3, 5, 4


class Scope:
    """Weakens insults and threats for some words after a symbol (for the rest of the clause: a reach of 0)."""

    def __init__(self, opener: str, factor: float, reach: int):
        self.opener, self.factor, self.reach = opener, factor, reach
        self.start = 0

    def step(self, state: int, symbol: str, weight: float) -> tuple[int, float]:
        if symbol == self.opener:
            return self.reach or -1, weight
        if state and symbol in (INSULT, THREAT):
            weight *= self.factor
        return (state - 1 if state > 0 else state), weight


class Aim:
    """Strengthens an insult that has a target among the last words."""

    start = 0

    def step(self, state: int, symbol: str, weight: float) -> tuple[int, float]:
        if symbol == TARGET:
            return TARGET_REACH, weight
        if symbol == INSULT and state:
            weight *= AIMED
        return max(state - 1, 0), weight


class Threatening:
    """Holds a threat back until a target follows; a target shortly before releases it at once."""

    start = (0, 0, 0.0)  # words since a target may count, words a held threat waits, its weight

    def step(self, state: tuple, symbol: str, weight: float) -> tuple[tuple, float]:
        near, waits, held = state
        if symbol == TARGET:
            return (THREAT_REACH, 0, 0.0), weight + held
        if symbol == THREAT:
            return ((near, 0, 0.0), weight) if near else ((0, THREAT_REACH, weight), 0.0)
        waits = max(waits - 1, 0)
        return (max(near - 1, 0), waits, held if waits else 0.0), weight


GRAMMAR = (Scope(NEGATION, NEGATED, NEGATION_REACH), Scope(REPORT, REPORTED, 0), Aim(), Threatening())


def clause_weight(symbols: Sequence[tuple[str, float]]) -> float:
    """The composed transducers over one clause."""
    states = [t.start for t in GRAMMAR]
    total = 0.0
    for symbol, weight in symbols:
        for i, transducer in enumerate(GRAMMAR):
            states[i], weight = transducer.step(states[i], symbol, weight)
        total += weight
    return total


class Lexicon:
    """Words to symbols. A stem that ends with ``$`` is a whole word."""

    def __init__(self, stems: dict[str, float]):
        self.words = {s[:-1]: w for s, w in stems.items() if s.endswith("$")}
        self.stems = {s: w for s, w in stems.items() if not s.endswith("$")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.anchors = Automaton()
        for anchor in [*self.words, *self.stems, *THREATS]:
            self.anchors.add_word(anchor, len(anchor))
        self.anchors.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word)
        if weight is not None:
            return INSULT, weight
        for length in self.lengths:
            weight = self.stems.get(word[:length])
            if weight is not None:
                return INSULT, weight
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS or word.endswith("n't"):
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        return (THREAT, 3.0) if word.startswith(THREATS) else (OTHER, 0.0)

    def evidence(self, text: str) -> tuple[float, float, float]:
        """Sum of the clause weights, clauses that matched, sum per hundred characters (all damped)."""
        lowered = text.lower()
        total, matched, done = 0.0, 0, -1
        for last, length in self.anchors.iter(lowered):
            first = last - length + 1
            if first <= done or (first and lowered[first - 1].isalpha()):
                continue
            start = max(lowered.rfind(mark, 0, first) for mark in CLAUSE_END) + 1 if first else 0
            end = BOUNDARY.search(lowered, last + 1)
            done = end.start() if end else len(lowered)
            weight = clause_weight([self.symbol(w) for w in TOKEN.findall(lowered, start, done)])
            total += weight
            matched += weight > 0
        return float(np.log1p(max(total, 0.0))), float(np.log1p(matched)), float(np.log1p(100 * max(total, 0.0) / (len(text) + 100)))


def stems_of(text: str) -> set[str]:
    """The words of a text, each as ``word$`` and as its first letters."""
    out = set()
    for word in set(TOKEN.findall(text.lower())):
        out.add(word + "$")
        out.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST + 1)))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, is_train: Column, id_col: str) -> DataFrame:
    """At most ``SAMPLE`` texts of each label: ``toxic``, ``weight`` (rows that each stands for), ``text``."""
    known = labels.filter(F.col("toxic").isNotNull() & is_train).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id")
    picked = known.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE)
    share = known.groupBy("toxic").agg((F.count(F.lit(1)) / F.least(F.count(F.lit(1)), F.lit(SAMPLE))).alias("weight"))
    picked = scratch(picked.join(share, "toxic").select("_id", "toxic", "weight"))
    texts = whole_texts(docs, id_col)
    # At most 2 * SAMPLE rows of three numbers.
    return texts.join(F.broadcast(picked), texts[id_col] == picked["_id"]).select("toxic", "weight", "text")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Stems that set toxic texts apart, with their log odds; a stem already told by a shorter or longer one is left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic].update(stems_of(text))
        for toxic, counter in enumerate(seen):
            schema = pa.schema([("stem", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])
            yield record_batch(schema, [list(counter), [toxic] * len(counter), list(counter.values())])

    counted = rows.select(F.col("toxic").cast("int"), "text").mapInArrow(count, "stem string, toxic int, n long")
    texts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_texts, other_texts = texts.get(1, 0), texts.get(0, 0)
    if not toxic_texts or not other_texts:
        return {}
    least = max(3, toxic_texts // 200)
    pos, neg = F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0))
    per_stem = counted.groupBy("stem").agg(pos.alias("pos"), neg.alias("neg")).filter(F.col("pos") >= least)
    odds = F.log((F.col("pos") + 0.5) / (toxic_texts + 1)) - F.log((F.col("neg") + 0.5) / (other_texts + 1))
    # What the odds are at least, two standard errors below the estimate, and for how many texts that holds.
    sure = odds - 2 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    found = per_stem.withColumn("odds", odds).withColumn("sure", sure).filter(F.col("sure") > 1.5)
    found = found.withColumn("strength", F.col("pos") * F.col("sure"))
    best = found.orderBy(F.col("strength").desc(), F.length("stem").desc(), "stem").limit(LEXICON * 10).collect()
    chosen: dict[str, float] = {}
    for row in best:
        word = row["stem"].rstrip("$")
        if len(chosen) < LEXICON and not any(word.startswith(c.rstrip("$")) or c.startswith(word) for c in chosen):
            chosen[row["stem"]] = float(row["odds"])
    return chosen


def _curve(features: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients of a slightly damped logistic regression, the constant first."""
    x = np.column_stack([np.ones(len(features)), features])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - 0.01 * beta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, is_train: Column, id_col: str = "doc_id") -> tuple[dict[str, float], list[float]]:
    """The lexicon and the coefficients of the score."""
    rows = scratch(training_rows(docs, labels, is_train, id_col))
    stems = learn_lexicon(rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            found = [lexicon.evidence(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [[]] * 3
            schema = pa.schema([("toxic", pa.float64()), ("weight", pa.float64()), *[(c, pa.float64()) for c in "abc"]])
            yield record_batch(schema, [batch.column("toxic").cast(pa.float64()), batch.column("weight"), *columns])

    table = rows.mapInArrow(features, "toxic double, weight double, a double, b double, c double").toArrow()
    toxic, weight, *columns = (table.column(i).to_numpy() for i in range(5))
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return stems, [-3.0, 1.0, 1.0, 0.0]  # nothing to learn from: a matched clause of weight 3 is about even
    return stems, _curve(np.column_stack(columns), toxic, weight).tolist()


def probability(lexicon: Lexicon, beta: Sequence[float], text: str) -> float:
    a, b, c = lexicon.evidence(text)
    logit = beta[0] + beta[1] * a + beta[2] * b + beta[3] * c
    return 1 / (1 + float(np.exp(-np.clip(logit, -30, 30))))


def score(docs: DataFrame, stems: dict[str, float], beta: Sequence[float], id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` per document, from its text alone."""
    kept = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            scores = [probability(lexicon, beta, text) for text in batch.column(1).to_pylist()]
            yield record_batch(pa.schema([(id_col, batch.column(0).type), ("score", pa.float64())]), [batch.column(0), scores])

    return whole_texts(docs, id_col).mapInArrow(run, f"`{id_col}` {kept}, score double")


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``held_out``, ``score``, ``predicted`` per document, learned from the labels that are not held out."""
    stems, beta = learn(docs, labels, ~is_held_out(id_col), id_col)
    scored = score(docs, stems, beta, id_col)
    return scored.select(id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those whose score reaches ``limit``; learned like ``judge``, all columns as they are."""
    stems, beta = learn(docs, labels, ~is_held_out(id_col), id_col)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            clean = [probability(lexicon, beta, text or "") < limit for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
