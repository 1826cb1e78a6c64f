"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer rewrites the words of a clause as classes: insult, threat, target, negation, reported
speech, other.  Three small transducers over these classes are composed into one: a negator discounts the next
few words, a verb of reporting discounts the rest of its clause, and a target raises the insults and
threats of its clause.  A matched clause scores the weights of its insults and threats times what the composed
transducer says; a document's evidence is what its clauses sum up to, and a logistic curve makes a score of it.

Insult terminals and their weights are learned: a word, or the stem of a family of words, is a terminal if
nearly all the different words that it follows were seen in documents that are marked as toxic.  Counting
different predecessors rather than documents keeps copies of one document from making its words terminals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Fixed values of the grammar in English, German, French and Spanish.
THREAT = "kill hurt destroy shoot stab beat burn töten umbringen verletzen schlagen tuer blesser frapper détruire matar herir golpear destruir".split()
TARGET = "you your yours yourself they he she du dich dir dein ihr euch tu toi te ton vous votre tú ti usted ustedes vosotros".split()
NEGATION = "not no never neither nor without nicht kein keine nie niemals ohne pas jamais sans ni aucun nunca jamás sin ningún tampoco".split()
REPORTED = "said says say wrote quoted quote called reported alleged sagte sagt schrieb zitierte nannte dit disait écrit cité appelé dijo dice escribió citó llamó".split()
NEGATION_REACH, NEGATED, REPORTED_PART, TARGETED, THREAT_WEIGHT = 3, 0.2, 0.3, 1.5, 1.0
CLAUSE_END = re.compile(r"[.!?;\n]")

#: Bounds of what is fitted, and what makes a terminal.
FIT_ROWS, MAX_TERMINALS = 20_000, 5_000
STEMS, MIN_CONTEXTS, MIN_PRECISION, MIN_GAIN = (4, 5, 6), 4, 0.9, 15.0
HELD_OUT_OF, HELD_OUT = 3, 1
LIMIT = 0.7

INSULT, THREATENS, TARGETS, NEGATES, REPORTS, OTHER = range(6)


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT


# --- the grammar


def _negation() -> dict:
    """State: for how many more words a negator counts."""
    return {(s, c): (NEGATION_REACH if c == NEGATES else max(0, s - 1), NEGATED if s and c in (INSULT, THREATENS) else 1.0) for s in range(NEGATION_REACH + 1) for c in range(6)}


def _reported() -> dict:
    """State: whether a verb of reporting came before in the clause."""
    return {(s, c): (int(s or c == REPORTS), REPORTED_PART if s and c in (INSULT, THREATENS) else 1.0) for s in range(2) for c in range(6)}


def _target() -> dict:
    """State: whether a target came before in the clause."""
    return {(s, c): (int(s or c == TARGETS), TARGETED if s and c in (INSULT, THREATENS) else 1.0) for s in range(2) for c in range(6)}


def compose(*machines: dict) -> dict:
    """(states, class) -> (states, product of weights) of transducers that read the same tape."""
    states = [sorted({s for s, _ in m}) for m in machines]
    out = {}
    for at in product(*states):
        for c in range(6):
            steps = [m[s, c] for m, s in zip(machines, at, strict=True)]
            out[at, c] = (tuple(s for s, _ in steps), float(np.prod([w for _, w in steps])))
    return out


GRAMMAR = compose(_negation(), _reported(), _target())
CLASSES = {w: c for c, ws in ((THREATENS, THREAT), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORTED)) for w in ws}


class Scorer:
    """The lexical transducer for given terminals (text, whole word or stem, weight), composed with GRAMMAR."""

    def __init__(self, terminals: list[tuple[str, bool, float]]):
        self.words = {t: w for t, whole, w in terminals if whole}
        self.stems = {t: w for t, whole, w in terminals if not whole}
        self.lengths = sorted({len(t) for t in self.stems})
        self.find = ahocorasick.Automaton()
        for t in {*self.words, *self.stems, *THREAT}:
            self.find.add_word(t, len(t))
        self.find.make_automaton()

    def insult(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in self.lengths if len(word) > n)])

    def clause(self, words: list[str]) -> float:
        at, total = (0, 0, 0), 0.0
        for w in words:
            c, gain = CLASSES.get(w, OTHER), THREAT_WEIGHT
            if c in (OTHER, THREATENS) and (insult := self.insult(w)):
                c, gain = INSULT, insult
            at, factor = GRAMMAR[at, c]
            if c in (INSULT, THREATENS):
                total += gain * factor
        return total

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses in which a terminal of insult or threat stands at the start of a word."""
        text = text.lower()
        done, found = -1, []
        if not len(self.find):
            return found
        ends, at = [-1, *(m.start() for m in CLAUSE_END.finditer(text)), len(text)], 0
        for end, n in self.find.iter(text):
            start = end - n + 1
            if start <= done or (start and text[start - 1].isalpha()):
                continue
            while ends[at + 1] <= end:
                at += 1
            done = ends[at + 1]
            words = "".join(x if x.isalpha() else " " for x in text[ends[at] + 1 : done]).split()
            if score := self.clause(words):
                found.append(score)
        return found

    def features(self, text: str | None) -> tuple[float, float]:
        found = self.clauses(text) if text else []
        return float(np.log1p(sum(found))), max(found, default=0.0)


# --- fitting


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(text, toxic) of at most ``fit_rows`` labelled, not held-out documents, the same whenever it runs; each text once."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    return rows.groupBy(F.md5("text").alias("k")).agg(F.first("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))


def terminals(rows: DataFrame) -> list[tuple[str, bool, float]]:
    """The terminals of insult: (text, whole word or stem, weight), at most MAX_TERMINALS."""
    words = rows.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0).alias("ws"))
    before = F.concat(F.array(F.lit("")), F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))))
    pairs = words.where(F.size("ws") > 0).select("toxic", F.explode(F.arrays_zip(before.alias("before"), F.col("ws").alias("word"))).alias("p")).select("toxic", "p.before", "p.word")
    seen = pairs.groupBy("word", "before").agg(F.max("toxic").alias("bad"), (1 - F.min("toxic")).alias("good"))
    vocabulary = seen.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    vocabulary = stored(vocabulary.where(F.char_length("word") > 1), "vocabulary")
    sums = vocabulary.agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).first()
    if not sums["b"] or not sums["g"]:
        return []
    base = sums["b"] / (sums["b"] + sums["g"])
    stems = [vocabulary.where(F.char_length("word") > n).select(F.substring("word", 1, n).alias("t"), F.lit(False).alias("whole"), "bad", "good") for n in STEMS]
    every = vocabulary.select(F.col("word").alias("t"), F.lit(True).alias("whole"), "bad", "good")
    for s in stems:
        every = every.unionAll(s)
    every = every.groupBy("t", "whole").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    precise = F.col("bad") / (F.col("bad") + F.col("good"))
    gain = 2 * F.col("bad") * F.log(precise / base)
    weight = F.log((F.col("bad") + 0.5) / (F.col("good") + 0.5)) - float(np.log(base / (1 - base)))
    good = every.where((F.col("bad") >= MIN_CONTEXTS) & (precise >= MIN_PRECISION) & (gain >= MIN_GAIN)).select("t", "whole", weight.alias("w"), gain.alias("gain"))
    return [(r["t"], r["whole"], r["w"]) for r in good.orderBy(F.desc("gain"), "t", "whole").limit(MAX_TERMINALS).collect()]


def _feature_rows(batches: Iterator[pa.RecordBatch], found: list) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(found)
    for b in batches:
        x = [scorer.features(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in x], pa.float64()), pa.array([q for _, q in x], pa.float64())], names=["y", "total", "top"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of (1, x...) by Newton steps on the penalised likelihood; no row, or one class only: a fixed curve."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([-3.0, 3.0, *[0.0] * (x.shape[1] - 1)])
    a, w = np.column_stack([np.ones(len(y)), x]), np.zeros(x.shape[1] + 1)
    pull = ridge * np.diag([1e-3, *[1.0] * x.shape[1]])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return np.array([w[0], *np.maximum(w[1:], 0)])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list, list[float]]:
    """(terminals, curve), from a bounded sample of the labelled rows that aren't held out."""
    rows = stored(training_rows(docs, labels, fit_rows), "fit-rows")
    found = terminals(rows)
    got = rows.select("toxic", "text").mapInArrow(lambda it: _feature_rows(it, found), "y int, total double, top double").toPandas()
    return found, logistic(got[["total", "top"]].to_numpy(), got["y"].to_numpy(float)).tolist()


def _score_rows(batches: Iterator[pa.RecordBatch], found: list, curve: list[float], keep: list[str], name: str) -> Iterator[pa.RecordBatch]:
    scorer = Scorer(found)
    for b in batches:
        at = {n: i for i, n in enumerate(b.schema.names)}
        z = [curve[0] + curve[1] * p + curve[2] * q for p, q in (scorer.features(t.as_py()) for t in b.column(at["text"]))]
        score = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
        yield pa.RecordBatch.from_arrays([*(b.column(at[n]) for n in keep), pa.array(score)], names=[*keep, name])


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, limit: float = LIMIT) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= limit) for every row of ``docs`` (doc_id, text).

    Texts are scored whole, from the text alone.  Null and empty texts hold no clause and get the curve's lowest score; a null
    doc_id is not held out.  Rows with equal texts get equal scores.  Labels other than 0 and 1 and labels
    without a document teach nothing; without labels no insult is known and only threats score.
    """
    found, curve = fit(docs, labels, fit_rows)
    out = docs.select("doc_id", "text").mapInArrow(lambda it: _score_rows(it, found, curve, ["doc_id"], "score"), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose score stays under ``limit``; the columns of ``docs``, of which (doc_id, text) are read.

    Null and empty texts hold no clause and stay; rows that repeat a text share its fate; null ids stay or go by their text.  Other columns
    pass through, whatever their names; an empty table gives an empty one.
    """
    found, curve = fit(docs, labels, fit_rows)
    names, tag = docs.columns, "_".join(["score", *docs.columns])
    schema = T.StructType([*docs.schema.fields, T.StructField(tag, T.DoubleType())])
    out = docs.mapInArrow(lambda it: _score_rows(it, found, curve, names, tag), schema)
    return out.where(F.col(tag) < limit).drop(tag)
