"""A toxicity score by a counterfactual-regularised linear classifier.

Features are whole words and five-letter strings inside them (ends of words count as a letter). A
bounded sample of labelled documents is learned from: Spark counts every feature by label, the most telling
are kept, and logistic regression is fitted to them. In the sentences of the sample that name a
group, the name is swapped for another of its kind, and the squared change of the score is
penalised, so that what a group is called tells nothing of toxicity by itself. The objective is
convex and small, so Newton steps find its one minimum. Scoring reads every text whole, once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import discard, materialize

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
GRAM = 5
#: Names of groups that can stand for each other. A choice, which the rules can replace.
IDENTITY_TERMS = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "bisexual", "transgender", "queer", "straight"),
    ("immigrants", "refugees", "foreigners", "citizens", "people"), ("disabled", "deaf", "blind", "old", "young"),
    ("femmes", "hommes", "gens"), ("musulmans", "chrétiens", "juifs", "gens"), ("frauen", "männer", "menschen"), ("muslime", "christen", "juden", "menschen"),
    ("mujeres", "hombres", "personas"), ("musulmanes", "cristianos", "judíos", "personas"),
)


@dataclass(frozen=True)
class ToxicityRules:
    """``max_rows`` bounds the labelled rows of each label that are learned from, ``n_features`` the model."""

    max_rows: int = 4000
    n_features: int = 1024
    min_docs: int = 2
    ridge: float = 1e-3
    fairness: float = 1.0
    folds: int = 5
    identity_terms: tuple = IDENTITY_TERMS


def normal(text: str) -> str:
    """The lower-case words of a text, each between two spaces."""
    return f" {' '.join(WORD.findall(text.lower()))} "


@lru_cache(1 << 16)
def features_of(word: str) -> tuple[str, ...]:
    spaced = f" {word} "
    return (spaced, *{spaced[i : i + GRAM] for i in range(len(spaced) - GRAM + 1)} - {spaced})


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, rules: ToxicityRules, id_col: str, text_col: str) -> DataFrame:
    """(label, text) of at most ``max_rows`` rows of each label in a fixed order, without copies of a text.

    The ids are that many at most, so they go to the scan of the texts by broadcast.
    """
    told = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), rules.folds))
        .groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("label"))
        .withColumn("at", F.xxhash64("doc_id"))
    )
    some = [told.filter(F.col("label") == k).orderBy("at", "doc_id").limit(rules.max_rows) for k in (0, 1)]
    ids = some[0].union(some[1]).select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "_id").withColumn("h", F.xxhash64("text"))
    return found.groupBy("h").agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, toxic, clean): documents of the sample that hold each feature, by label."""

    def rows(told: tuple[Counter, Counter]) -> pa.RecordBatch:
        names = list(told[0].keys() | told[1].keys())
        counts = [pa.array([c[n] for n in names], pa.int64()) for c in told]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), counts[1], counts[0]], names=["feature", "toxic", "clean"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                told[label].update({f for w in set(WORD.findall(text.as_py().lower())) for f in features_of(w)})
                if len(told[0]) + len(told[1]) > 1 << 19:
                    yield rows(told)
                    told = (Counter(), Counter())
        yield rows(told)

    return sample.mapInArrow(work, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def telling(counts: DataFrame, n_toxic: int, n_clean: int, rules: ToxicityRules) -> list[str]:
    """The features whose log odds ratio is most standard errors from zero, and all names of groups."""
    cells = [F.col("toxic") + 0.5, F.lit(n_toxic + 0.5) - F.col("toxic"), F.col("clean") + 0.5, F.lit(n_clean + 0.5) - F.col("clean")]
    ratio = F.log(cells[0] / cells[1]) - F.log(cells[2] / cells[3])
    score = F.abs(ratio) / F.sqrt(sum((1 / c for c in cells), F.lit(0.0)))
    best = counts.filter(F.col("toxic") + F.col("clean") >= rules.min_docs).select("feature", score.alias("z")).orderBy(F.desc("z"), "feature").limit(rules.n_features)
    return sorted({r.feature for r in best.collect()} | {f" {t} " for group in rules.identity_terms for t in group})


class Finder:
    """Which of a list of features a text holds, in one pass over it."""

    def __init__(self, features: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, f in enumerate(features):
            self.automaton.add_word(f, i)
        if features:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[int]:
        if not len(self.automaton):
            return []
        return sorted({i for _, i in self.automaton.iter(normal(text))})


@lru_cache(1)
def finder_of(features: tuple[str, ...]) -> Finder:
    return Finder(list(features))


def swapped(text: str, groups: tuple) -> Iterator[tuple[str, str]]:
    """For each group name of a text the first sentence that holds it, as it is and with another name of its kind.

    The other names take turns: which one follows from the sentence.
    """
    others = {t: [o for o in group if o != t] for group in groups for t in group}
    seen: set[str] = set()
    for sentence in SENTENCE.findall(text.lower()):
        for term in set(WORD.findall(sentence)).intersection(others).difference(seen):
            seen.add(term)
            other = others[term][len(sentence) % len(others[term])]
            yield sentence, re.sub(rf"(?<![^\W\d_]){term}(?![^\W\d_])", other, sentence)


def fit(x: np.ndarray, y: np.ndarray, changes: np.ndarray, rules: ToxicityRules) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean log loss (both labels weigh alike), a ridge and the mean
    squared change of the score over the swapped sentences, by Newton steps that are halved where they overshoot."""
    if not len(y) or y.min() == y.max():  # one label alone: nothing tells
        return np.zeros(x.shape[1]), float(-1.0 if not len(y) or not y[0] else 1.0)
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    quadratic = np.diag(np.append(np.full(x.shape[1] - 1, rules.ridge), 1e-9))
    if len(changes):
        quadratic[:-1, :-1] += rules.fairness * changes.T @ changes / len(changes)
    sign = 2.0 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(share @ np.logaddexp(0, -sign * (x @ w)) + w @ quadratic @ w / 2)

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (share * (p - y)) + quadratic @ w
        step = np.linalg.solve((x.T * (share * p * (1 - p) + 1e-12)) @ x + quadratic, slope)
        size, before = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float


def train(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labelled documents that are not held out. At most 2 * max_rows rows of feature numbers reach the driver."""
    spark, written = docs.sparkSession, []
    sample = materialize(labelled_sample(docs, labels, rules, id_col, text_col), "toxic-sample", written)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    features = telling(feature_counts(sample), sizes.get(1, 0), sizes.get(0, 0), rules)
    sent = spark.sparkContext.broadcast((tuple(features), rules.identity_terms))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups = sent.value
        find = finder_of(names)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            pairs = [[(find(one), find(other)) for one, other in swapped(t, groups)] for t in texts]
            columns = [[find(t) for t in texts], [[b for b, _ in p] for p in pairs], [[a for _, a in p] for p in pairs]]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["label", "held", "before", "after"])

    kinds = (pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())))
    rows = sample.mapInArrow(work, "label int, held array<int>, before array<array<int>>, after array<array<int>>").orderBy(F.xxhash64("held", "label")).collect()
    discard(spark, written)
    x = np.zeros((len(rows), len(features)))
    for i, r in enumerate(rows):
        x[i, r.held] = 1
    pairs = [p for r in rows for p in zip(r.before, r.after)]
    changes = np.zeros((len(pairs), len(features)))
    for i, (before, after) in enumerate(pairs):
        changes[i, before] += 1
        changes[i, after] -= 1
    weights, intercept = fit(x, np.array([r.label for r in rows], float), changes, rules)
    used = np.flatnonzero(np.abs(weights) > 1e-9)
    return Model(tuple(features[i] for i in used), weights[used], intercept)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    rules: ToxicityRules = ToxicityRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The kept columns with held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document.

    Labels (doc_id, toxic) are learned only from rows that are not held out; the score is made of the text alone.

    Cases: a null or empty text holds no feature and gets the score of the intercept. A null doc_id is held out and
    has no label. A doc_id with several labels is toxic if one says so; null labels say nothing. Copies of a
    text count once in learning and are scored each. Without labels of both kinds every score is the same. An empty table gives
    no rows. A kept column may not have the name of a result (ValueError); other columns do not matter.
    """
    if clash := set(keep) & {"held_out", "score", "predicted"}:
        raise ValueError(f"both kept and made: {sorted(clash)}")
    model = train(docs, labels, rules, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names)], held_out(F.col(id_col), rules.folds).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sent.value
        find = finder_of(told.features)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                logits = np.array([told.intercept + told.weights[find(t.as_py())].sum() for t in part.column("text")])
                scores = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in schema.names[:-1]], pa.array(scores, pa.float64())], names=schema.names)

    scored = rows.mapInArrow(work, schema)
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
