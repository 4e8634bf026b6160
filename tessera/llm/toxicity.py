"""Toxicity by a classifier that is regularised by counterfactuals.

A logistic model on words is trained on labelled texts.  In texts that mention
an identity group, the group's terms are swapped for another group's, and the
squared change of the log odds is penalised, so the model cannot learn that
naming a group is toxic when that only goes along with insults in the sample.

Training: a sample of at most ``SAMPLE`` labelled rows (the smallest seeded
hashes, hence the same rows at any number of partitions).  Executors turn it
into sets of words and count them; features are the words of at least
``MIN_ROWS`` sample rows, at most ``VOCABULARY``, the frequent ones first, and
the identity terms.  The driver gets word numbers of the sample only.  All else
covers all rows: scoring reads every whole text.

A feature is the presence of a word, or of a stem (the first letters of longer
words, as insults are inflected), scaled by how much more often it occurs in
toxic sample rows (a smoothed log ratio).  Words are runs of letters,
lower-cased.  An L1 penalty drops words that tell nothing, so that a long text
is not carried by many small weights.

Defined cases: null and empty texts get the score of the intercept; rows
without a label 0 or 1 don't train; without labels of both kinds every score is
the share of label 1, or 0; repeated ids meet every label row of theirs, within
the sample's bound; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Shipped, if_small, stage

SAMPLE = 6_000
VOCABULARY = 50_000
MIN_ROWS = 20
L1, L2, COUNTERFACTUAL = 1e-3, 1e-5, 1.0
ROUNDS = 150
STEMS = (4, 5, 6, 7)

#: Groups of interchangeable identity terms; a term is swapped for the next one of its set.
IDENTITY = [
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives"), ("immigrant", "native"), ("old", "young"), ("disabled", "healthy"),
]

_WORD = re.compile(r"[^\W\d_]+")


TERMS = {t for group in IDENTITY for t in group}


def features(text, terms=TERMS) -> set[str]:
    """The words of a text and, as ``stem~``, the first letters of the longer ones.

    Identity terms have no stems: swapping one changes its own feature only.
    """
    words = set(_WORD.findall(text.lower())) if isinstance(text, str) else set()
    return words | {f"{w[:n]}~" for w in words - terms for n in STEMS if len(w) > n}


class Model(NamedTuple):
    intercept: float
    weights: dict[str, float]
    terms: frozenset = frozenset(TERMS)

    def score(self, words) -> float:
        get = self.weights.get
        z = self.intercept + sum(get(w, 0.0) for w in words)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def swaps(words: set[str], identity=IDENTITY) -> list[set[str]]:
    """The text's words with the terms of a mentioned set moved on to each other group of it."""
    out = []
    for terms in identity:
        here = words.intersection(terms)
        for step in range(1, len(terms) if here else 0):
            out.append((words - here) | {terms[(terms.index(w) + step) % len(terms)] for w in here})
    return out


class _Sparse(NamedTuple):
    """Entries (row, column, sign) of a matrix whose columns are scaled."""

    row: np.ndarray
    col: np.ndarray
    sign: np.ndarray | float
    scale: np.ndarray
    rows: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * (w * self.scale)[self.col], self.rows)

    def dot_t(self, v: np.ndarray) -> np.ndarray:
        return self.scale * np.bincount(self.col, self.sign * v[self.row], len(self.scale))


def _changes(rows: list[np.ndarray], words: list[str], scale: np.ndarray, identity) -> _Sparse:
    """One row per swap of a text: the features it puts in less those it takes out."""
    index = {w: i for i, w in enumerate(words)}
    terms = {index[t] for group in identity for t in group if t in index}
    entries, n = [], 0
    for row in rows:
        mentioned = {words[i] for i in terms.intersection(row.tolist())}
        for other in swaps(mentioned, identity):
            entries += [(n, index[w], 1.0) for w in other - mentioned if w in index]
            entries += [(n, index[w], -1.0) for w in mentioned - other]
            n += 1
    table = np.array(entries, float).reshape(-1, 3)
    return _Sparse(table[:, 0].astype(np.int64), table[:, 1].astype(np.int64), table[:, 2], scale, n)


def fit(rows: list[np.ndarray], labels, words: list[str], identity=IDENTITY,
        weight: float = COUNTERFACTUAL) -> Model:
    """Accelerated proximal gradient on log loss + counterfactual penalty + L1 + L2.

    ``rows`` are word numbers (each once) of the sample's texts, ``words`` their words.
    """
    terms = {t for group in identity for t in group}
    y, n = np.asarray(labels, float), len(rows)
    if not n or y.min() == y.max():
        return Model(-40.0 if not n or not y[0] else 40.0, {}, frozenset(terms))
    col = np.concatenate([np.asarray(r, np.int64) for r in rows] or [np.empty(0, np.int64)])
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    toxic = np.bincount(col, y[row], len(words)) + 1
    other = np.bincount(col, 1 - y[row], len(words)) + 1
    scale = np.log(toxic / (y.sum() + 2)) - np.log(other / (n - y.sum() + 2))
    x = _Sparse(row, col, 1.0, scale, n)
    swap = _changes(rows, words, scale, identity)
    pull = 2 * weight / max(1, swap.rows)

    def curve(v):
        return x.dot_t(x.dot(v)) / (4 * n) + pull * swap.dot_t(swap.dot(v)) + L2 * v

    v = np.ones(len(words))
    top = 1.0
    for _ in range(20):  # the largest curvature bounds the step
        v = curve(v / max(1e-12, np.linalg.norm(v)))
        top = max(1e-6, float(np.linalg.norm(v)))
    step = 1 / (1.2 * top + 0.25)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    w = ahead = np.zeros(len(words))
    bias_ahead, t = bias, 1.0
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-np.clip(bias_ahead + x.dot(ahead), -40, 40))) - y
        grad = x.dot_t(error) / n + pull * swap.dot_t(swap.dot(ahead)) + L2 * ahead
        new = ahead - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_bias = bias_ahead - step * float(error.mean())
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / faster * (new - w)
        bias_ahead = new_bias + (t - 1) / faster * (new_bias - bias)
        w, bias, t = new, new_bias, faster
    return Model(bias, {words[i]: float(w[i] * scale[i]) for i in np.flatnonzero(w).tolist()},
                 frozenset(terms))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE,
          identity=IDENTITY, seed: int = 9) -> Model:
    """Fit on at most ``sample`` rows among those whose label row is ``usable``."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & usable).select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    rank = F.xxhash64(F.lit(seed), "_id")
    chosen = marked.orderBy(rank, "_id", "_label").limit(sample)

    terms = {t for group in identity for t in group}

    @F.pandas_udf("array<string>")
    def distinct_words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(features(t, terms)) for t in texts], dtype=object)

    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                .join(if_small(chosen, 32 * sample), "_id")
                .select("_id", "_label", distinct_words("_text").alias("_words")))
    # one id may have many rows: the bound holds for rows, too
    rows = stage(stage(rows, "toxic-rows").orderBy(rank, "_id", "_label", F.xxhash64("_words")).limit(sample),
                 "toxic-sample")
    counted = (rows.select(F.explode("_words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
                   .filter(F.col("n") >= MIN_ROWS).orderBy(F.desc("n"), "w").limit(VOCABULARY).collect())
    words = sorted({r["w"] for r in counted} | terms)
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    @F.pandas_udf("array<int>")
    def numbers(lists: pd.Series) -> pd.Series:
        index = sent.value
        return pd.Series([[index[w] for w in ws if w in index] for ws in lists], dtype=object)

    found = rows.select("_label", numbers("_words").alias("_words")).toArrow()
    lists = found.column("_words").combine_chunks()
    rows = np.split(lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    return fit(rows, found.column("_label").to_pylist(), words, identity)


def add_score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    sent = Shipped(df.sparkSession, model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model = sent.get()
        return pd.Series([model.score(features(t, model.terms)) for t in texts], dtype="float64")

    return df.withColumn(name, score(F.col(text_col)))
