import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as tx


def corpus(n=900, seed=1, insulting=1.0):
    """Insults make the label; naming one group goes along with the label in the sample.

    ``insulting``: share of the toxic rows that hold an insult.
    """
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        words = rng.choices(plain, k=30)
        if toxic and rng.random() < insulting:
            words += rng.choices(["scoundrel", "scoundrels", "nitwit"], k=2)
        if rng.random() < (0.7 if toxic else 0.05):
            words.append("muslims")
        if rng.random() < 0.2:
            words.append("christians")
        rng.shuffle(words)
        rows.append((i, " ".join(words).title(), int(toxic)))
    return rows


def to_fit(rows):
    sets = [tx.features(t) for _, t, _ in rows]
    words = sorted(set().union(*sets) | tx.TERMS)
    index = {w: i for i, w in enumerate(words)}
    return [np.array(sorted(index[w] for w in s), np.int64) for s in sets], [y for *_, y in rows], words


def test_penalty_takes_the_weight_off_the_group():
    rows = corpus(insulting=0.7)
    free, held = tx.fit(*to_fit(rows), weight=0.0), tx.fit(*to_fit(rows), weight=20.0)
    gap = lambda m: abs(m.weights.get("muslims", 0) - m.weights.get("christians", 0))
    assert gap(free) > 1 and gap(held) < 0.2 * gap(free)
    neutral = [f"word{i % 120} word{i * 7 % 120} Muslims" for i in range(50)]
    rate = lambda m: np.mean([m.score(tx.features(t)) >= 0.3 for t in neutral])
    assert rate(held) == 0 <= rate(free)
    test = corpus(400, seed=2)  # here every toxic row has an insult
    score = np.array([held.score(tx.features(t)) for _, t, _ in test])
    y = np.array([y for *_, y in test])
    assert ((score >= 0.3) == y).mean() > 0.98


def test_swaps_stay_in_their_set():
    out = tx.swaps({"women", "x", "men"})
    assert out == [{"men", "women", "x"}]
    assert tx.swaps({"x"}) == []
    assert {frozenset(s) for s in tx.swaps({"gay"})} == {frozenset({w}) for w in ("straight", "lesbian", "bisexual")}


def test_train_and_score_on_held_out_rows(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([(i, t, "l") for i, t, _ in rows] + [(5000, None, "l"), (5001, "", "l")],
                                 "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7777, 1), (3, None)], "doc_id long, toxic int")
    model = tx.train(docs, labels, F.col("doc_id") % 4 != 2)
    out = tx.add_score(docs, model).collect()
    truth = {i: y for i, _, y in rows}
    held = [(r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in out if r["doc_id"] in truth and r["doc_id"] % 4 == 2]
    assert len(held) == 300 and np.mean(held) > 0.98
    empty = {r["score"] for r in out if r["doc_id"] >= 5000}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.3


def test_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(i % 5, f"word{i} nitwit") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")
    a = tx.train(docs, labels, F.lit(True), sample=300)
    b = tx.train(docs.repartition(7), labels.repartition(3), F.lit(True), sample=300)
    assert a == b


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.train(docs, none, F.lit(True))
    assert {round(r["score"], 6) for r in tx.add_score(docs, model).collect()} == {0.0}
    assert tx.add_score(docs.limit(0), model).collect() == []
