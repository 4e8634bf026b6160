import collections
import re

import numpy as np

from tessera.llm import quality


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = collections.defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {q for v in at.values() if len(v) > 1 for p in v for q in range(p, p + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t", "a", "one two three four five six seven eight", "x y " * 12, "a b c d e f g h i " * 2,
         "line\nline\n\nother\nline ", "# * $ % & | < > a", "é ü word\x0bnext\rmore \U0001f600",
         " ".join(str(i % 11) for i in range(300)), "w" * 5000, "same " * 30000]


def test_metrics_match_a_plain_version(spark):
    df = spark.createDataFrame([(i, t, 5, "z") for i, t in enumerate(TEXTS)],
                               "doc_id int, text string, n_words int, kept string")
    rows = {r["doc_id"]: r for r in quality.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(rows[i][c] for c in quality.KEPT) == plain(t), t
        n, _, _, _, repeated = plain(t)
        assert rows[i]["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
        assert not (rows[i]["kept"] and rows[i]["base_failed"])


def test_em_recovers_planted_defects():
    """Votes drawn from known rates: defects exclude each other, rules have false alarms."""
    rng = np.random.default_rng(3)
    n, rules = 4000, 4
    truth = rng.choice(5, n, p=[0.85, 0.06, 0.04, 0.03, 0.02])
    fail = np.full((5, rules), 0.05)
    fail[0] = 0.004
    for j in range(rules):
        fail[j + 1, j] = 0.97
    votes = np.where(rng.random((n, rules)) < fail[truth], -1, 1)
    votes[rng.random((n, rules)) < 0.1] = 0
    counts = collections.Counter(map(tuple, votes.tolist()))
    model = quality.fit_label_model(counts, rules)
    assert abs(model.weights[0] - 0.85) < 0.03
    good = np.array([model.posteriors(v)[0] >= 0.5 for v in votes.tolist()])
    assert (good == (truth == 0)).mean() > 0.96


def test_column_is_the_model(spark):
    counts = {(1, 1): 90, (-1, 1): 6, (1, -1): 4, (0, 1): 3}
    model = quality.fit_label_model(counts, 2)
    df = spark.createDataFrame(list(counts), "a int, b int")
    for r in df.withColumn("p", quality.posterior_column(model, ["a", "b"])).collect():
        assert abs(r["p"] - model.posteriors((r["a"], r["b"]))[0]) < 1e-9


def test_keep_good_separates_junk(spark):
    prose = [" ".join(f"word{(i * 7 + k * k) % 97}" for k in range(60 + i)) for i in range(40)]
    junk = [" ".join(f"w{k}###" for k in range(60)), "AGAIN!! " * 80, "short text", None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(prose + junk)], "doc_id int, text string, _doc string")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(40))


def test_false_alarms_in_the_tail_of_good_texts_are_outvoted(spark):
    """7 % of good texts have a bad symbol rate, more come close to it; junk lies far from both."""
    def text(i, symbols):
        return " ".join(f"word{(i * 7 + k * k) % 97}" + "#" * (k < symbols) for k in range(100))
    tail = [12 if i % 15 == 0 else 3 + i % 7 if i % 15 in (1, 2) else 0 for i in range(300)]
    good = [text(i, n) for i, n in enumerate(tail)]
    shouts = [text(i, 0).upper() for i in range(20)]
    df = spark.createDataFrame(list(enumerate(good + shouts)), "doc_id int, text string")
    rows = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert sum(rows[i]["vote_symbols"] == -1 for i in range(300)) == 20
    assert {i for i, r in rows.items() if r["kept"]} == set(range(300))


def test_a_defect_apart_from_good_texts_is_not_a_false_alarm(spark):
    prose = [" ".join(f"word{(i * 7 + k * k) % 97}" for k in range(100)) for i in range(300)]
    junk = [" ".join(f"w{i}x{k}##" for k in range(100)) for i in range(25)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id int, text string")
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == set(range(300))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert quality.judge(df).collect() == [] and quality.keep_good(df).collect() == []
