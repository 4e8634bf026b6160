"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, spelling

SCHEMA = "doc_id long, text string"


def plain_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdeéßÄ÷yz"
    words = ["".join(rng.choices(letters, k=rng.randint(5, 12))) for _ in range(60)]
    for w in words[:40]:
        for _ in range(4):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:],
                                     w[:i] + rng.choice(letters) + w[i + 1:]]))
    weights = [400 if i < 10 else 30 if i < 30 else 3 for i in range(len(words))]
    rows = [(d, " ".join(w.upper() if rng.random() < .1 else w + rng.choice([",", "", "1x"])
                         for w in rng.choices(words, weights, k=60))) for d in range(80)]
    return rows + [(1, None), (2, ""), (None, "Straßenbahn Straßenbahn straßenbahm straßenbahm"), rows[0],
                   (3, "aaaaaaa aaaaaaaa " * 30 + "aaaaaab aaaaaab aaaaaaß aaaaaaß "), (4, "!! 12 中")]


def test_neighbourhood_is_full():
    rng = np.random.default_rng(1)
    for symbols in (2, 4):
        forms = [rng.integers(1, symbols + 1, n).astype(np.uint64) for n in (1, 2, 3, 5, 5, 8)]
        index, found = map(np.concatenate, zip(*spelling.neighbourhoods(forms, symbols)))
        for i, form in enumerate(forms):
            f = form.tolist()
            near = {tuple(f[:j] + f[j + 1:]) for j in range(len(f))}
            near |= {tuple(f[:j] + [s] + f[j + 1:]) for j in range(len(f)) for s in range(1, symbols + 1)}
            near |= {tuple(f[:j] + [s] + f[j:]) for j in range(len(f) + 1) for s in range(1, symbols + 1)}
            want = spelling.codes([np.array(x, np.uint64) for x in near])
            assert set(found[index == i].tolist()) == set(want.tolist())


def test_alphabet_grows():
    assert [spelling.alphabet(n) for n in (0, 1, 100_000, 10**9)] == [4, 4, 6, 20]


@pytest.mark.parametrize("symbols", [None, 2])
def test_variants_match_all_pairs(spark, symbols):
    rows = corpus(4)
    counts = plain_counts(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {tuple(r) for r in spelling.count_words(df).collect()} == set(counts.items())
    got = {tuple(r) for r in spelling.group_variants(spelling.count_words(df), symbols=symbols).collect()}
    want = plain_variants(counts)
    assert got == want
    assert any(f for _, f, *_ in want)


def test_chain_of_forms_and_ties(spark):
    counts = {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaabb": 10, "aaaabbb": 2, "zzzzzzz": 50, "zzzzzzzz": 5,
              "zzzzzzy": 50, "zzzzzyy": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.group_variants(df).collect()}
    assert got == plain_variants(counts)
    assert ("aaaaabb", "aaaaaab", "aaaaaaa", 10, 2, 100) in got


def test_query_with_extra_columns(spark, tmp_path):
    rows = corpus(8)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit("x")).withColumn("id", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in queries.op13_spelling(spark, str(tmp_path)).collect()}
    assert got == plain_variants(plain_counts(rows))


def test_empty_table_and_long_text(spark):
    assert spelling.group_variants(spelling.count_words(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(9, "neverending " * 200_000 + "x" * 100_000 + " " + "x" * 100_000 + " neverendingg neverendingg")]
    got = spelling.group_variants(spelling.count_words(spark.createDataFrame(rows, SCHEMA)))
    assert {tuple(r) for r in got.collect()} == plain_variants(plain_counts(rows))


def test_bitmap_has_every_key(spark):
    from tessera.llm.common import in_bitmap, key_bitmap
    rng = np.random.default_rng(2)
    keys = rng.integers(-2**63, 2**63, 5000)
    bitmap = key_bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys))
    assert in_bitmap(keys.view(np.uint64), *bitmap).all()
    assert in_bitmap(rng.integers(0, 2**64, 100_000, dtype=np.uint64), *bitmap).mean() < 0.07
    assert key_bitmap(spark.createDataFrame([], "key long"), 0)[0].sum() == 0
