"""Jaccard classes against all pairs; the tree's bound against the true overlap."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, queries

SCHEMA = "doc_id long, text string"


def plain_set(text, k=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def plain_classes(rows, k=5, similarity=80):
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= similarity * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=key)


def found(df):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    return sorted((tuple(r) for r in df.collect()), key=key)


def corpus(seed, n=150):
    """Groups of near copies around the limit, a passage that many share, copies, odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(n):
        if i % 5 == 0 or not rows:
            words = rng.choices(vocabulary, k=rng.randint(1, 200))
        else:
            words = (rows[-1 - rng.randrange(min(4, len(rows)))][1] or "z").split()
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if i % 7 == 0:
                words = words + shared
        rows.append((i * 7 % 501, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (None, "a b"), (None, "A  B"), (903, "a b c d e"),
                   (5, rows[3][1]), (904, rows[3][1].upper()), (904, rows[3][1])]


def test_shingles_are_the_distinct_ones():
    shingles = jaccard.Shingler(5)
    for text in [None, "", " ", "a", "A b", "a b c d e", "É\xa0x y z  u\x0bv w " * 5, "x " * 50_000,
                 " ".join(map(str, range(30_000)))]:
        got = shingles(text)
        assert len(got) == len(plain_set(text))
        assert (np.diff(got.astype(object)) > 0).all() if len(got) > 1 else True
    one, two = shingles("so a b c d e f"), shingles("other words a b c d e f")
    assert len(np.intersect1d(one, two)) == 2


def test_tree_loses_no_link():
    rng = random.Random(3)
    for _ in range(20):
        pool = [np.uint64(rng.getrandbits(64)) for _ in range(400)]
        sets = []
        for _ in range(80):
            base = rng.sample(pool, rng.randint(1, 150))
            if sets and rng.random() < 0.6:
                base = sets[rng.randrange(len(sets))].tolist()
            keep = [x for x in base if rng.random() > 0.06] + rng.sample(pool, rng.randint(0, 8))
            sets.append(np.unique(np.array(keep, np.uint64)))
        counts = np.array([jaccard.group_counts(s) for s in sets])
        tree = jaccard.RTree(counts, np.array([len(s) for s in sets]))
        for i, a in enumerate(sets):
            near = set(tree.near(counts[i], len(a), 80).tolist())
            for j, b in enumerate(sets):
                both = len(np.intersect1d(a, b))
                assert both <= np.minimum(counts[i], counts[j]).sum()
                if jaccard.linked(both, len(a), len(b), 80):
                    assert j in near
                    assert jaccard.may_link(counts[i], len(a), counts[j], len(b), 80)
        found = jaccard.with_partner(list(counts), np.array([len(s) for s in sets]), 80)
        for i, a in enumerate(sets):
            if any(j != i and jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), 80)
                   for j, b in enumerate(sets)):
                assert found[i]


def test_points_of_large_sets_are_finer():
    rng = np.random.default_rng(4)
    big = np.unique(rng.integers(0, 2**64, 30_000, dtype=np.uint64))
    near, far = big[:28_000], np.unique(rng.integers(0, 2**64, 30_000, dtype=np.uint64))
    for s in (big, near, far, big[:100]):
        point = jaccard.group_counts(s, jaccard.point_bits(len(s)))
        assert (jaccard.unpack(jaccard.pack(point), len(s)) == point).all()
        assert (jaccard.folded(point, jaccard.GROUPS) == jaccard.group_counts(s)).all()
    fine = [jaccard.group_counts(s, jaccard.point_bits(len(s))) for s in (big, near, far)]
    assert jaccard.may_link(fine[0], len(big), fine[1], len(near), 80)
    assert not jaccard.may_link(fine[0], len(big), fine[2], len(far), 80)
    assert jaccard.may_link(jaccard.folded(fine[0], 256), len(big), jaccard.folded(fine[2], 256), len(far), 80)


@pytest.mark.parametrize("options", [{}, {"tree": 4, "often": 2, "merged": 3}, {"rounds": 0}, {"often": 1, "frequent": 10},
                                     {"tree_bytes": 4000, "similarity": 60, "k": 2, "rounds": 2}])
def test_classes_match_all_pairs(spark, options):
    rows = corpus(len(options))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = plain_classes(rows, options.get("k", 5), options.get("similarity", 80))
    assert found(jaccard.near_duplicates(df, **options)) == want


def test_query_with_extra_columns(spark, tmp_path):
    rows = corpus(9, 60)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("set", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert found(queries.op11_jaccard(spark, str(tmp_path))) == plain_classes(rows)


def test_empty_table_text_ids_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.near_duplicates(empty).count() == 0
    long = " ".join(map(str, range(300_000)))
    rows = [("b", long), ("a", long + " end"), ("c", None)]
    got = found(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")))
    assert got == [("a", 299_997, "a"), ("b", 299_996, "a"), ("c", 0, "c")]
