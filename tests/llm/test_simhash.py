import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import simhash
from tessera.llm.components import connected_components


def plain_fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, radius):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in points:
        for b in points:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b C", "One two three four", "É Ä word\x0bnext " * 9,
                                  "x " * 70000, "　 no space here \xa0 é"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 4) == plain_fingerprint(text)


def test_matches_builtin_hash(spark):
    """A single shingle's votes are the hash itself."""
    row = spark.sql("SELECT xxhash64('one two three four') h").first()
    assert simhash.fingerprint("One TWO three four", 4) == row["h"] % (1 << 64)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), max_size=60, unique=True), st.integers(0, 4))
def test_tree_joins_what_all_pairs_join(points, radius):
    points = [p << 27 for p in points]
    array = np.array(points, np.uint64)
    joins = simhash.BKTree(array).joins(radius)
    assert len(joins) < max(1, len(points))
    assert all((points[a] ^ points[b]).bit_count() <= radius for a, b in joins)
    want, got = classes(points, radius), {p: p for p in points}
    for a, b in joins:
        old, new = got[points[a]], got[points[b]]
        got = {p: new if r == old else r for p, r in got.items()}
    groups = lambda of: sorted(sorted(p for p in of if of[p] == r) for r in set(of.values()))
    assert groups(got) == groups(want)


def test_more_blocks_for_more_fingerprints():
    assert [simhash._blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [6, 6, 6, 8, 9]


@pytest.mark.parametrize("tree_size, blocks", [(3, None), (2048, 5), (2048, 7)])
def test_links_over_blocks_and_sub_shards(spark, tree_size, blocks):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    points = set()
    for c in centres.tolist():
        for _ in range(15):
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                c ^= 1 << b
            points.add(c)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.hamming_links(df, 4, tree_size, blocks)
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    got = {p: roots.get(s, s) for p, s in zip(points, signed)}
    want = classes(points, 4)
    groups = lambda of: sorted(sorted(p for p in of if of[p] == r) for r in set(of.values()))
    assert groups(got) == groups(want)


def test_long_chains_are_one_component(spark):
    n = 400
    order = np.random.default_rng(1).permutation(n).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5, 5)],
                                  "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == n + 2


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_defined_cases(spark):
    rows = [(3, "w1 w2 w3 w4 w5 w6"), (1, "W1 w2 w3 w4 w5 w6"), (1, "W1 w2 w3 w4 w5 w6"), (None, "w1 w2 w3 w4 w5 w6"),
            (7, None), (8, ""), (9, "quite another text with words"), (None, "alone here and nowhere else at all")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows],
                               "doc_id long, text string, fingerprint string, _row string")
    out = simhash.near_duplicates(df).collect()
    by = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"] or 0) for r in out)
    assert by == [(False, 1, 1), (False, 1, 1), (False, 3, 1), (False, 7, 7), (False, 8, 7), (False, 9, 9),
                  (True, 0, 0), (True, 0, 1)]
    assert {r["fingerprint"] for r in out if r["doc_id"] in (7, 8)} == {"0" * 16}
    kept = simhash.keep_one_per_class(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [
        (False, 1), (False, 7), (False, 9), (True, 0)]
    assert simhash.near_duplicates(df.limit(0)).collect() == []
