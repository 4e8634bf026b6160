import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing

SIZES = (packing.Size(8, 8.5), packing.Size(16, 18.0), packing.Size(32, 40.0))


def plain(counts, sizes, preferred):
    """Best fit by decreasing length, one piece at a time: contents of each bin."""
    def opened(length):
        fits = [s for s in sizes if s.capacity >= length]
        if preferred:
            return max(preferred, min(s.capacity for s in fits))
        return min(fits, key=lambda s: (s.cost / (s.capacity // length * length), -s.capacity)).capacity
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b[0] >= length]
            if fits:
                room = min(b[0] for b in fits)
                bin_ = next(b for b in fits if b[0] == room)
            else:
                bin_ = [opened(length), []]
                bins.append(bin_)
            bin_[0] -= length
            bin_[1].append(length)
    return [b[1] for b in bins]


def cost(contents, sizes):
    return sum(min(s.cost for s in sizes if s.capacity >= sum(c)) for c in contents)


def expand(plan):
    """Bin -> [(offset, length)] by the runs, one piece at a time."""
    out = collections.defaultdict(list)
    for r in plan.runs:
        for k in range(r.pieces):
            out[r.bin + k // r.per_bin].append((r.offset + k % r.per_bin * r.length, r.length))
    return out


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 9), max_size=12))
def test_runs_are_best_fit_piece_by_piece(counts):
    rules = [None, 8, 16, 32]
    plans = [packing._place(counts, list(SIZES), p) for p in rules]
    for plan, preferred in zip(plans, rules):
        bins = expand(plan)
        assert sum(r.pieces for r in plan.runs) == sum(counts.values())
        capacity = {start + k: c for start, n, c in plan.bins for k in range(n)}
        assert sorted(capacity) == sorted(bins) == list(range(len(bins)))
        for b, pieces in bins.items():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert capacity[b] == min(s.capacity for s in SIZES if s.capacity >= at)
        want = plain(counts, SIZES, preferred)
        assert sorted(sorted(x for _, x in v) for v in bins.values()) == sorted(sorted(c) for c in want)
        assert plan.cost == pytest.approx(cost(want, SIZES))
    assert packing.plan_packing(counts, SIZES).cost == min(p.cost for p in plans)


def test_a_piece_must_fit():
    with pytest.raises(ValueError):
        packing.plan_packing({40: 1}, SIZES)


def test_every_token_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"d{i}t{k}" for k in range(rng.choice([0, 1, 3, 7, 20, 31, 32, 70])))) for i in range(60)]
    rows += [(100, None), (101, "a" * 1000), (102, " \n ")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, capacity int")
    packed = packing.pack(df, sizes=SIZES)
    out = packed.collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_bin[(r["sequence"], r["capacity"])].append((r["offset"], r["length"]))
    for key, text in rows:
        at = 0
        for start, length in sorted(by_doc[key]):
            assert start == at
            at += length
        assert at == len((text or "").split()) + 1
    assert len({s for s, _ in by_bin}) == len(by_bin)
    for (_, capacity), pieces in by_bin.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    text = {r["sequence"]: r["text"] for r in packing.sequences(packed, df).collect()}
    tokens = collections.Counter(t for x in text.values() for t in x.split(" "))
    assert tokens["<|end|>"] == len(rows)
    assert all(tokens[t] == 1 for _, x in rows for t in (x or "").split())


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b")] * 3 + [(1, "a b")] * 3, "doc_id long, text string")
    out = packing.pack(df, sizes=SIZES).collect()
    places = {(r["sequence"], r["offset"]) for r in out}
    assert len(out) == len(places) == 6 and {r["length"] for r in out} == {3}


def test_given_token_counts_and_empty(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, n int")
    out = packing.pack(df, sizes=SIZES, tokens=F.col("n")).collect()
    assert sorted((r["doc_id"], r["length"]) for r in out) == [(1, 11), (2, 21)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
