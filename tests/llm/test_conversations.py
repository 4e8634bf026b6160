"""Conversation repair against every sequence of edits, and its blocks against one block."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations as cv
from tessera.llm import queries

PATTERN = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def all_repairs(rows, extra=4):
    """(cost, audit) of the best edits by trying all of them, with up to ``extra`` inserts."""
    best = None
    choices = []
    for role, text, mark in rows:
        own = [("D", 4, "")]
        if mark in (cv.FINE, cv.IS_TRUNCATED):
            more = 3 * (mark == cv.IS_TRUNCATED)
            own += [("K", more, role[:1] or "?"), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        choices.append(own)
    for picked in itertools.product(*choices):
        for n in range(extra + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for kinds in itertools.product("ua", repeat=n):
                    edits, at = [], 0
                    for i in range(len(rows) + 1):
                        while at < n and places[at] == i:
                            edits.append(("I", 3, kinds[at]))
                            at += 1
                        if i < len(rows):
                            edits.append(picked[i])
                    if PATTERN.fullmatch("".join(e[2] for e in edits)):
                        found = sum(e[1] for e in edits), "".join(e[0] for e in edits)
                        best = found if best is None else min(best, found)
    return best


def plain_dp(rows):
    """(cost, audit) by a table over rows and states, for longer conversations."""
    at = {cv.START: (0, "")}

    def inserted(at):
        at = dict(at)
        for _ in range(3):
            for s, (c, a) in list(at.items()):
                t = cv.NEXT[s]
                if t not in at or (c + 3, a + "I") < at[t]:
                    at[t] = (c + 3, a + "I")
        return at
    for initial, mark in rows:
        after = {}
        for s, (c, a) in inserted(at).items():
            steps = [(s, 4, "D")]
            if mark in (cv.FINE, cv.IS_TRUNCATED):
                more = 3 * (mark == cv.IS_TRUNCATED)
                steps += [(cv.NEXT[s], 3 + more, "R")]
                if (s, initial) in cv.KEPT:
                    steps += [(cv.KEPT[s, initial], more, "K")]
            for t, w, letter in steps:
                after[t] = min(after.get(t, (c + w, a + letter)), (c + w, a + letter))
        at = after
    at = inserted(at)
    return min(at[s] for s in cv.ENDS if s in at)


def expected(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of damaged rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks, seen = [], set()
        for _, _, role, text in own:
            core = text.rstrip(cv.SPACE)
            marks.append(cv.IS_BLANK if not core else cv.IS_DUPLICATE if (role, text) in seen
                         else cv.FINE if core[-1] in ".!?" else cv.IS_TRUNCATED)
            seen.add((role, text))
        initials = [r[2][:1] for r in own]
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit = plain_dp(list(zip(initials, marks)))
        repaired = cv.apply_audit(audit, cv.START, [r[2] for r in own], [r[3] for r in own])
        assert PATTERN.fullmatch("".join(r[:1] for r, _ in repaired))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(marks.count(m) for m in (1, 2, 3)),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        known = [" " if x is None else x for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{known[0]}:{known[1]}".encode()) % 20
        role, text = known[2:]
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def random_rows(rng, n):
    return [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_search_is_the_cheapest_and_least_of_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 3))
        assert cv.cheapest(rows, cv.START, cv.ENDS) == all_repairs([(i, "", m) for i, m in rows])
    for _ in range(400):
        rows = random_rows(rng, rng.randint(1, 30))
        assert cv.cheapest(rows, cv.START, cv.ENDS) == plain_dp(rows)


def test_blocks_chained_are_one_search():
    rng = random.Random(6)
    for _ in range(150):
        rows = random_rows(rng, rng.randint(2, 24))
        cuts = sorted({0, len(rows), *(rng.randint(1, len(rows)) for _ in range(3))})
        blocks = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        costs, ranks = [], []
        for b in blocks:
            costs.append([])
            ranks.append([])
            for s in cv.STATES:
                ways = [cv.cheapest(b, s, (e,), tail=False) for e in cv.STATES]
                order = sorted(w[1] for w in ways if w)
                costs[-1] += [w[0] if w else -1 for w in ways]
                ranks[-1] += [order.index(w[1]) if w else -1 for w in ways]
        cost, states = cv.choose_borders(costs, ranks)
        audit = "".join(cv.cheapest(b, s, (e,), tail=False)[1] for b, s, e in zip(blocks, states, states[1:]))
        assert (cost, audit + cv.TAIL[states[-1]]) == plain_dp(rows)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(7)
    words = ["Yes.", "No", "Why?", "", " \n", "So.", "a b", "Fine!  "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]),
             rng.choice([*words, None])) for c in [*range(60), None] for t in range(rng.randint(1, 8))]
    rows += [(7, None, "user", "Yes."), (7, None, "user", None), (None, None, None, None)] + rows[:20]
    return rows + [(1000, i // 3, rng.choice(["user", "assistant"]), rng.choice([*words, f"T {i}.", f"{i}"]))
                   for i in range(700)]


@pytest.mark.parametrize("block", [5, 64, 2000])
def test_repair_matches_a_plain_version(spark, conversations, block):
    rows = damaged(conversations)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(cv.repair(df, block=block)) == expected(rows)


def test_blocks_are_cut_by_bytes_too(spark, conversations):
    rows = damaged(conversations)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(cv.repair(df, block_bytes=40)) == expected(rows)


def test_damage_and_query(spark, conversations, tmp_path):
    df = spark.createDataFrame(conversations, SCHEMA).withColumn("rid", F.lit(1)).withColumn("conv", F.lit("x"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = spark.read.parquet(str(tmp_path / "conversations.parquet"))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, cv.damage(got).collect()), key=key) == sorted(damaged(conversations), key=key)
    want = expected(damaged(conversations))
    gone = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    want |= {c: gone for c in {r[0] for r in conversations} - set(want)}
    assert found(queries.op12_conversations(spark, str(tmp_path))) == want


def test_all_turns_dropped_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], SCHEMA)
    got = cv.survey(df, cv.repair(cv.damage(df))).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.repair(df.limit(0)).count() == 0


def test_text_ids_long_texts_and_clashing_columns(spark):
    rows = [("a", 1, "user", "x" * 3_000_000 + "."), ("a", 2, "assistant", "y " * 1_000_000), ("b", 5, "user", "Q?")]
    df = (spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
               .withColumn("part", F.lit(1)).withColumn("seq", F.lit("s")).withColumn("audit", F.lit(0)))
    assert found(cv.repair(df)) == expected(rows)


def test_repaired_turns_follow_the_pattern(spark, conversations):
    rows = damaged(conversations)
    turns = cv.repaired_turns(spark.createDataFrame(rows, SCHEMA), block=50).collect()
    for conv, want in expected(rows).items():
        own = sorted((r for r in turns if r["conv"] == conv), key=lambda r: (r["part"], r["seq"], r["at"]))
        assert PATTERN.fullmatch("".join(r["role"][:1] for r in own))
        text = "\n".join(f"{r['role']}:{r['text']}" for r in own)
        assert hashlib.sha256(text.encode()).hexdigest() == want[-1]
