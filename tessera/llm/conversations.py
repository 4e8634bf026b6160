"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows done, state of the role pattern ``(s?(ua)+)?``);
an edge keeps, reroles or deletes the next row or inserts an empty one.  Two
heaps, one from the first node and one from the goals, settle nodes in order of
(cost, rows done, audit); a path is complete where an edge leads from a node
settled forward to one settled in reverse.  The search ends only when the two
heap tops together cost more than the best crossing, so that all equal-cost
crossings are finished, and the least concatenated audit among them is taken.
The audit (edits' initials in order) fixes its path, and no cheapest audit to a
node is the start of another one, so least parts make a least whole.

Scale: rows are sorted by (conversation, turn, role, text, row) over range
partitions and cut into blocks of at most ``BLOCK`` rows or ``BLOCK_BYTES``.
Nearly all conversations are one block and are solved in it.  A conversation
over several blocks is solved block by block in parallel: each block gives the
cost from every state to every state and the rank of its audits, a chain over
these records of fixed size (one per block) picks the states at the borders,
and the blocks are then searched again between them.  Inserts at a border
belong to the later block, which keeps the order of audits exact.  Repeats
across blocks are found by grouping 128-bit digests.  Only the SHA-256 of such
a conversation reads its blocks one after the other, since a digest has no
parallel form; it holds one block at a time, and the audit it returns.

Defined cases: rows of equal turn (nulls first) are taken by role, then text, in
code-point order; a null role or text counts as one space; a null id is a
conversation of its own; roles are told by their first letter, and any other
letter or an empty role fits nowhere, so the row is reroled or deleted; repeated
rows are duplicates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions, stage, to_batch

BLOCK, BLOCK_BYTES = 512, 4 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FINE, IS_BLANK, IS_DUPLICATE, IS_TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing yet, after the system row, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
#: The state that a kept row's initial leads to.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER,
        (USER, "a"): ASSISTANT}
#: The state that a reroled or inserted row leads to, and the states before each.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {s: [t for t in STATES if NEXT[t] == s] for s in STATES}
KEPT_BEFORE = {s: [(t, i) for (t, i), to in KEPT.items() if to == s] for s in STATES}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that finish a conversation whose last row leaves it in a state.
TAIL = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def cheapest(rows: list[tuple[str, int]], start: int, goals: tuple, tail: bool = True):
    """(cost, audit) of the cheapest, then least, way through ``rows`` (one or more) of (initial, mark).

    From state ``start`` to one of the states ``goals``; None where there is none.
    ``tail`` allows inserts behind the last row.
    """
    n = len(rows)
    settled: tuple[dict, dict] = ({}, {})
    heaps: tuple[list, list] = ([(0, 0, "", start)], [(0, 0, "", g) for g in goals])
    best: list = []

    def ahead(i, s):
        if i < n:
            initial, mark = rows[i]
            yield "D", DELETE, i + 1, s
            if mark in (FINE, IS_TRUNCATED):
                more = TRUNCATED * (mark == IS_TRUNCATED)
                if (s, initial) in KEPT:
                    yield "K", KEEP + more, i + 1, KEPT[s, initial]
                yield "R", REROLE + more, i + 1, NEXT[s]
        if i < n or tail:
            yield "I", INSERT, i, NEXT[s]

    def behind(i, s):
        if i:
            initial, mark = rows[i - 1]
            yield "D", DELETE, i - 1, s
            if mark in (FINE, IS_TRUNCATED):
                more = TRUNCATED * (mark == IS_TRUNCATED)
                for t, needed in KEPT_BEFORE[s]:
                    if needed == initial:
                        yield "K", KEEP + more, i - 1, t
                for t in BEFORE[s]:
                    yield "R", REROLE + more, i - 1, t
        if i < n or tail:
            for t in BEFORE[s]:
                yield "I", INSERT, i, t

    def crossing(cost, audit):
        if not best or (cost, audit) < best[0]:
            best[:] = [(cost, audit)]

    while heaps[0] and heaps[1] and (not best or heaps[0][0][0] + heaps[1][0][0] <= best[0][0]):
        side = int(len(settled[1]) < len(goals) or heaps[1][0][0] < heaps[0][0][0])  # the goals first
        cost, done, audit, s = heapq.heappop(heaps[side])
        i = n - done if side else done
        if (i, s) in settled[side]:
            continue
        settled[side][i, s] = cost, audit
        if (i, s) in settled[1 - side]:
            other = settled[1 - side][i, s]
            crossing(cost + other[0], other[1] + audit if side else audit + other[1])
        for letter, price, j, t in (behind if side else ahead)(i, s):
            longer = letter + audit if side else audit + letter
            if (j, t) in settled[1 - side]:
                other = settled[1 - side][j, t]
                crossing(cost + price + other[0], other[1] + longer if side else longer + other[1])
            if (j, t) not in settled[side]:
                heapq.heappush(heaps[side], (cost + price, n - j if side else j, longer, t))
    return best[0] if best else None


def apply_audit(audit: str, state: int, roles: list, texts: list) -> list[tuple[str, str]]:
    """The (role, text) rows that an audit makes of a block, starting in ``state``."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            out.append((roles[i], texts[i]))
            state = KEPT[state, roles[i][:1]]
        elif edit != "D":
            state = NEXT[state]
            out.append((ROLE[state], "" if edit == "I" else texts[i]))
        i += edit != "I"
    return out


def mark_row(text: str) -> int:
    text = text.rstrip(SPACE)
    return IS_BLANK if not text else FINE if text[-1] in ".!?" else IS_TRUNCATED


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _cut(rows: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Blocks of rows that stand together, in order; (part, seq) places a block."""
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "part", "seq", "whole", "turn_first", "turn_last", "turns", "roles", "texts",
             "marks", "digests"]
    types = [None, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(),
             pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary())]

    def cut(batches):
        part, seq, run, out, held = TaskContext.get().partitionId(), 0, 0, [], 0
        conv, now, size, first_of_run, columns = None, [], 0, True, None

        def close(last: bool, end: bool):
            """``last``: the conversation ends here; ``end``: so does the partition."""
            nonlocal seq, now, size, first_of_run
            turns = [t for t, _, _ in now if t is not None]
            whole = last and not end and first_of_run and run > 0
            marks, digests, seen = [], [], set()
            for _, role, text in now:
                mark, digest = mark_row(text), None
                if mark != IS_BLANK:
                    digest = hashlib.md5(f"{conv}\0{role}\0{text}".encode()).digest()
                    if digest in seen:
                        mark, digest = IS_DUPLICATE, None
                    else:
                        seen.add(digest)
                marks.append(mark)
                digests.append(None if whole else digest)
            out.append((conv, part, seq, whole, turns[0] if turns else None,
                        turns[-1] if turns else None, len(set(turns)), [r for _, r, _ in now],
                        [t for _, _, t in now], marks, digests))
            seq, now, size, first_of_run = seq + 1, [], 0, False

        for batch in batches:
            columns = [(n, t or batch.schema.field("conv").type) for n, t in zip(names, types)]
            for c, turn, role, text in zip(*(col.to_pylist() for col in batch.columns)):
                if now and c != conv:
                    close(True, False)
                    run, first_of_run = run + 1, True
                elif len(now) >= block or size >= block_bytes:
                    close(False, False)
                conv = c
                now.append((turn, role, text))
                size += len(text) + 1
                held += len(text)
                if len(out) >= 256 or held >= 2 * block_bytes and out:
                    yield to_batch(out, columns)
                    out, held = [], 0
        if now:
            close(True, True)
        if out:
            yield to_batch(out, columns)

    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "rid"]
    parts = max(1, shuffle_partitions(rows))
    return (rows.withColumn("rid", F.monotonically_increasing_id())  # spreads a row repeated without end
                .repartitionByRange(parts, *order).sortWithinPartitions(*order)
                .select("conv", "turn", "role", "text")
                .mapInArrow(cut, f"conv {kind}, part int, seq int, whole boolean, turn_first long, "
                                 "turn_last long, turns long, roles array<string>, texts array<string>, "
                                 "marks array<int>, digests array<binary>"))


def _later_repeats(blocks: DataFrame) -> DataFrame:
    """(part, seq, later): rows of a block whose role and text an earlier block holds."""
    seen = (blocks.select("part", "seq", F.posexplode("digests").alias("at", "digest"))
                  .filter("digest IS NOT NULL"))
    first = stage(seen.groupBy("digest").agg(F.min(F.struct("part", "seq")).alias("first"),
                                             F.count("*").alias("n"))
                      .filter("n > 1").select("digest", "first"), "conv-first")
    return (seen.join(first, "digest").filter(F.struct("part", "seq") != F.col("first"))
                .groupBy("part", "seq").agg(F.collect_list("at").alias("later")))


def _marked(marks: list, later) -> list:
    marks = list(marks)
    for i in later if later is not None else ():
        marks[i] = IS_DUPLICATE
    return marks


def _gaps(first, last, distinct) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _tables(batches):
    """Per block its summary for the chain: counts, and cost and rank from state to state."""
    columns = [("part", pa.int32()), ("seq", pa.int32()), ("counts", pa.list_(pa.int64())),
               ("initials", pa.list_(pa.string())), ("costs", pa.list_(pa.int64())),
               ("ranks", pa.list_(pa.int32()))]
    for batch in batches:
        out = []
        for b in batch.to_pylist():
            marks, initials = _marked(b["marks"], b["later"]), [r[:1] for r in b["roles"]]
            rows, costs, ranks = list(zip(initials, marks)), [], []
            for s in STATES:
                found = [cheapest(rows, s, (e,), tail=False) for e in STATES]
                audits = sorted(x[1] for x in found if x)
                costs += [x[0] if x else -1 for x in found]
                ranks += [audits.index(x[1]) if x else -1 for x in found]
            counts = [marks.count(m) for m in (IS_BLANK, IS_DUPLICATE, IS_TRUNCATED)]
            out.append((b["part"], b["seq"], [*counts, illegal_pairs(initials)],
                        [initials[0], initials[-1]], costs, ranks))
        yield to_batch(out, columns)


def choose_borders(costs: list, ranks: list) -> tuple[int, list[int]]:
    """Cost and states at the borders (one more than blocks) of the cheapest, then least, way."""
    cost, order, back = {START: 0}, {START: 0}, []
    for c, r in zip(costs, ranks):
        found = {}
        for e in STATES:
            ways = [(cost[s] + c[4 * s + e], order[s], r[4 * s + e], s) for s in cost if c[4 * s + e] >= 0]
            if ways:
                found[e] = min(ways)
        back.append({e: w[3] for e, w in found.items()})
        cost = {e: w[0] for e, w in found.items()}
        placed = sorted(found, key=lambda e: found[e][1:3])
        order = {e: placed.index(e) for e in placed}
    total, _, state = min((cost[e] + INSERT * len(TAIL[e]), order[e], e) for e in cost)
    states = [state]
    for step in reversed(back):
        states.append(step[states[-1]])
    return total, states[::-1]


def _chain(blocks: pd.DataFrame) -> pd.DataFrame:
    """The states at the borders of one conversation's blocks, and its counts."""
    b = blocks.sort_values(["part", "seq"], ignore_index=True)
    cost, states = choose_borders(list(b["costs"]), list(b["ranks"]))
    blank, duplicate, truncated, illegal = (int(x) for x in sum(b["counts"]))
    illegal += sum(x[1] + y[0] not in ("su", "ua", "au")
                   for x, y in zip(b["initials"], b["initials"][1:]))
    dated = b[b["turn_first"].notna()]
    first, last = list(dated["turn_first"].astype("int64")), list(dated["turn_last"].astype("int64"))
    distinct = int(b["turns"].sum()) - sum(x == y for x, y in zip(last, first[1:]))
    gaps = _gaps(first[0], last[-1], distinct) if first else 0
    return pd.DataFrame({"part": b["part"], "seq": b["seq"], "entry": states[:-1], "exit": states[1:],
                         "final": b.index == len(b) - 1, "gaps": gaps, "blank": blank,
                         "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
                         "cost": cost})


def _pieces(blocks: DataFrame) -> DataFrame:
    """Per block its audit and repaired rows; the counts and cost are the conversation's."""
    kind = blocks.schema["conv"].dataType.simpleString()
    several = blocks.filter(~F.col("whole"))
    marked = (several.select("conv", "part", "seq", "turn_first", "turn_last", "turns", "roles", "marks")
                     .join(_later_repeats(several), ["part", "seq"], "left"))
    marked = stage(marked, "conv-marks")
    tables = (marked.select("part", "seq", "roles", "marks", "later")
                    .mapInArrow(_tables, "part int, seq int, counts array<long>, initials array<string>, "
                                         "costs array<long>, ranks array<int>"))
    counted = ", ".join(f"{c} long" for c in [*COUNTS, "cost"])
    borders = (tables.join(marked.select("conv", "part", "seq", "turn_first", "turn_last", "turns"),
                           ["part", "seq"])
                     .groupBy("conv").applyInPandas(_chain, "part int, seq int, entry int, exit int, "
                                                            f"final boolean, {counted}"))
    borders = stage(borders, "conv-borders")
    names = [*COUNTS, "cost"]

    def repair(batches):
        for batch in batches:
            columns = ([("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("seq", pa.int32()),
                        ("whole", pa.bool_()), ("audit", pa.string()), ("roles", pa.list_(pa.string())),
                        ("texts", pa.list_(pa.string()))] + [(c, pa.int64()) for c in names])
            out = []
            for b in batch.to_pylist():
                marks, initials = _marked(b["marks"], b["later"]), [r[:1] for r in b["roles"]]
                if b["whole"]:
                    cost, audit = cheapest(list(zip(initials, marks)), START, ENDS)
                    found = [_gaps(b["turn_first"], b["turn_last"], b["turns"]),
                             *(marks.count(m) for m in (IS_BLANK, IS_DUPLICATE, IS_TRUNCATED)),
                             illegal_pairs(initials), cost]
                else:
                    _, audit = cheapest(list(zip(initials, marks)), b["entry"], (b["exit"],), tail=False)
                    audit += TAIL[b["exit"]] if b["final"] else ""
                    found = [b[c] for c in names]
                turns = apply_audit(audit, START if b["whole"] else b["entry"], b["roles"], b["texts"])
                out.append((b["conv"], b["part"], b["seq"], b["whole"], audit,
                            [r for r, _ in turns], [t for _, t in turns], *found))
            yield to_batch(out, columns)

    need = ["conv", "part", "seq", "whole", "turn_first", "turn_last", "turns", "roles", "texts"]
    later = marked.select("part", "seq", "later")
    alone = blocks.filter("whole").select(*need, "marks", F.lit(None).cast("array<int>").alias("later"),
                                          *[F.lit(None).cast(t).alias(c) for c, t in
                                            [("entry", "int"), ("exit", "int"), ("final", "boolean"),
                                             *((c, "long") for c in names)]])
    split = (several.select(*need, "marks").join(later, ["part", "seq"]).join(borders, ["part", "seq"])
                    .select(*alone.columns))
    schema = (f"conv {kind}, part int, seq int, whole boolean, audit string, roles array<string>, "
              f"texts array<string>, {counted}")
    return alone.mapInArrow(repair, schema).unionByName(split.mapInArrow(repair, schema))


def _blocks(df: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str,
            block: int, block_bytes: int) -> DataFrame:
    space = F.lit(" ")
    rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.coalesce(F.col(role_col), space).alias("role"),
                     F.coalesce(F.col(text_col), space).alias("text"))
    return stage(_cut(rows, block, block_bytes), "conv-blocks")


def repaired_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                   role_col: str = "role", text_col: str = "text", block: int = BLOCK,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The repaired conversations: ``conv``, ``part``, ``seq`` and ``at``, which order its rows,
    and their ``role`` and ``text``."""
    pieces = _pieces(_blocks(df, id_col, turn_col, role_col, text_col, block, block_bytes))
    return (pieces.select("conv", "part", "seq", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "r"))
                  .select("conv", "part", "seq", "at", F.col("r.roles").alias("role"),
                          F.col("r.texts").alias("text")))


def repair(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation: ``conv``, the counts of its faults, the ``cost`` and ``audit`` of
    its repair, and ``repaired_sha256`` over the repaired ``role:text``, newline-joined."""
    names = [*COUNTS, "cost"]
    pieces = _pieces(_blocks(df, id_col, turn_col, role_col, text_col, block, block_bytes))
    kind = df.schema[id_col].dataType.simpleString()

    def digest(batches):
        key, sha, audit, row, any_row, columns = None, None, [], None, False, None

        def result():
            return (key, *row, "".join(audit), sha.hexdigest())

        for batch in batches:
            out = []
            columns = ([("conv", batch.schema.field("conv").type)] + [(c, pa.int64()) for c in names]
                       + [("audit", pa.string()), ("repaired_sha256", pa.string())])
            for b in batch.to_pylist():
                if row is None or b["conv"] != key:
                    if row is not None:
                        out.append(result())
                    key, sha, audit, any_row = b["conv"], hashlib.sha256(), [], False
                row = [b[c] for c in names]
                audit.append(b["audit"])
                for role, text in zip(b["roles"], b["texts"]):
                    sha.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
                    any_row = True
            yield to_batch(out, columns)
        if row is not None:
            yield to_batch([result()], columns)

    schema = (f"conv {kind}, " + ", ".join(f"{c} long" for c in names)
              + ", audit string, repaired_sha256 string")
    wanted = ["conv", "whole", *names, "audit", "roles", "texts"]
    alone = pieces.filter("whole").select(*wanted)
    split = (pieces.filter("NOT whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
                   .select(*wanted))
    return alone.mapInArrow(digest, schema).unionByName(split.mapInArrow(digest, schema))


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``df`` with faults chosen by crc32(``id:turn``) % 20 (nulls: one space): 0 drops the row, 1
    empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets the role user."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(known(id_col), F.lit(":"), known(turn_col))) % 20
    text = (F.when(fault == 1, "").when(fault == 2, F.translate(known(text_col), ".!?", ""))
             .otherwise(known(text_col)))
    return (df.select(id_col, turn_col, F.when(fault == 4, "user").otherwise(known(role_col)).alias(role_col),
                      text.alias(text_col), fault.alias("_fault"))
              .filter("_fault <> 0")
              .withColumn("_copy", F.explode(F.expr("sequence(1, if(_fault = 3, 2, 1))")))
              .drop("_fault", "_copy"))


def survey(df: DataFrame, repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``repaired`` for every id of ``df``: one without rows has zeros and an empty repair."""
    ids = df.select(F.col(id_col).alias("_id")).distinct()
    empty = hashlib.sha256(b"").hexdigest()
    return (ids.join(repaired, F.col("_id").eqNullSafe(F.col("conv")), "left")
               .select(F.col("_id").alias(id_col),
                       *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in [*COUNTS, "cost"]],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")))
