"""Variable-capacity best-fit packing of documents into sequences.

Several sequence lengths are permitted, each with a cost.  Pieces are placed
longest first into the open bin with the least room that still takes them; if
none does, a bin of the least-cost size is opened; in the end each bin shrinks
to the smallest permitted length that holds its contents.

Which opening rule is best depends on all lengths jointly, so a family of rules
is run (the size of least cost per token that the run of equal pieces fills,
and every single size as the preferred one) and the cheapest total after
shrinking is taken.

Only lengths matter for the plan, and lengths are at most the largest size:
the driver gets one count per length (a bounded table, whatever the corpus) and
places runs of equal pieces at once, which gives the same bins as piece by
piece.  The plan says, for every position in the order (longest first, then
by id), which bin and offset it has; the pieces themselves are numbered and
matched to it on the executors.

A document is its tokens and one end token.  Documents longer than the largest
size are cut into pieces of that size and a rest; every token is placed.

Defined cases: null and empty texts are one end token; null ids sort first;
repeated rows are packed one by one; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import number_rows, stage


class Size(NamedTuple):
    capacity: int
    cost: float


#: Powers of two; attention makes a long sequence dearer per token than a short one.
SIZES = tuple(Size(c, c * (1 + c / 16384)) for c in (512, 1024, 2048, 4096))


class Run(NamedTuple):
    """``pieces`` equal pieces from position ``first`` on: ``per_bin`` in each bin from
    ``bin`` on, the first of them at ``offset``."""

    first: int
    pieces: int
    length: int
    bin: int
    per_bin: int
    offset: int


class Plan(NamedTuple):
    runs: list[Run]
    #: (first bin, bins, capacity) after shrinking, gapless by first bin
    bins: list[tuple[int, int, int]]
    cost: float
    opening: str


def _smallest(sizes: list[Size], used: int) -> Size:
    return min((s for s in sizes if s.capacity >= used), key=lambda s: (s.cost, s.capacity))


def _opener(sizes: list[Size], preferred: int | None):
    """The size that is opened for pieces of a length."""
    def least_cost(length: int) -> int:
        fits = [s for s in sizes if s.capacity >= length]
        return min(fits, key=lambda s: (s.cost / (s.capacity // length * length), -s.capacity)).capacity

    return least_cost if preferred is None else (lambda length: max(preferred, _smallest(sizes, length).capacity))


def _place(counts: dict[int, int], sizes: list[Size], preferred: int | None) -> Plan:
    """Best fit by decreasing length over runs of equal pieces.

    ``room`` holds, by room left, the groups of bins (first bin, bins, used)
    that are alike.  A run fills a group whole, or splits it into the bins that
    are full of it, one bin with the rest, and those left as they are.
    """
    open_size = _opener(sizes, preferred)
    room: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []  # its keys, sorted
    runs: list[Run] = []
    first = bins = 0

    def put(left: int, group: tuple[int, int, int]) -> None:
        if left not in room:
            room[left] = []
            insort(rooms, left)
        heapq.heappush(room[left], group)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            tightest = bisect_left(rooms, length)
            if tightest == len(rooms):
                capacity = open_size(length)
                n = -(-todo // (capacity // length))
                put(capacity, (bins, n, 0))
                bins += n
                continue
            left = rooms[tightest]
            start, n, used = heapq.heappop(room[left])
            if not room[left]:
                del room[left], rooms[tightest]
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append(Run(first, full * each, length, start, each, used))
                put(left - each * length, (start, full, used + each * length))
                first, todo = first + full * each, todo - full * each
            if full < n and 0 < todo < each:
                runs.append(Run(first, todo, length, start + full, todo, used))
                put(left - todo * length, (start + full, 1, used + todo * length))
                first, todo, full = first + todo, 0, full + 1
            if full < n:
                put(left, (start + full, n - full, used))
    groups = sorted((start, n, _smallest(sizes, used)) for groups in room.values()
                    for start, n, used in groups)
    return Plan(runs, [(start, n, s.capacity) for start, n, s in groups],
                sum(n * s.cost for _, n, s in groups),
                "least cost" if preferred is None else f"prefer {preferred}")


def plan_packing(counts: dict[int, int], sizes=SIZES) -> Plan:
    """The cheapest plan of the opening rules for so many pieces of each length."""
    sizes = sorted(Size(*s) for s in sizes)
    if any(not 0 < length <= sizes[-1].capacity for length in counts):
        raise ValueError("a piece must be longer than 0 and fit the largest size")
    plans = [_place(counts, sizes, p) for p in (None, *[s.capacity for s in sizes])]
    return min(plans, key=lambda p: p.cost)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))


def pieces(df: DataFrame, id_col: str, tokens: Column, largest: int) -> DataFrame:
    """(id, piece, start, length): every document and its end token in pieces of at most ``largest``."""
    total = (tokens + 1).cast("long")
    return (df.select(F.col(id_col).alias("id"), total.alias("total"))
              .select("id", "total", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1,
                                                             F.lit(largest).cast("long"))).alias("piece", "start"))
              .select("id", "piece", "start",
                      F.least(F.lit(largest), F.col("total") - F.col("start")).cast("int").alias("length")))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=SIZES,
         tokens: Column | None = None) -> DataFrame:
    """One row per piece: id, ``piece``, ``start`` and ``length`` (tokens of the document,
    its end token last), ``sequence``, ``capacity`` and ``offset`` in the sequence.

    ``tokens`` is the token count of a row (default: words of the text).
    """
    tokens = word_count(F.col(text_col)) if tokens is None else tokens
    largest = max(s[0] for s in sizes)
    cut = stage(pieces(df, id_col, tokens, largest), "pieces")
    counts = {r["length"]: r["n"] for r in
              cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, sizes)
    ordered = number_rows(cut, [F.desc("length"), F.asc("id"), F.asc("piece"), F.asc("start")],
                          "_at", "packing")
    lookup = df.sparkSession.sparkContext.broadcast((
        np.array(plan.runs or [Run(0, 0, 1, 0, 1, 0)], np.int64),
        np.array(plan.bins or [(0, 0, 0)], np.int64)))

    @F.pandas_udf("sequence long, capacity int, offset int")
    def place(at: pd.Series) -> pd.DataFrame:
        runs, bins = lookup.value
        run = runs[np.searchsorted(runs[:, 0], at, side="right") - 1]
        rank = at.to_numpy() - run[:, 0]
        sequence = run[:, 3] + rank // run[:, 4]
        capacity = bins[np.searchsorted(bins[:, 0], sequence, side="right") - 1, 2]
        return pd.DataFrame({"sequence": sequence, "capacity": capacity.astype(np.int32),
                             "offset": (run[:, 5] + rank % run[:, 4] * run[:, 2]).astype(np.int32)})

    return (ordered.withColumn("_spot", place("_at"))
                   .select(F.col("id").alias(id_col), "piece", "start", "length", "_spot.sequence",
                           "_spot.capacity", "_spot.offset"))


def sequences(packed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              end: str = "<|end|>") -> DataFrame:
    """The packed texts: one row per sequence with its tokens in order, joined by a space.

    Ids must be unique.  A sequence holds at most its capacity of tokens, so no group grows.
    """
    words = F.split(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")), " ")
    words = F.array_append(F.filter(words, lambda w: w != ""), F.lit(end))
    return (packed.join(docs.select(F.col(id_col), words.alias("_words")), id_col)
                  .withColumn("_part", F.struct("offset", F.slice("_words", (F.col("start") + 1).cast("int"),
                                                                  F.col("length")).alias("w")))
                  .groupBy("sequence", "capacity")
                  .agg(F.array_sort(F.collect_list("_part")).alias("_parts"))
                  .select("sequence", "capacity",
                          F.array_join(F.flatten(F.col("_parts.w")), " ").alias("text")))
