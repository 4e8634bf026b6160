"""Near duplicates by SimHash fingerprints, linked through BK-trees.

Fingerprint: ASCII-lower-cased words (runs of other than space and 0x09-0x0D),
shingles of k words joined by a space with repeats, XXH64 with seed 42; a bit
is 1 if it is set in more than half of the hashes.  Fewer than k words make one
shingle of the whole sequence, no words make fingerprint zero.

Links: one tree over all fingerprints would follow most of its edges, since
unrelated fingerprints lie about 32 bits apart with little spread.  So the 64
bits are cut into ``radius + 2`` blocks (more for very many fingerprints).  Two
fingerprints at most ``radius`` bits apart agree on all but ``radius`` whole
blocks, therefore every choice of so many blocks is a shard key, and any link
has both ends in at least one common shard, exactly.
Each shard gets a BK-tree: children are keyed by their integer distance to
their parent, and a search follows only edges within ``radius`` of the
distance of the query to the node.  Trees are sent to their queries by the
shuffle on the shard key instead of a broadcast, because they grow with the data.

A shard of more than ``tree_size`` fingerprints is cut into sub-shards, and
each pair of sub-shards is searched in a task of its own, so no group outgrows
``tree_size`` * 2 rows.  A tree returns only links that join two parts not yet
joined in its shard (at most one fewer than its points): no group emits all its
pairs, and the connected components are the same.

Exact copies meet in one fingerprint before any search.

Defined cases: null and empty texts have fingerprint zero and link like any
other; repeated rows and ties are members of one class; an empty table gives no
rows; a class in which all ids are null has a null class id, else nulls don't
count; columns named like the results are replaced by them.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import if_small, stage, whole_row
from tessera.llm.components import connected_components

SEED = 42
TREE_SIZE = 2048
#: Unrelated fingerprints in a shard from which on one more block is used.
FULL = 64


def fingerprint(text: str | None, k: int) -> int:
    """SimHash of one text as an unsigned 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())),
                         np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = hashes[i:i + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def add_fingerprint(df: DataFrame, text_col: str, name: str, k: int) -> DataFrame:
    """``df`` with the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64))
    return df.withColumn(name, simhash(F.col(text_col)))


class BKTree:
    """Burkhard-Keller tree over 64-bit fingerprints under Hamming distance."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.children: list[list[tuple[int, int]]] = [[] for _ in points]  # (distance, child)
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            group = todo.pop()
            node, rest = group[0], group[1:]
            away = np.bitwise_count(points[rest] ^ points[node])
            for d in np.unique(away).tolist():
                under = rest[away == d]
                self.children[node].append((d, int(under[0])))
                todo.append(under)

    def joins(self, radius: int) -> list[tuple[int, int]]:
        """Links within ``radius`` that join two parts not joined before, by index.

        All points search the tree together: a node meets the queries that
        reach it, later points only, since earlier ones have met it from there.
        """
        part = np.arange(len(self.points))
        out: list[tuple[int, int]] = []
        todo = [(0, part[1:])] if len(part) > 1 else []
        while todo:
            node, queries = todo.pop()
            queries = queries[queries > node]
            if not len(queries):
                continue
            away = np.bitwise_count(self.points[queries] ^ self.points[node]).astype(np.int16)
            near = queries[away <= radius]
            near = near[part[near] != part[node]]
            while len(near):
                other = int(near[0])
                out.append((int(node), other))
                part[part == part[other]] = part[node]
                near = near[part[near] != part[node]]
            for d, child in self.children[node]:
                follow = queries[np.abs(away - d) <= radius]
                if len(follow):
                    todo.append((child, follow))
        return out


def _block_masks(radius: int, blocks: int) -> list[int]:
    """64-bit masks, as signed longs, of every choice of the blocks that must agree."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _blocks_for(prints: int, radius: int) -> int:
    """Fewest blocks (from radius + 2 on) whose keys tell unrelated fingerprints apart, about
    ``FULL`` in a shard; any number finds every link."""
    blocks = radius + 2
    while prints >> (64 * (blocks - radius) // blocks) > FULL:
        blocks += 1
    return blocks


def hamming_links(prints: DataFrame, radius: int, tree_size: int = TREE_SIZE,
                  blocks: int | None = None) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``prints(fp)``, read twice.

    They connect exactly what all pairs at most ``radius`` bits apart connect,
    for any number of ``blocks`` above ``radius`` (default: by their count).
    """
    blocks = blocks or _blocks_for(prints.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m)))
                     for i, m in enumerate(_block_masks(radius, blocks))])
    keyed = prints.select("fp", F.explode(keys).alias("key"))
    shared = (keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
                   .select("key", F.ceil(F.col("n") / tree_size).cast("int").alias("subs")))
    own = F.pmod(F.xxhash64("fp", F.lit("sub")), F.col("subs")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("subs") - 1),
                        lambda s: F.struct(F.least(s, F.col("own")).alias("i"),
                                           F.greatest(s, F.col("own")).alias("j")))
    groups = (keyed.join(shared, "key").withColumn("own", own)
                   .select("key", "fp", F.explode(pairs).alias("p"))
                   .groupBy("key", "p.i", "p.j").agg(F.collect_list("fp").alias("fps"))
                   .filter(F.size("fps") > 1).select("fps"))

    def search(batches):
        for batch in batches:
            a, b = [], []
            for fps in batch["fps"]:
                fps = np.sort(np.asarray(fps, np.int64))
                for i, j in BKTree(fps.view(np.uint64)).joins(radius):
                    a.append(fps[i])
                    b.append(fps[j])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return groups.mapInPandas(search, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    radius: int = 4, carry: list[str] | None = None) -> DataFrame:
    """Per row: the columns of ``carry`` (default: the id), ``fingerprint`` (16 hex
    digits), ``component_id`` (smallest id of its class) and ``row_id``, plus
    ``keep``, true for one row of each class, the first by id (nulls last).
    """
    carry = [id_col] if carry is None else carry
    rows = stage(add_fingerprint(df.select(
        whole_row(df.select(*[F.col(f"`{c}`") for c in carry])).alias("_row"),
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
        F.monotonically_increasing_id().alias("_rid")), "_text", "fp", k).drop("_text"), "simhash")
    first = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_rid"))
    prints = stage(rows.groupBy("fp").agg(F.min("_id").alias("id"), first.alias("first")), "prints")
    roots = stage(connected_components(hamming_links(prints.select("fp"), radius)), "roots")
    rooted = (prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")))
    # staged, so that the join has a plain shuffle on both sides, whose skew can be split
    classes = stage(rooted.groupBy("root").agg(F.min("id").alias("id"), F.min("first").alias("first")),
                    "classes")
    by_print = rooted.select("fp", "root").join(classes, "root").select("fp", "id", "first._rid")
    kept = [c for c in carry if c not in ("fingerprint", "component_id", "row_id", "keep")]
    return (rows.join(by_print.withColumnRenamed("_rid", "_first"), "fp")
                .select(*[F.col(f"_row.`{c}`").alias(c) for c in kept],
                        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("id").alias("component_id"), F.col("_rid").alias("row_id"),
                        (F.col("_rid") == F.col("_first")).alias("keep")))


def keep_one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                       radius: int = 4) -> DataFrame:
    """``df`` without near duplicates: one row of each class stays, columns as given."""
    rows = stage(df.select(whole_row(df).alias("_row"),
                           F.monotonically_increasing_id().alias("_n")), "dedup-input")
    found = near_duplicates(rows.select("_n", F.col(f"_row.`{id_col}`").alias("_doc"),
                                        F.col(f"_row.`{text_col}`").alias("_body")),
                            "_doc", "_body", k, radius, carry=["_n"])
    dropped = stage(found.filter(~F.col("keep")).select("_n"), "dedup-drop")
    return (rows.join(if_small(dropped, 16 * dropped.count()), "_n", "left_anti")
                .select("_row.*"))
