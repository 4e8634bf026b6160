"""Near duplicates by the Jaccard similarity of word shingles, searched in count-vector R-trees.

A document's set holds its distinct shingles of ``k`` words (ASCII-lower-cased
runs of other than space and 0x09-0x0D, joined by a space); fewer words make
one shingle of all, no words the empty set, which links with nothing.  Two
documents link when their sets' intersection is at least ``similarity`` percent
of their union.

Method: the shingles of a set are hashed into ``GROUPS`` groups, and the counts
per group are a point.  Two sets share at most the sum of the smaller counts,
so an R-tree over the points, each node with the largest count per group and
the range of sizes below it, gives an upper bound for a whole subtree; only
pairs that pass it down to the leaves are verified on the sets.

Scale: a tree over all documents would be one task.  Sets are therefore dealt
to shards by shared shingles: in any one order of all shingles, two sets that
link have a common one among their first n - ceil(similarity * n) + 1, so every
link has both ends in some shard, whatever the order.  The order puts the most
frequent of these shingles last (counted by Spark over all documents, at most
``FREQUENT`` of them are listed), so passages that many documents share make no
shards.  Equal sets meet in one digest, and shards with the same members are
searched once.

Shards are searched twice.  First their trees hold only the points (a byte per
group; finer ones for large sets) and tell which sets have a partner that passes the bound; nearly all
documents leave here.  The shards of the rest that hang together by common
members become one (up to ``MERGED`` members), their sets are made anew from the
texts, and the trees verify pairs, but return only links that join two parts not
yet joined in their shard, so no group emits all its pairs.  A shard of more than
``TREE`` sets or ``TREE_BYTES`` is cut into sub-shards, and each pair of them is
searched in a task of its own.

A shingle is known by 64 bits of a polynomial hash over its bytes, each byte a
random 64-bit number, so sets and counts are those of the shingles' texts but
for collisions (about n * n / 2**65 in a text of n words).

Defined cases: null and empty texts have no shingles and are a class of their
own with their id; repeated rows and equal texts are one class; a class whose
ids are all null has a null id, else nulls don't count; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import if_small, in_bitmap, key_bitmap, stage, to_batch
from tessera.llm.components import connected_components

GROUP_BITS = 8
GROUPS = 1 << GROUP_BITS
TREE, TREE_BYTES, FAN, MERGED = 1024, 32 << 20, 16, 1 << 13
#: A shingle in the prefixes of more sets than this is frequent; at most so many are listed.
OFTEN, FREQUENT = 16, 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.Generator(np.random.PCG64(42)).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of a text's word shingles."""

    def __init__(self, k: int):
        self.k, self.up, self.down = k, _powers(_BASE, 1), _powers(_BASE, 1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        joined = b" ".join(words)
        if len(joined) >= len(self.up):
            n = max(2 * len(joined), 1 << 16)
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        first = (ends - sizes)[:max(1, len(words) - self.k + 1)]
        last = ends[self.k - 1:] if len(words) >= self.k else ends[-1:]
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(joined, np.uint8)] * self.up[:len(joined)], out=sums[1:])
        return np.unique(mixed((sums[last] - sums[first]) * self.down[first]))


def shortest_overlap(n, similarity: int):
    """Fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-similarity * n // 100)


def linked(shared: int, n: int, m: int, similarity: int) -> bool:
    return 100 * shared >= similarity * (n + m - shared)


def group_counts(hashes: np.ndarray, bits: int = GROUP_BITS) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def point_bits(n: int) -> int:
    """Bits of a group's number in the stored point of ``n`` shingles: at most eight to a group, as
    many groups less tell large sets apart.  Trees have ``GROUPS``, the sums of these."""
    bits = GROUP_BITS
    while n > 8 << bits:
        bits += 2
    return bits


class RTree:
    """Tree over count vectors; a node has the largest counts and the sizes below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes
        order = (np.lexsort((*counts.T[:4], counts.argmax(axis=1), sizes)) if len(sizes) > FAN
                 else np.arange(len(sizes)))
        self.leaves = [order[i:i + FAN] for i in range(0, len(order), FAN)]
        level = [(counts[x].max(axis=0), sizes[x].min(), sizes[x].max()) for x in self.leaves]
        self.levels = []  # from the leaves up: boxes, least sizes, largest sizes
        while level:
            self.levels.append(tuple(np.array(x) for x in zip(*level)))
            if len(level) == 1:
                break
            groups = [range(i, min(i + FAN, len(level))) for i in range(0, len(level), FAN)]
            level = [(np.max([level[j][0] for j in g], axis=0), min(level[j][1] for j in g),
                      max(level[j][2] for j in g)) for g in groups]

    def near(self, point: np.ndarray, n: int, similarity: int) -> np.ndarray:
        """Points that may share enough with a set of ``n`` shingles and these counts."""
        def passing(boxes, least, most):
            bound = np.minimum(boxes, point).sum(axis=1)
            needed = -(-similarity * (n + np.maximum(least, shortest_overlap(n, similarity)))
                       // (100 + similarity))
            return (bound >= needed) & (most >= shortest_overlap(n, similarity)) \
                & (shortest_overlap(least, similarity) <= n)
        if len(self.leaves) == 1:
            return self.leaves[0][passing(self.counts, self.sizes, self.sizes)]
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            boxes, least, most = (x[nodes] for x in self.levels[depth])
            nodes = nodes[passing(boxes, least, most)]
            if not len(nodes):
                return nodes
            if depth:
                below = len(self.levels[depth - 1][0])
                nodes = np.concatenate([np.arange(FAN * i, min(FAN * i + FAN, below)) for i in nodes])
        points = np.concatenate([self.leaves[i] for i in nodes])
        return points[passing(self.counts[points], self.sizes[points], self.sizes[points])]


def pack(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as hold the largest."""
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def unpack(point: bytes, n: int) -> np.ndarray:
    return np.frombuffer(point, f"u{len(point) >> point_bits(n)}").astype(np.int32)


def folded(point: np.ndarray, groups: int) -> np.ndarray:
    return point if len(point) == groups else point.reshape(groups, -1).sum(axis=1)


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int, similarity: int) -> bool:
    """Whether the points of two sets of ``n`` and ``m`` allow a link, in the groups both have."""
    groups = min(len(a), len(b))
    return np.minimum(folded(a, groups), folded(b, groups)).sum() * (100 + similarity) >= similarity * (n + m)


def with_partner(points: list[np.ndarray], sizes: np.ndarray, similarity: int) -> np.ndarray:
    """Which points have another one within the bound."""
    counts = np.array([folded(p, GROUPS) for p in points])
    tree, found = RTree(counts, sizes), np.zeros(len(sizes), bool)
    for i in range(len(sizes)):
        if found[i]:
            continue
        for j in tree.near(counts[i], int(sizes[i]), similarity).tolist():
            if j != i and may_link(points[i], int(sizes[i]), points[j], int(sizes[j]), similarity):
                found[i] = found[j] = True
                break
    return found


def joining_links(sets: list[np.ndarray], similarity: int) -> list[tuple[int, int]]:
    """Links among ``sets`` (sorted hashes) that join two parts not joined before, by index."""
    sizes = np.array([len(s) for s in sets])
    counts = np.array([group_counts(s) for s in sets])
    tree = RTree(counts, sizes)
    part = np.arange(len(sets))
    out = []
    for i, own in enumerate(sets):
        if (part[i:] == part[i]).all():
            continue
        near = tree.near(counts[i], int(sizes[i]), similarity)
        near = near[(near > i) & (part[near] != part[i])]
        while len(near):
            j, near = int(near[0]), near[1:]
            shared = len(np.intersect1d(own, sets[j], assume_unique=True))
            if linked(shared, len(own), len(sets[j]), similarity):
                out.append((i, j))
                part[part == part[j]] = part[i]
                near = near[part[near] != part[i]]
    return out


def _prefixes(docs: DataFrame, k: int, similarity: int, frequent: np.ndarray) -> DataFrame:
    """Per document ``id``, ``n``, ``set`` (digest, null if empty) and ``keys``, the first of its
    shingles: those not in ``frequent`` by hash, then the frequent ones, the rarest first."""
    listed = np.sort(frequent)
    place = np.argsort(frequent)
    known = docs.sparkSession.sparkContext.broadcast((listed, place))
    kind = docs.schema["id"].dataType.simpleString()

    def first_keys(batches):
        shingles = Shingler(k)
        listed, place = known.value
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                n.append(len(found))
                digests.append(hashlib.md5(found.tobytes()).digest() if len(found) else None)
                size = len(found) - shortest_overlap(len(found), similarity) + 1 if len(found) else 0
                if len(listed) and len(found):
                    at = np.minimum(np.searchsorted(listed, found), len(listed) - 1)
                    often = listed[at] == found
                    found = np.concatenate([found[~often][:size],
                                            found[often][np.argsort(place[at[often]])]])
                keys.append(found[:size].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "set", "keys"])

    return docs.mapInArrow(first_keys, f"id {kind}, n long, set binary, keys array<long>")


def _frequent(rows: DataFrame, often: int, listed: int) -> np.ndarray:
    """The most frequent keys, at most ``listed``, the rarest of them first."""
    counts = (rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
                  .filter(F.col("n") > often))
    top = counts.orderBy(F.desc("n"), "key").limit(listed).toPandas()
    return top["key"].to_numpy(np.int64).view(np.uint64)[::-1]


def _shared(rows: DataFrame) -> DataFrame:
    """(key, set, n), each once, of the keys that several rows have and, by the bitmap, few more."""
    once = rows.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1")
    several = stage(once.select("key"), "jaccard-shared")
    known = rows.sparkSession.sparkContext.broadcast(key_bitmap(several, several.count()))

    def keep(batches):
        for batch in batches:
            keys = batch.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(keys)), keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            kept = in_bitmap(flat.view(np.uint64), *known.value)
            row = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[kept]), batch.column("set").take(row), batch.column("n").take(row)],
                names=["key", "set", "n"])

    return (rows.select("set", "n", "keys").mapInArrow(keep, "key long, set binary, n long").distinct())


def _sets(docs: DataFrame, sets: DataFrame, k: int, what: str) -> DataFrame:
    """``set``, ``n`` and ``what`` of ``sets(set, id)`` as bytes: "point" or "hashes".

    A bitmap of the ids picks the texts, so that none is shuffled; what it lets
    through besides is dropped by the digest.
    """
    point = what == "point"
    wanted = sets.select(F.xxhash64("id").alias("key"))
    known = docs.sparkSession.sparkContext.broadcast(key_bitmap(wanted, wanted.count()))

    def make(batches):
        shingles = Shingler(k)
        for batch in batches:
            ids = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            texts = batch.column("text").filter(pa.array(in_bitmap(ids, *known.value)))
            found = [f for f in (shingles(t.as_py()) for t in texts) if len(f)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.md5(f.tobytes()).digest() for f in found], pa.binary()),
                 pa.array([len(f) for f in found], pa.int64()),
                 pa.array([pack(group_counts(f, point_bits(len(f)))) if point else f.tobytes()
                           for f in found], pa.binary())],
                names=["set", "n", "what"])

    made = (docs.select(F.xxhash64("id").alias("key"), "text")
                .mapInArrow(make, "set binary, n long, what binary"))
    return (made.join(sets.select("set"), "set", "left_semi")
                .groupBy("set").agg(F.first("n").alias("n"), F.first("what").alias(what)))


def _shards(pairs: DataFrame, tree: int, tree_bytes: int, bytes_each: Column) -> DataFrame:
    """``pairs(key, set, n)`` in shards to search, with their number of sub-shards: those of more
    than one member, but none with the same members as another."""
    members = pairs.groupBy("key").agg(
        F.count("*").alias("m"), F.sum(bytes_each).alias("size"),
        F.bit_xor(F.xxhash64("set")).alias("a"), F.bit_xor(F.xxhash64("set", F.lit("b"))).alias("b"))
    subs = F.ceil(F.greatest(F.col("m") / tree, F.col("size") / tree_bytes)).cast("int")
    shards = stage(members.filter("m > 1").groupBy("m", "size", "a", "b").agg(F.min("key").alias("key"))
                          .select("key", subs.alias("subs")), "jaccard-shards")
    return stage(pairs.join(if_small(shards, 16 * shards.count()), "key").select("key", "subs", "set"),
                 "jaccard-members")


def _groups(members: DataFrame, sets: DataFrame, what: str) -> DataFrame:
    """The sub-shards and pairs of sub-shards of ``members``: key and a list of (set, n, what)."""
    own = F.pmod(F.xxhash64("set", F.lit("sub")), F.col("subs")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("subs") - 1),
                        lambda s: F.struct(F.least(s, F.col("own")).alias("i"),
                                           F.greatest(s, F.col("own")).alias("j")))
    return (members.withColumn("own", own).select("key", "set", F.explode(pairs).alias("p"))
                   .join(sets, "set")
                   .groupBy("key", "p.i", "p.j")
                   .agg(F.collect_list(F.struct("set", "n", what)).alias("members"))
                   .select("key", "members"))


def _partnered(members: DataFrame, points: DataFrame, similarity: int) -> DataFrame:
    """The (key, set, n) of ``members`` that have a partner within the bound in their shard."""
    def search(batches):
        for batch in batches:
            out = []
            for key, members in zip(batch.column("key").to_pylist(), batch.column("members")):
                members = members.as_py()
                found = with_partner([unpack(m["point"], m["n"]) for m in members],
                                     np.array([m["n"] for m in members]), similarity)
                out += [(key, m["set"], m["n"]) for m, f in zip(members, found) if f]
            yield to_batch(out, [("key", pa.int64()), ("set", pa.binary()), ("n", pa.int64())])

    return _groups(members, points, "point").mapInArrow(search, "key long, set binary, n long").distinct()


def _merged(pairs: DataFrame, largest: int) -> DataFrame:
    """``pairs(key, set, n)`` with one key for all shards that hang together, so that a set is in one
    shard only; those of more than ``largest`` sets together stay apart."""
    heads = pairs.groupBy("key").agg(F.min("set").alias("a"))
    joined = pairs.join(heads, "key").select("a", F.col("set").alias("b"))
    roots = stage(connected_components(joined).withColumnRenamed("node", "set"), "jaccard-hang")
    sizes = stage(roots.groupBy("root").agg(F.count("*").alias("m")), "jaccard-sizes")
    rooted = pairs.join(roots, "set").join(sizes, "root")
    return rooted.select(F.when(F.col("m") > largest, F.col("key")).otherwise(F.xxhash64("root")).alias("key"),
                         "set", "n").distinct()


def _links(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) of set digests that connect what all links of the shards connect."""
    def search(batches):
        for batch in batches:
            out = []
            for members in batch.column("members"):
                members = sorted((m["set"], m["hashes"]) for m in members.as_py())
                links = joining_links([np.frombuffer(h, np.uint64) for _, h in members], similarity)
                out += [(members[i][0], members[j][0]) for i, j in links]
            yield to_batch(out, [("a", pa.binary()), ("b", pa.binary())])

    return _groups(members, sets, "hashes").mapInArrow(search, "a binary, b binary").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    similarity: int = 80, rounds: int = 1, tree: int = TREE,
                    tree_bytes: int = TREE_BYTES, often: int = OFTEN,
                    frequent: int = FREQUENT, merged: int = MERGED) -> DataFrame:
    """Per row ``id_col``, ``n_shingles`` and ``component_id``, the smallest id of its class.

    ``rounds`` passes count frequent shingles; any number, and any ``often``,
    ``frequent`` and ``merged``, gives the same classes.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    order = np.empty(0, np.uint64)
    for _ in range(rounds):
        more = _frequent(_prefixes(docs, k, similarity, order), often, frequent)
        order = np.concatenate([more[~np.isin(more, order)], order])[-frequent:]
    rows = stage(_prefixes(docs, k, similarity, order), "jaccard-prefix")
    first = stage(rows.filter("set IS NOT NULL").groupBy("set").agg(F.min("id").alias("id")), "jaccard-first")

    members = _shards(stage(_shared(rows), "jaccard-pairs"), tree, tree_bytes, GROUPS + F.col("n"))
    some = stage(members.select("set").distinct().join(first, "set"), "jaccard-some")
    points = stage(_sets(docs, some, k, "point"), "jaccard-points")
    pairs = stage(_partnered(members, points, similarity), "jaccard-partners")

    members = _shards(stage(_merged(pairs, merged), "jaccard-merged"), tree, tree_bytes, 8 * F.col("n"))
    some = stage(members.select("set").distinct().join(first, "set"), "jaccard-some")
    sets = stage(_sets(docs, some, k, "hashes"), "jaccard-sets")
    roots = stage(connected_components(_links(members, sets, similarity)), "jaccard-roots")

    rooted = first.join(roots.withColumnRenamed("node", "set"), "set", "left")
    classes = stage(rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component")),
                    "jaccard-classes")
    by_set = stage(rooted.join(classes, "root", "left")
                         .select("set", F.when(F.col("root").isNull(), F.col("id"))
                                         .otherwise(F.col("component")).alias("component")), "jaccard-ids")
    return (rows.select("id", "n", "set").join(by_set, "set", "left")
                .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.when(F.col("set").isNull(), F.col("id")).otherwise(F.col("component"))
                         .alias("component_id")))
