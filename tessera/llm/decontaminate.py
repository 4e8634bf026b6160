"""Benchmark decontamination by spaced-seed hashing.

A mask slides over the words of a text and hashes the words at its 1s, so a
substituted word under a 0 leaves the hash as it was.  The fixed masks below
together meet every placing of two substitutions in ``WINDOW`` words.  Hashes
of the training texts are joined to those of the benchmark items; each hit
fixes a diagonal (place in the text minus place in the item), on which the
words are compared: an overlap is verified where a window of ``WINDOW`` words
agrees in at least ``SIMILARITY`` of them.  Neighbouring windows make one span.

Items of fewer words than the window have to occur whole and unchanged (their
mask is all 1s); items without a word never match.  With ``short_words``, items
from that many words on are compared over their own length in the same way: cut
into one piece more than substitutions are allowed, one piece is unchanged, and
its hash fixes the diagonal.  ``least_words`` leaves out items of a few common
words before they remove texts.

The benchmark is the stated query set: it is cut into blocks of a fixed number
of words, each block is sent to every task as a table, and all texts are run
against each block.  The texts are never shuffled.

Words are runs of letters and digits, lower-cased; offsets are code points.  Ids
of texts and items keep their types.

Defined cases: null and empty texts have no words and no overlap; null items
never match; repeated rows are each searched; empty tables give no overlaps;
extra columns are ignored (``remove_contaminated`` returns them unchanged).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import Shipped, to_batch

MASKS = ("11101011", "11001111")
WINDOW = 13
SIMILARITY = 0.8
BLOCK_WORDS = 2_000_000
#: As registered: from so many words on, short items may have substitutions, and items remove texts.
SHORT_WORDS, LEAST_WORDS = 8, 4

#: What is found of an overlap, behind the ids of text and item.
FOUND = [
    (name, pa.int32()) for name in ("first_word", "end_word", "equal_words", "item_first_word",
                                    "item_words", "start", "end")]

_WORD = re.compile(r"[^\W_]+")


def lower_keep(text: str) -> str:
    """Lower case with as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(
        c if len(c.lower()) != 1 else c.lower() for c in text)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lower_keep(text)) if isinstance(text, str) else []


class SeedIndex:
    """Words, masks and hashes of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]], masks=MASKS, window: int = WINDOW,
                 similarity: float = SIMILARITY, short_words: int | None = None, least_words: int = 1):
        self.window, self.similarity = window, similarity
        self.short_words = window if short_words is None else short_words
        words = [(item, words_of(text)) for item, text in items]
        words = [(item, w) for item, w in words if len(w) >= max(1, least_words)]
        vocabulary = sorted({x for _, w in words for x in w})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.codes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 1) | 1
                               for w in vocabulary], np.uint64)
        self.items = [item for item, _ in words]
        self.texts = [np.array([self.ids[x] for x in w], np.int32) for _, w in words]
        whole = sorted({len(t) for t in self.texts if len(t) < min(window, self.short_words)})
        self.tables = []  # (places of the 1s, sorted hashes, entry of each)
        pieces = {}  # words of a piece: the short items cut so
        for k, t in enumerate(self.texts):
            if self.short_words <= len(t) < window:
                pieces.setdefault(len(t) // (len(t) - self._need(len(t)) + 1), []).append(k)
        for size, cut in sorted(pieces.items()):
            at, hashes, entries = list(range(size)), [], []
            for k in cut:
                places, h = self._hash(self.texts[k], at)
                hashes.append(h[::size])
                entries += [(k, p) for p in places[::size].tolist()]
            h = np.concatenate(hashes)
            order = np.argsort(h, kind="stable")
            self.tables.append((at, h[order], np.array(entries, np.int64)[order]))
        for mask in [*masks, *["1" * n for n in whole]]:
            at = [i for i, c in enumerate(mask) if c == "1"]
            exact = len(at) == len(mask)
            hashes, entries = [], []
            for k, t in enumerate(self.texts):
                if exact and len(t) != len(mask) or not exact and len(t) < window:
                    continue
                places, h = self._hash(t, at)
                hashes.append(h)
                entries += [(k, p) for p in places.tolist()]
            if entries:
                h = np.concatenate(hashes)
                order = np.argsort(h, kind="stable")
                self.tables.append((at, h[order], np.array(entries, np.int64)[order]))

    def _need(self, n: int) -> int:
        """Equal words that verify a window of n words."""
        return math.ceil(self.similarity * n - 1e-9)

    def _hash(self, ids: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places whose words under the 1s are all known, and their hashes."""
        n = len(ids) - at[-1]
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        known = np.ones(n, bool)
        for o in at:
            known &= ids[o:o + n] >= 0
        places = np.flatnonzero(known)
        h = np.zeros(len(places), np.uint64)
        for o in at:
            h = (h ^ self.codes[ids[places + o]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return places, h

    def diagonals(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, place in the text minus place in the item) of all hash hits."""
        out = set()
        for at, table, entries in self.tables:
            places, h = self._hash(ids, at)
            low, high = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            for i in np.flatnonzero(high > low).tolist():
                out.update((k, int(places[i]) - p) for k, p in entries[low[i]:high[i]].tolist())
        return out

    def verify(self, ids: np.ndarray, item: int, shift: int) -> list[tuple[int, int, int, int]]:
        """(first word, end word, equal words, first word of the item) of the verified spans."""
        t = self.texts[item]
        a, b = max(0, shift), min(len(ids), shift + len(t))
        size = min(self.window, len(t))
        if b - a < size:
            return []
        equal = ids[a:b] == t[a - shift:b - shift]
        need = self._need(size) if len(t) >= min(self.window, self.short_words) else size
        total = np.concatenate([[0], np.cumsum(equal)])
        good = np.flatnonzero(total[size:] - total[:-size] >= need)
        spans = []
        for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1) if len(good) else []:
            hit = np.flatnonzero(equal[run[0]:run[-1] + size]) + run[0]
            first, end = int(hit[0]), int(hit[-1]) + 1
            spans.append((a + first, a + end, int(total[end] - total[first]), a + first - shift))
        return spans

    def overlaps(self, text: str | None) -> list[tuple[int, int, int, int, int, int, int, int]]:
        """(item id, first word, end word, equal words, first word of the item, item words,
        start, end) of the verified overlaps of a text, in that order."""
        words = words_of(text)
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        found = sorted({(self.items[k], *span, len(self.texts[k]))
                        for k, shift in self.diagonals(ids) for span in self.verify(ids, k, shift)})
        if not found:
            return []
        at = [m.span() for m in _WORD.finditer(lower_keep(text))]
        return [(*x, at[x[1]][0], at[x[2] - 1][1]) for x in found]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, **index):
    """The benchmark as indexes of about ``block_words`` words each, by a hash of the item."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")
                             ).filter("text is not null and id is not null").distinct()
    words = items.agg(F.sum(F.length("text") / 6)).first()[0] or 0
    n = max(1, math.ceil(words / block_words))
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        yield SeedIndex(sorted((r["id"], r["text"]) for r in rows), **index)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  block_words: int = BLOCK_WORDS, short_words: int | None = None) -> DataFrame:
    """One row per text, item and verified span: id, item id, ``first_word``, ``end_word``,
    ``equal_words``, ``item_first_word``, ``item_words``, ``start``, ``end``, ``similarity``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("item", item_type),
                           *[T.StructField(name, T.IntegerType()) for name, _ in FOUND]])
    item_kind = to_arrow_type(item_type)
    out = None
    for index in blocks(benchmark, item_col, item_text, block_words, short_words=short_words):
        sent = Shipped(docs.sparkSession, index)

        def search(batches, sent=sent):
            for batch in batches:
                keys, texts = (batch.column(i).to_pylist() for i in (0, 1))
                kinds = [("id", batch.column(0).type), ("item", item_kind), *FOUND]
                yield to_batch([(key, *x) for key, text in zip(keys, texts)
                                for x in sent.get().overlaps(text)], kinds)

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    same = F.col("equal_words") / (F.col("end_word") - F.col("first_word"))
    return (out.withColumn("similarity", same)
               .withColumnsRenamed({"id": id_col, "item": item_col}))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                        item_col: str = "item_id", item_text: str = "text",
                        block_words: int = BLOCK_WORDS, short_words: int | None = None,
                        least_words: int = 1) -> DataFrame:
    """``docs`` without the rows that hold a verified overlap, columns as given."""
    for index in blocks(benchmark, item_col, item_text, block_words, short_words=short_words,
                        least_words=least_words):
        sent = Shipped(docs.sparkSession, index)

        def clean(batches, sent=sent):
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not sent.get().overlaps(t) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
