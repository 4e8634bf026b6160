"""Spelling variants by reduced-alphabet generation.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point.  Letters are hashed to a few symbols, so a word has a reduced form
over a small alphabet.  Near words have reduced forms that are equal or one edit
apart, therefore the full one-edit neighbourhood of every reduced form, over the
small alphabet only, is generated and joined with the reduced vocabulary, and
the words behind the two forms are verified as they are written.  A pair of
forms is in each other's neighbourhoods; the form of smaller hash keeps it.

Scale: texts are read once; tasks count words before the shuffle, in a table of
at most ``HELD`` words each.  From there on the work grows with the vocabulary.
Forms are 64-bit hashes; the alphabet grows with the seventh root of the number
of words (the shortest have seven letters), which keeps the words of a form
few at any size, and any alphabet finds every pair.  Most neighbours are no
word's form: a bitmap of the reduced vocabulary, of at most 16 MB, drops nearly
all of those before the join shuffles the rest.  A hash that two forms share
only brings pairs that the verification drops.

A word's form is its near word of largest count (ties: the first in code-point
order), if that count is at least ``ratio`` times its own.  Counts grow by the
ratio with every step, so chains of forms are short; they are followed by
doubling until nothing changes.

Defined cases: null and empty texts have no words; a null id counts as an empty
one in the damage; repeated rows count each time; very long texts and words are
whole; an empty table or vocabulary gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_bitmap, key_bitmap, stage

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
DAMAGE = 31
HELD = 200_000
#: Letters of the forms whose neighbourhoods are generated at a time: bounds a task's memory.
AT_ONCE = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def damaged(word: str, doc_id) -> str:
    """``word`` without one letter where crc32 of ``doc_id:word`` says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all damaged words of at least ``letters`` letters seen ``least`` times."""
    # a word loses at most one letter and gains none, so shorter runs never count
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{max(1, letters)},}}")

    def count(batches):
        held: Counter = Counter()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()),
                                               pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                doc_id, text = doc_id.as_py(), text.as_py()
                if not text:
                    continue
                # only A-Z are lower-cased
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    word = damaged(word, doc_id)
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    return (df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
              .mapInArrow(count, "word string, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def reduced(words: list[str], symbols: int) -> list[np.ndarray]:
    """Per word its symbols, from 1 on: a hash of each letter."""
    out = []
    for w in words:
        points = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64)
        out.append(((points * np.uint64(2654435761) >> np.uint64(13)) % np.uint64(symbols)) + np.uint64(1))
    return out


def _by_length(forms: list[np.ndarray]):
    lengths = np.array([len(f) for f in forms])
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield at, np.stack([forms[i] for i in at])


def codes(forms: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of each form: its symbols as digits of an odd base, modulo 2**64."""
    out = np.zeros(len(forms), np.uint64)
    for at, block in _by_length(forms):
        powers = np.multiply.accumulate(np.full(block.shape[1], _BASE, np.uint64))
        out[at] = (block * powers).sum(axis=1, dtype=np.uint64)
    return out


def neighbourhoods(forms: list[np.ndarray], symbols: int):
    """Pieces (index, codes) of the forms one edit away: all deletions, replacements, insertions."""
    for at, block in _by_length(forms):
        powers = np.multiply.accumulate(np.full(block.shape[1] + 1, _BASE, np.uint64))
        digits = block * powers[:-1]
        start = np.zeros((len(block), 1), np.uint64)
        before = np.concatenate([start, digits.cumsum(axis=1, dtype=np.uint64)], axis=1)
        whole = before[:, -1:]
        moved = block[:, 1:] * powers[:-2]           # the letters behind the first, one place earlier
        ahead = np.concatenate([start, moved.cumsum(axis=1, dtype=np.uint64)], axis=1)
        pieces = [before[:, :-1] + ahead[:, -1:] - ahead]
        after = (whole - before) * _BASE             # the letters from a place on, one place later
        for s in range(1, symbols + 1):
            digit = np.uint64(s) * powers
            pieces += [whole - digits + digit[:-1], before + digit + after]
            for codes_ in pieces:
                yield np.repeat(at, codes_.shape[1]), codes_.ravel()
            pieces = []


def alphabet(words: int) -> int:
    """Symbols for a vocabulary: about one word a form among the shortest words."""
    return max(4, int(np.ceil(max(words, 1) ** (1 / LEAST_LETTERS))))


def _add_code(vocabulary: DataFrame, symbols: int) -> DataFrame:
    def add(batches):
        for batch in batches:
            own = codes(reduced(batch.column("word").to_pylist(), symbols)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["word", "n", "code"])
    return vocabulary.select("word", "n").mapInArrow(add, "word string, n long, code long")


def _neighbours(forms: DataFrame, symbols: int) -> DataFrame:
    """(code, near) of every form and each larger code in its one-edit neighbourhood that may be a
    form's, by a bitmap of the forms."""
    known = forms.sparkSession.sparkContext.broadcast(
        key_bitmap(forms.select(F.col("code").alias("key")), forms.count()))

    def generate(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            letters = np.cumsum([len(w) for w in words]) // AT_ONCE
            for chunk in np.unique(letters):
                own = reduced([words[i] for i in np.flatnonzero(letters == chunk)], symbols)
                code = codes(own).view(np.int64)
                for index, near in neighbourhoods(own, symbols):
                    kept = in_bitmap(near, *known.value) & (near.view(np.int64) > code[index])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code[index[kept]]), pa.array(near[kept].view(np.int64))],
                        names=["code", "near"])
    return forms.select("word").mapInArrow(generate, "code long, near long")


def near_words(vocabulary: DataFrame, symbols: int | None = None) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words one edit apart, once; ``vocabulary(word, n)`` is stored."""
    symbols = symbols or alphabet(vocabulary.count())
    coded = stage(_add_code(vocabulary, symbols), "spelling-codes")
    # the words of one code have one reduced form (or, rarely, collide: those get all their forms)
    forms = stage(coded.groupBy("code").agg(F.min("word").alias("word")), "spelling-forms")
    known = forms.select(F.col("code").alias("near"))
    pairs = stage(_neighbours(forms, symbols).join(known, "near").distinct(), "spelling-pairs")
    one = coded.select("code", F.col("word").alias("a"), F.col("n").alias("n_a"))
    two = coded.select(F.col("code").alias("near"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    apart = pairs.join(one, "code").join(two, "near")
    same = (one.join(two.withColumnRenamed("near", "code"), "code").filter("a < b"))
    columns = ["a", "n_a", "b", "n_b"]
    return (apart.select(*columns).unionByName(same.select(*columns))
                 .filter(F.levenshtein("a", "b", 1) == 1))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of each chain in ``forms(word, form)``."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        at = stage(at, "spelling-roots")
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = at.join(further, "root", "left")
        if not joined.filter("next IS NOT NULL").limit(1).count():
            return at
        at = joined.select("word", F.coalesce("next", "root").alias("root"))


def group_variants(vocabulary: DataFrame, ratio: int = RATIO, symbols: int | None = None) -> DataFrame:
    """Per word of ``vocabulary(word, n)`` its ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    vocabulary = stage(vocabulary.select("word", "n"), "spelling-words")
    pairs = stage(near_words(vocabulary, symbols), "spelling-near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"),
                                          F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    near = stage(both.groupBy(F.col("a").alias("word"))
                     .agg(F.count("*").alias("n_near"),
                          F.min(F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("form"))).alias("best")),
                 "spelling-best")
    rows = (vocabulary.join(near, "word", "left")
                      .withColumn("form_n", -F.col("best.m"))
                      .withColumn("formed", F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False)))
                      .select("word", F.when(F.col("formed"), F.col("best.form")).alias("form"), "n",
                              F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              F.when(F.col("formed"), F.col("form_n")).alias("form_n")))
    rows = stage(rows, "spelling-rows")
    roots = _roots(rows.filter("form IS NOT NULL"))
    return (rows.join(roots, "word", "left")
                .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
