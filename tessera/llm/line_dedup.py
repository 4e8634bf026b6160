"""Substring dedup by hashing lines or paragraphs.

A unit is a line, a paragraph (between blank lines), or by default a sentence:
a line cut at sentence ends, because a repeated passage is often spliced into a
line.  Units are normalised (lower-cased, runs of white space as one space) and
hashed to 128 bits.  Digests are grouped over the whole corpus; the occurrence
that ranks first (smallest id, nulls last, then row, then place) stays.

Neighbouring units of a text that are not first make one passage, and passages
of at least ``min_words`` words are removed; their offsets in the original
text come back.  The bound keeps headings and stock phrases, whose repetition
says little, and cutting which would damage clean texts.  Units of fewer than
``unit_words`` words repeat by chance: they are never hashed alone, and a passage
goes on over at most ``gap_words`` words of them.  With ``short_words``, they are
hashed together with their neighbours, in windows of at least so many words, and
a repeated window is a repeat of all its units: long passages of short units are
found, words that merely occur elsewhere are not.

A very common line is one key with many rows: its first occurrence is found by
an aggregation with partial results per task and staged, so the join that flags
the others is plain and adaptive execution can split it.

Defined cases: null and empty texts have no units; repeated rows are separate
rows, the later ones lose every long enough passage; ids keep their type and
rank in its order; an empty table gives no rows; extra columns are ignored (``remove_repeats`` returns them unchanged).
"""

from __future__ import annotations

import re
import struct
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stage, to_batch, whole_row

MIN_WORDS, UNIT_WORDS, GAP_WORDS = 25, 4, 6
#: Words of a window around a short unit.
SHORT_WORDS = 8
#: A window: its units (number, offsets, words, words and long units before it in the text).
COVERED = ("unit", "start", "end", "words", "before", "longs")
WINDOWS = [("row", pa.int64()), ("unit", pa.int32()),
           ("covers", pa.list_(pa.struct([(name, pa.int32()) for name in COVERED]))),
           ("h1", pa.int64()), ("h2", pa.int64())]
DIGESTS = [("row", pa.int64()), ("unit", pa.int32()), ("start", pa.int32()),
           ("end", pa.int32()), ("words", pa.int32()), ("gap", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())]
#: Units with what ends them; together they are the whole text.
_UNITS = {"line": re.compile(r"[^\n]*\n?"), "sentence": re.compile(r"[^.!?\n]*[.!?]*\n?"),
          "paragraph": re.compile(r"(?s:.+?)(?:\n[ \t\r]*\n\s*|\Z)")}


def units(text: str | None, kind: str, unit_words: int) -> list[tuple[int, int, list[str], int]]:
    """(start, end, words, words of the shorter units since the one before) of the units with
    enough words; offsets in code points, without white space around."""
    out, gap = [], 0
    for m in _UNITS[kind].finditer(text or ""):
        words = m[0].lower().split()
        if len(words) < max(1, unit_words):
            gap += len(words)
            continue
        start = m.end() - len(m[0].lstrip())
        out.append((start, start + len(m[0].strip()), words, gap))
        gap = 0
    return out


def _id_type(docs: DataFrame) -> str:
    return f"id {docs.schema['id'].dataType.simpleString()}"


def _digests(docs: DataFrame, kind: str, unit_words: int) -> DataFrame:
    def split(batches):
        for batch in batches:
            keys, numbers, texts = (batch.column(i).to_pylist() for i in (0, 1, 2))
            rows = []
            for key, row, text in zip(keys, numbers, texts):
                for i, (start, end, words, gap) in enumerate(units(text, kind, unit_words)):
                    whole = " ".join(words).encode("utf-8", "surrogatepass")
                    rows.append((key, row, i, start, end, len(words), gap,
                                 *struct.unpack("qq", blake2b(whole, digest_size=16).digest())))
            yield to_batch(rows, [("id", batch.column(0).type), *DIGESTS])

    return docs.mapInArrow(split, f"{_id_type(docs)}, row long, unit int, start int, end int, words int, "
                                  "gap int, h1 long, h2 long")


def windows(text: str | None, kind: str, unit_words: int, short_words: int):
    """(units, words) of each long unit by itself, and of each run of units that starts or ends
    with a short one and has just enough words; units as in ``COVERED``."""
    found = units(text, kind, 1)
    covered, before, longs = [], 0, 0
    for i, (start, end, words, _) in enumerate(found):
        covered.append((i, start, end, len(words), before, longs))
        before += len(words)
        longs += len(words) >= unit_words
    runs = set()
    for i, (_, _, words, _) in enumerate(found):
        if len(words) >= unit_words:
            runs.add((i, i + 1))
            continue
        first, n = i, len(words)
        while n < short_words and first:
            first -= 1
            n += len(found[first][2])
        if n >= short_words:
            runs.add((first, i + 1))
        last, n = i + 1, len(words)
        while n < short_words and last < len(found):
            n += len(found[last][2])
            last += 1
        if n >= short_words:
            runs.add((i, last))
    for first, last in sorted(runs):
        yield covered[first:last], [w for u in found[first:last] for w in u[2]]


def _window_digests(docs: DataFrame, kind: str, unit_words: int, short_words: int) -> DataFrame:
    def split(batches):
        for batch in batches:
            keys, numbers, texts = (batch.column(i).to_pylist() for i in (0, 1, 2))
            rows = []
            for key, row, text in zip(keys, numbers, texts):
                for covers, words in windows(text, kind, unit_words, short_words):
                    whole = " ".join(words).encode("utf-8", "surrogatepass")
                    rows.append((key, row, covers[0][0], [dict(zip(COVERED, u)) for u in covers],
                                 *struct.unpack("qq", blake2b(whole, digest_size=16).digest())))
            yield to_batch(rows, [("id", batch.column(0).type), *WINDOWS])

    one = ", ".join(f"{name}: int" for name in COVERED)
    return docs.mapInArrow(split, f"{_id_type(docs)}, row long, unit int, covers array<struct<{one}>>, h1 long, h2 long")


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 kind: str = "sentence", min_words: int = MIN_WORDS, unit_words: int = UNIT_WORDS,
                 gap_words: int = GAP_WORDS, row_col: str | None = None, short_words: int = 0) -> DataFrame:
    """One row per removed passage: id, ``row``, ``unit`` (number of its first unit), ``units``,
    ``start``, ``end``, ``words``, ``keep_id`` (smallest id that keeps a unit of it) and
    ``copies`` (of its most frequent unit).

    ``row_col`` names a unique row number; without it one is assigned.  ``short_words`` is the
    size of the windows around short units, which are then numbered, too; 0 leaves them out.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = df.select(F.col(id_col).alias("id"), row.alias("row"),
                     F.col(text_col).alias("text"))
    found = stage(_window_digests(docs, kind, unit_words, short_words) if short_words else
                  _digests(docs, kind, unit_words), "units")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "row", "unit")
    # staged, so that the join has a plain shuffle on both sides, whose skew can be split
    first = stage(found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("copies"))
                       .filter("copies > 1"), "repeated")
    later = (found.join(first, ["h1", "h2"])
                  .filter((F.col("row") != F.col("first.row")) | (F.col("unit") != F.col("first.unit"))))
    text = Window.partitionBy("row").orderBy("unit")
    breaks = (F.col("unit") - F.lag("unit", 1).over(text) > 1) | (F.col("gap") > gap_words)
    if short_words:
        later = (later.select("id", "row", F.inline("covers"), "first", "copies")
                      .groupBy("row", *COVERED)
                      .agg(F.min("id").alias("id"), F.min("first").alias("first"), F.max("copies").alias("copies")))
        breaks = ((F.col("longs") > F.lag(F.col("longs") + (F.col("words") >= unit_words).cast("int"), 1).over(text)) |
                  (F.col("before") - F.lag(F.col("before") + F.col("words"), 1).over(text) > gap_words))
    passage = F.sum(F.coalesce(breaks, F.lit(False)).cast("int")).over(text)
    return (later.withColumn("passage", passage)
                 .groupBy("row", "passage")
                 .agg(F.min("id").alias("id"), F.min("unit").alias("unit"), F.count("*").cast("int").alias("units"),
                      F.min("start").alias("start"), F.max("end").alias("end"),
                      F.sum("words").cast("int").alias("words"), F.min("first.id").alias("keep_id"),
                      F.max("copies").alias("copies"))
                 .filter(F.col("words") >= min_words)
                 .select(F.col("id").alias(id_col), "row", "unit", "units", "start", "end", "words",
                         "keep_id", "copies"))


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, cuts):
        if t is None or cuts is None or not len(cuts):
            return t
        kept, at = [], 0
        for start, end in sorted((c["start"], c["end"]) for c in cuts):
            kept.append(t[at:start])
            whole_line = (start == 0 or t[start - 1] == "\n") and t[end:end + 1] == "\n"
            at = end + whole_line
        return "".join([*kept, t[at:]])
    return pd.Series([one(t, c) for t, c in zip(text, spans)], dtype=object)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   kind: str = "sentence", min_words: int = MIN_WORDS,
                   short_words: int = SHORT_WORDS) -> DataFrame:
    """``df`` with repeated passages cut out of the text, the columns as given."""
    rows = stage(df.select(whole_row(df).alias("_row"),
                           F.monotonically_increasing_id().alias("_n")), "line-dedup")
    spans = (find_repeats(rows.select("_n", F.col(f"_row.`{id_col}`").alias("_id"),
                                      F.col(f"_row.`{text_col}`").alias("_text")),
                          "_id", "_text", kind, min_words, row_col="_n", short_words=short_words)
             .groupBy(F.col("row").alias("_n"))
             .agg(F.collect_list(F.struct("start", "end")).alias("_cuts")))
    text = _cut(F.col(f"_row.`{text_col}`"), F.col("_cuts")).alias(text_col)
    return rows.join(spans, "_n", "left").select(
        *[text if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
