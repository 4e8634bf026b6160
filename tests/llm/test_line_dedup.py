import random
import re

import pytest

from tessera.llm import line_dedup as ld

WORDS = [f"w{i}" for i in range(300)]


def sentence(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + rng.choice([".", "!", "?", "..."])


def plain(rows, kind="sentence"):
    """(id, start, end, keep id) of every removed passage, unit by unit."""
    seen, out = {}, []
    for _, (key, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        passage, gap = [], 0

        def close():
            if sum(p[2] for p in passage) >= ld.MIN_WORDS:
                keeps = [p[3] for p in passage if p[3] is not None]
                out.append((key, passage[0][0], passage[-1][1], min(keeps, default=None)))
            passage.clear()

        cut = {"sentence": r"[^.!?\n]*[.!?]*\n?", "line": r"[^\n]*\n?"}[kind]
        for m in re.finditer(cut, text or ""):
            words = m[0].lower().split()
            if len(words) < ld.UNIT_WORDS:
                gap += len(words)
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            norm = " ".join(words)
            if gap > ld.GAP_WORDS:
                close()
            gap = 0
            if norm in seen:
                passage.append((start, start + len(m[0].strip()), len(words), seen[norm]))
            else:
                seen[norm] = key
                close()
        close()
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    shared = [" ".join(sentence(rng, rng.choice([6, 12, 20])) for _ in range(5)) for _ in range(6)]
    stock = [sentence(rng, 7) for _ in range(3)]
    out = []
    for i in range(150):
        parts = [sentence(rng, rng.choice([1, 2, 3, 9, 15])) for _ in range(rng.randrange(8))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared).upper() if i % 2 else rng.choice(shared))
        if i % 4 == 0:
            parts.insert(0, rng.choice(stock))
        out.append((rng.choice([i, i, i, None, 7]), "".join(p + rng.choice([" ", "\n", "\n\n", "  "]) for p in parts)))
    return out + [(1, None), (2, ""), (3, " \n\n "), (4, "É. " * 50), (9000, "\n".join(shared))] + [out[0]] * 3


@pytest.mark.parametrize("kind", ["sentence", "line"])
def test_matches_brute_force(spark, rows, kind):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").coalesce(1)
    got = [(r["doc_id"], r["start"], r["end"], r["keep_id"]) for r in ld.find_repeats(df, kind=kind).collect()]
    want = plain(rows, kind)
    assert sorted(got, key=repr) == want and len(want) > 20


def test_spliced_and_aligned_passages_are_cut(spark):
    rng = random.Random(1)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    own = [sentence(rng, 30) for _ in range(4)]
    rows = [(1, f"{own[0]} {passage}"), (2, f"{own[1]} {passage}\ntail of it"), (3, f"head\n{passage}\n{own[2]}"),
            (4, own[3]), (5, None)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, _n string")
    for r in ld.find_repeats(df).collect():
        assert dict(rows)[r["doc_id"]][r["start"]:r["end"]] == passage and r["copies"] == 3 and r["keep_id"] == 1
    out = ld.remove_repeats(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {
        1: rows[0][1], 2: f"{own[1]} \ntail of it", 3: f"head\n{own[2]}", 4: own[3], 5: None}


def test_stock_phrases_stay(spark):
    stock = "All of the words of this heading are shared."
    df = spark.createDataFrame([(i, f"{stock}\nOnly number {i} says that these are words of it.") for i in range(50)],
                               "doc_id long, text string")
    assert ld.find_repeats(df).count() == 0


def test_paragraphs(spark):
    text = "first line of a paragraph with words\nsecond line of the same paragraph here " + "and more words " * 6
    df = spark.createDataFrame([(1, f"{text}\n\nrest"), (2, f"x\n \n{text}")], "doc_id long, text string")
    got = ld.find_repeats(df, kind="paragraph").collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in got] == [(2, 4, 4 + len(text.strip()))]


def test_a_hot_passage_and_long_texts(spark):
    rng = random.Random(3)
    line = sentence(rng, 30)
    df = spark.createDataFrame([(i, f"{line}\nown words of number {i}") for i in range(3000)] +
                               [(9999, "\n".join([line] * 5000))], "doc_id long, text string").repartition(9)
    got = ld.find_repeats(df)
    assert got.count() == 2999 + 1
    assert [r["keep_id"] for r in got.select("keep_id").distinct().collect()] == [0]
    assert got.where("doc_id = 9999").first()["units"] == 5000


def test_long_passages_of_short_units(spark):
    """Lists, words with a stop behind each and unspaced lines are cut; chance repeats are not."""
    rng = random.Random(5)
    listed = "\n".join(f"{a} {b}" for a, b in zip(rng.sample(WORDS, 40), rng.sample(WORDS, 40)))
    stops = " ".join(f"{w}!!" for w in rng.sample(WORDS, 60))
    unspaced = "\n".join("".join(rng.choices("天地玄黄宇宙洪荒日月盈昃", k=12)) for _ in range(40))
    shuffled = " ".join(f"{w}!!" for w in rng.sample(WORDS, 60))
    every = " ".join(f"{w}!!" for w in rng.sample(WORDS, 300))
    own = [sentence(rng, 30) for _ in range(2)]
    shared = "\n".join([listed, stops, unspaced])
    rows = [(0, every), (1, f"{own[0]}\n{shared}"), (2, f"{own[1]}\n{shared}"), (3, shuffled)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.remove_repeats(df).collect()}
    assert got == {0: every, 1: rows[1][1], 2: f"{own[1]}\n", 3: shuffled}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ld.find_repeats(df).collect() == [] and ld.remove_repeats(df).collect() == []


def test_ids_of_any_type(spark):
    text = " ".join(WORDS[:40]) + "."
    df = spark.createDataFrame([("b", text), ("a", text), ("c", "other words of one text.")],
                               "doc_id string, text string")
    for short_words in (0, ld.SHORT_WORDS):
        (found,) = ld.find_repeats(df, short_words=short_words).collect()
        assert (found["doc_id"], found["keep_id"], found["words"]) == ("b", "a", 40)
    left = {r["doc_id"]: r["text"] for r in ld.remove_repeats(df).collect()}
    assert left == {"a": text, "b": "", "c": "other words of one text."}
