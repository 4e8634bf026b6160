import itertools
import math
import random
import re

import pytest

from tessera.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(400)]


def plain(text, items):
    """Items with a window of 13 words (the whole item if shorter) that agrees in enough of them."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    out = set()
    for key, item in items:
        t = re.findall(r"[^\W_]+", (item or "").lower())
        n = min(13, len(t))
        need = math.ceil(0.8 * n) if len(t) >= 13 else n
        if n and any(sum(w[i + k] == t[j + k] for k in range(n)) >= need
                     for i in range(len(w) - n + 1) for j in range(len(t) - n + 1)):
            out.add(key)
    return out


def test_masks_meet_every_two_substitutions():
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in dc.MASKS]
    for gone in itertools.combinations(range(dc.WINDOW), 2):
        assert any(all(o + k not in gone for k in at)
                   for at in ones for o in range(dc.WINDOW - at[-1])), gone


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(WORDS, k=n))) for i, n in enumerate([3, 8, 12, 13, 20, 60, 35, 1])]
    items += [(99, None), (98, ""), (97, "!!! ...")]
    docs = []
    for i in range(120):
        words = rng.choices(WORDS, k=rng.choice([0, 5, 40, 200]))
        if i % 2:
            part = rng.choice(items[:7])[1].split()
            a = rng.randrange(len(part))
            part = part[a:a + rng.choice([9, 13, 16, 60])]
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(WORDS)
            words[rng.randrange(len(words) + 1):0] = [x.upper() + rng.choice(["", ",", "***"]) for x in part]
        docs.append((i, " ".join(words)))
    return items, docs + [(500, None), (501, ""), (None, items[4][1])]


@pytest.mark.parametrize("block_words", [40, 2_000_000])
def test_matches_brute_force(spark, corpus, block_words):
    items, docs = corpus
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    found = dc.find_overlaps(df, bench, block_words=block_words).collect()
    want = {(key, item) for key, text in docs for item in plain(text, items)}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want
    assert len({k for k, _ in want}) >= 20
    texts = dict(docs)
    for r in found:
        words = dc.words_of(texts[r["doc_id"]][r["start"]:r["end"]])
        assert len(words) == r["end_word"] - r["first_word"] and 0.6 <= r["similarity"] <= 1
    clean = dc.remove_contaminated(df, bench, block_words=block_words)
    assert clean.schema == df.schema
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, t in docs if not plain(t, items))


@pytest.mark.parametrize("n", range(8, 13))
def test_short_items_with_substitutions(n):
    """All placings of the allowed substitutions are found, one more is not."""
    item = WORDS[:n]
    index = dc.SeedIndex([(1, " ".join(item))], short_words=dc.SHORT_WORDS)
    allowed = n - math.ceil(0.8 * n)
    for k in range(allowed + 2):
        for gone in itertools.combinations(range(n), k):
            text = ["before", *("other" if i in gone else w for i, w in enumerate(item)), "behind"]
            hits = index.overlaps(" ".join(text))
            assert [(h[0], h[3]) for h in hits] == ([(1, n - k)] if k <= allowed else []), gone


def test_registered_options_for_short_items(spark, tmp_path):
    import corpus_pipeline
    from tessera.llm import queries
    spark.createDataFrame([(1, " ".join(WORDS[:12])), (2, "of the")], "item_id long, text string"
                          ).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join(["x", *WORDS[:5], "other", *WORDS[6:12], "y"])), (2, "one of the texts"),
                                  (3, "neither")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_decontaminate(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["item_id"], r["equal_words"]) for r in found} == {(1, 1, 11), (2, 2, 2)}
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3]


def test_lower_case_keeps_offsets():
    assert len(dc.lower_keep("İstanbul ẞ Ä")) == len("İstanbul ẞ Ä")
    index = dc.SeedIndex([(1, " ".join(WORDS[:20]))])
    text = "İ İ. " + " ".join(WORDS[:20])
    (hit,) = index.overlaps(text)
    assert text[hit[-2]:hit[-1]] == " ".join(WORDS[:20])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, " ".join(WORDS[:30]))] * 2, "doc_id long, text string")
    assert dc.find_overlaps(some, none).collect() == []
    assert dc.remove_contaminated(some, none).count() == 2
    bench = spark.createDataFrame([(1, " ".join(WORDS[:30]))] * 2, "item_id long, text string")
    assert dc.find_overlaps(some.limit(0), bench).collect() == []
    assert dc.find_overlaps(some, bench).count() == 2


def test_very_long_text():
    index = dc.SeedIndex([(1, " ".join(WORDS[:20]))])
    text = "filler " * 200_000 + " ".join(WORDS[:20]) + " filler" * 10
    (hit,) = index.overlaps(text)
    assert hit[:4] == (1, 200_000, 200_020, 20)


def test_ids_of_any_type(spark):
    text = " ".join(WORDS[:30])
    docs = spark.createDataFrame([("a", text), ("b", "nothing"), (None, text)], "doc_id string, text string")
    bench = spark.createDataFrame([("x-1", text), ("x-2", " ".join(WORDS[50:70]))], "item_id string, text string")
    found = dc.find_overlaps(docs, bench)
    assert dict(found.dtypes)["doc_id"] == dict(found.dtypes)["item_id"] == "string"
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {("a", "x-1"), (None, "x-1")}
    assert [r["doc_id"] for r in dc.remove_contaminated(docs, bench).collect()] == ["b"]
