import random
import re

import pytest

from tessera.llm import license_scan as ls

CASES = [
    None, "", "!!!", "cc by cc by", "CC-BY", "ccby", "General\nPublic -- License general public license", "ALL RIGHTS, reserved",
    "all rights all rights reserved", "K cc by", "Écc by", "cc bý", "general public", "by cc by",
    "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is licensed under the GNU General Public License, version 2.",
    "licensed by the", "released under the MIT license", "Released (by us) under the MIT License",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and its "
    "associated documentation files", "reserved rights all",
]


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in ls.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), sorted(places), sorted(labels)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id int, text string, label string, words int")
    return {r["doc_id"]: r for r in ls.scan(df).collect()}


def test_base_phrases(spark):
    for i, r in scan(spark, CASES).items():
        n, places, labels = plain(CASES[i])
        assert (r["n_words"], sorted(x for v in r["places"].values() for x in v), r["base_labels"]) == (n, places, labels), CASES[i]
        assert set(labels) <= set(r["labels"]) and 0 <= r["score"] <= 1


def test_templates(spark):
    by = {CASES[i]: r for i, r in scan(spark, CASES).items()}
    assert by[CASES[14]]["labels"] == ["cc-by", "cc-by-nc-4.0"]
    assert by[CASES[15]]["labels"] == ["apache-2.0"]
    assert by[CASES[16]]["labels"] == ["gpl", "gpl-3.0"] and by[CASES[17]]["labels"] == ["gpl", "gpl-2.0"]
    assert by[CASES[18]]["labels"] == []
    assert by[CASES[19]]["labels"] == ["mit"] and by[CASES[20]]["labels"] == ["mit"]
    assert by[CASES[21]]["labels"] == ["mit"] and 0.6 <= by[CASES[21]]["score"] < 1


def test_spans_point_at_the_words(spark):
    text = "some words before it. Licensed under the Apache License, Version 2.0 and after"
    (span,) = scan(spark, [text])[0]["spans"]
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    assert words[span["first"]:span["last"] + 1] == "licensed under the apache license version 2 0".split()


def test_copies_long_and_empty(spark):
    text = "Released under the MIT License. " + "filler " * 60_000
    out = scan(spark, [text] * 4 + ["all rights reserved " * 3000])
    assert all(out[i]["labels"] == ["mit"] and out[i]["n_words"] == 60_005 for i in range(4))
    assert len(out[4]["places"]["reserved"]) == 3000
    assert ls.scan(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_main_path_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    plan = ls.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_phrases_of_any_length_and_short_templates(spark):
    df = spark.createDataFrame([(1, "no warranty of any kind"), (2, "no warranty of any sort, no kind")],
                               "doc_id long, text string")
    phrases = [("no warranty of any kind", "five"), ("warranty", "one")]
    got = {r["doc_id"]: r["places"] for r in ls.scan(df, phrases=phrases).collect()}
    assert got == {1: {"five": [0], "one": [1]}, 2: {"five": [], "one": [1]}}
    for short in (ls.Template("x", "MIT-License"), ls.Template("x", "under the MIT License", "mit")):
        with pytest.raises(ValueError):
            ls.scan(df, templates=[short])
    with pytest.raises(ValueError):
        ls.scan(df, phrases=[(" ", "none")])


def chains(text_words, template_words, k):
    """Per lowest diagonal all rising chains of equal k-grams, written out one by one."""
    hits = [(a, p) for a in range(len(text_words) - k + 1) for p in range(len(template_words) - k + 1)
            if text_words[a:a + k] == template_words[p:p + k]]
    drift = max(1, int((1 - ls.COVERAGE) * len(template_words)))
    for low in sorted({a - p for a, p in hits}):
        near = [h for h in hits if low <= h[0] - h[1] <= low + drift]
        open_chains = [[h] for h in near]
        while open_chains:
            chain = open_chains.pop()
            yield low, chain
            (a, p) = chain[-1]
            open_chains += [[*chain, (b, q)] for b, q in near
                            if b > a and q > p and abs((b - a) - (q - p)) <= ls.SLACK]


def plain_spans(text, template, k=ls.K):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    w, t, key = cut(text), cut(template.text), cut(template.key)
    best = {}
    for low, chain in chains(w, t, k):
        n = k + sum(min(k, b - a, q - p) for (a, p), (b, q) in zip(chain, chain[1:]))
        first, last = chain[0][0], chain[-1][0] + k - 1
        keyed = not key or any(t[p:p + k] == key[:k] for _, p in chain)
        found = (keyed, n, -first, len(chain), last)
        best[low] = max(best.get(low, found), found)
    good = [(n, first, -last, -low, grams / (len(t) - k + 1)) for low, (keyed, n, first, grams, last) in best.items()
            if keyed and grams >= ls.COVERAGE * (len(t) - k + 1)
            and n >= ls.COVERAGE * max(len(t), last + first + 1)]
    return sorted((-f, -last, template.label, c) for n, f, last, low, c in good if not any(
        other[:4] > (n, f, last, low) and -other[1] <= -last and -other[2] >= -f for other in good))


def test_spans_against_alignments_written_out(spark):
    rng = random.Random(5)
    templates = [t for t in ls.TEMPLATES if len(t.text.split()) <= 9]
    texts = ["released under the zzz under the mit the mit license",
             "license mit the under released", "the mit license the mit under the released under the"]
    for _ in range(150):
        w = []
        for t in rng.choices(templates, k=2):
            part = re.sub(r"[^A-Za-z0-9]+", " ", t.text).split()
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(part))
                part[i:i + rng.randrange(2)] = rng.choice([[], ["zzz"], part[:2], part[i:i + 3]])
                part = part or ["zzz"]
            w += part + ["and"] * rng.randrange(3)
        texts.append(" ".join(w))
    got = scan(spark, texts)
    for i, text in enumerate(texts):
        want = sorted(x for t in ls.TEMPLATES for x in plain_spans(text, t))
        assert [tuple(s) for s in got[i]["spans"]] == want, text
    first = [tuple(s) for s in got[0]["spans"]]
    assert [s[:3] for s in first] == [(4, 9, "mit")] and first[0][3] < 1
    assert not got[1]["spans"] and not got[2]["spans"]
