"""The pipeline against brute force on the small tables, stage by stage."""

import collections
import re

import pytest

import corpus_pipeline
from tessera.llm import quality
from test_decontaminate import plain as overlaps
from test_pii import plain as base_spans
from test_quality import plain as plain_metrics
from test_simhash import classes, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf_small, tmp_path_factory):
    """Rows after each stage, by name, starting with the table itself."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = {"documents": docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        result = stage(spark, docs, sf_small)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert result.schema.simpleString() == docs.schema.simpleString(), name
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_quality(stages):
    before, after = stages["documents"], {r["doc_id"] for r in stages["quality_rules"]}
    for r in before:
        n, _, _, _, repeated = plain_metrics(r["text"])
        if n < 20 or 100 * repeated > 30 * n:
            assert r["doc_id"] not in after
    assert 0.7 < len(after) / len(before) < 0.95


def test_one_document_of_each_class(stages):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in stages["quality_rules"]}
    root = classes(sorted(set(prints.values())), 4)
    first = {}
    for key in sorted(prints):
        first.setdefault(root[prints[key]], key)
    assert sorted(r["doc_id"] for r in stages["simhash_near_dedup"]) == sorted(first.values())


def test_no_overlap_is_left(stages, spark, sf_small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    want = [r["doc_id"] for r in stages["simhash_near_dedup"] if not overlaps(r["text"], items)]
    assert sorted(r["doc_id"] for r in stages["benchmark_decontamination"]) == sorted(want)


def test_personal_data_is_replaced(stages):
    before = {r["doc_id"]: r for r in stages["benchmark_decontamination"]}
    after = {r["doc_id"]: r for r in stages["pii"]}
    assert set(before) == set(after)
    for key, r in after.items():
        old, kinds = before[key]["text"], collections.Counter(re.findall(r"\[([A-Z]+)\]", r["text"]))
        spans = base_spans(old)
        assert not base_spans(r["text"]) or spans
        if not kinds:
            assert r["text"] == old and not spans
        assert all(kinds[k.upper()] >= 1 for k, _, _ in spans[:1])
        assert r["n_chars"] == len(r["text"])


def test_packed_sequences_hold_every_word(stages):
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in stages["pii"]}
    placed, used = collections.Counter(), collections.Counter()
    for r in stages["best_fit_packing"]:
        placed[r["doc_id"]] += r["length"]
        used[r["sequence"], r["capacity"]] += r["length"]
    assert placed == {k: n + 1 for k, n in words.items()}
    assert all(n <= capacity for (_, capacity), n in used.items())


def test_run_is_the_stages(stages, spark, sf_small):
    key = lambda r: tuple(r[c] for c in ("doc_id", "piece", "start", "length"))
    assert sorted(map(key, corpus_pipeline.run(spark, sf_small).collect())) == sorted(
        map(key, stages["best_fit_packing"]))


def test_empty_table(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert docs.collect() == []


def test_nulls_and_repeated_rows_pass(spark, sf_small):
    good = " ".join(f"word{k * k % 83}" for k in range(90))
    docs = spark.createDataFrame([(None, good, None, None, None), (1, None, None, None, None), (2, good, "en", "s", 5),
                                  (2, good, "en", "s", 5)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_small)
    assert {(r["doc_id"], r["length"]) for r in docs.collect()} == {(2, 91)}
    assert quality.RULES
