"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.

1. ``quality``: rows that the weakly supervised label model rejects go.
2. ``near_duplicates``: one row of each SimHash class stays, the first by id.
3. ``decontaminate``: rows that hold a verified overlap with the benchmark go.
4. ``pii``: personal data is replaced by its kind in brackets; ``n_chars``
   follows the new text.
5. ``pack``: one row per piece of a document with its place in a sequence.

All but the last return the columns of ``docs``.  Null ids and texts, repeated
rows and empty tables have the results that the operators define.
"""

from __future__ import annotations

from tessera.llm import decontaminate, packing, pii, quality, simhash
from tessera.llm.common import stage as staged
from tessera.llm.common import table


def quality_rules(spark, docs, sf_dir):
    return quality.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    return simhash.keep_one_per_class(docs, k=4, radius=4)


def benchmark_decontamination(spark, docs, sf_dir):
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"),
                                             short_words=decontaminate.SHORT_WORDS,
                                             least_words=decontaminate.LEAST_WORDS)


def personal_data(spark, docs, sf_dir):
    return pii.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: EM, connected components and best fit are iterative: tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
