"""Registered queries: oracle SQL, contract columns, and the guard in the entry module."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.llm import queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))

COLUMNS = {
    "op2_shard": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op3_pii": "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op5_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op6_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint "
                         "n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op8_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint "
                        "base_labels:string labels:string score:double",
    "op9_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op10_simhash": "doc_id:bigint fingerprint:string component_id:bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, sf_small, name):
    df = queries.QUERIES[name](spark, sf_small)
    kinds = dict(df.dtypes)
    for column in COLUMNS[name].split():
        title, kind = column.split(":")
        assert kinds[title] == kind
    table = "pages" if name == "op5_url_filter" else "documents"
    assert df.count() == spark.read.parquet(f"{sf_small}/{table}.parquet").count()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, sf_small, name):
    con = duckdb.connect()
    for f in os.listdir(sf_small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_small}/{f}'")
    df = queries.QUERIES[name](spark, sf_small)
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in df.select(columns).collect())


def test_operators_run_where_executors_lack_the_package(tmp_path, sf_small):
    """Started from another folder, so that Python workers cannot import the package."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from tessera.session import local_session
from tessera.llm.queries import QUERIES
spark = local_session(4, 4)
for name in sorted(QUERIES):
    if name in ("op1_pack", "op4_decontaminate", "op7_line_dedup", "op9_toxicity", "op10_simhash", "op11_jaccard",
                "op12_conversations", "op13_spelling"):
        QUERIES[name](spark, {sf_small!r}).write.format("noop").mode("overwrite").save()
        print(name)
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert len(said.stdout.split()) == 8, said.stderr[-3000:]


def test_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_entry_works_without_the_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(sum(n.startswith('op') and n[2].isdigit() for n in e.queries()), len(e.oracle_sql()) > 50)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True)
    assert said.stdout.split() == ["0", "True"], said.stderr
