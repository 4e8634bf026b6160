"""A-26, A-27, A-30: text generation over a column of prompts.

The generator is caller-supplied: a mapping from candidate name to a plain
callable ``prompt -> text``.  ``generate`` runs it with ``mapInPandas``: one
Arrow batch at a time, one client per partition (``factory`` is called once
per task), ordered fallback to the next candidate only when the current one
is *unavailable*, bounded retry with exponential backoff for transient errors,
and errors kept as data so one bad row never fails the job.

Spark may re-run a task, so calls are at-least-once.  ``generate_into`` keeps
a store keyed by the prompt: each distinct prompt is generated once, only a
result without error counts as done, and failed prompts stay pending.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.errors import is_unavailable

RESULT_SCHEMA = ("text string, candidate string, tried array<string>, attempts int, "
                 "waited_seconds double, error_kind string, error string")


@dataclass(frozen=True)
class RetryPolicy:
    """A-30 defaults: first wait 1 s, doubled, capped at 5 s, all calls and
    waits within ``deadline`` seconds of elapsed time per candidate.
    ``max_output_tokens``, if set, is passed to the client."""
    initial: float = 1.0
    multiplier: float = 2.0
    maximum: float = 5.0
    deadline: float = 120.0
    max_output_tokens: int | None = None


class TransientError(Exception):
    """Raised by a generator for a failure worth retrying (throttling, 5xx)."""


def candidate_list(primary: Column, fallbacks: Column) -> Column:
    """A-26: primary (stripped) then comma-separated fallbacks (stripped,
    blanks dropped), first occurrence kept."""
    rest = F.filter(F.transform(F.split(fallbacks, ","), _strip), lambda x: x != "")
    return F.array_distinct(F.concat(F.array(_strip(primary)), rest))


def _strip(c: Column) -> Column:
    """White space removed at both ends (tabs and line breaks too)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


@dataclass
class _Effort:
    """Calls made and seconds waited for one prompt, kept on failure too."""
    attempts: int = 0
    waited: float = 0.0


def _call_with_retry(fn, prompt, policy: RetryPolicy, sleep, effort: _Effort,
                     clock=time.monotonic) -> str:
    limit = {} if policy.max_output_tokens is None else {"max_output_tokens": policy.max_output_tokens}
    began, wait = clock(), policy.initial
    while True:
        effort.attempts += 1
        try:
            return fn(prompt, **limit)
        except TransientError:
            if clock() - began + wait > policy.deadline:
                raise
            sleep(wait)
            effort.waited += wait
            wait = min(wait * policy.multiplier, policy.maximum)


def generate_one(prompt: str, candidates: list[str], clients: dict, policy: RetryPolicy,
                 sleep=time.sleep, clock=time.monotonic) -> dict:
    """A-27 for one prompt: the first available candidate answers."""
    tried: list[str] = []
    effort = _Effort()

    def result(**found):
        return dict(dict(text=None, candidate=None, tried=tried, attempts=effort.attempts,
                         waited_seconds=effort.waited, error_kind=None, error=None), **found)

    for name in candidates:
        tried.append(name)
        fn = clients.get(name)
        try:
            if fn is None:
                effort.attempts += 1
                raise LookupError(f"{name} is not found")
            text = _call_with_retry(fn, prompt, policy, sleep, effort, clock)
            return result(text=text, candidate=name)
        except Exception as exc:  # errors become data
            if is_unavailable(exc):
                continue
            kind = "transient" if isinstance(exc, TransientError) else "failed"
            return result(candidate=name, error_kind=kind, error=f"{type(exc).__name__}: {exc}")
    return result(error_kind="unavailable", error="no candidate available: " + ", ".join(tried))


def generate(df: DataFrame, prompt_col: str, key_cols: list[str], candidates: list[str],
             factory: Callable[[], dict], policy: RetryPolicy = RetryPolicy(),
             sleep: Callable[[float], None] = time.sleep, partitions: int | None = None) -> DataFrame:
    """A-27 over a DataFrame: keys + result struct columns.  ``partitions``
    tasks call at the same time, prompts dealt by their hash (default: the
    cluster's parallelism), however few partitions ``df`` has."""
    keys = df.select(*dict.fromkeys(key_cols + [prompt_col]))  # the prompt may be a key too
    types = {f.name: f.dataType.simpleString() for f in keys.schema.fields}
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in key_cols)
    schema = f"{key_schema}, {RESULT_SCHEMA}"
    n = partitions or df.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clients = factory()  # one client set per task
        for pdf in batches:
            results = [generate_one(p, candidates, clients, policy, sleep) for p in pdf[prompt_col]]
            out = pdf[key_cols].reset_index(drop=True)
            res = pd.DataFrame(results, columns=["text", "candidate", "tried", "attempts",
                                                 "waited_seconds", "error_kind", "error"])
            yield pd.concat([out, res], axis=1)

    return keys.repartition(n, F.xxhash64(prompt_col)).mapInPandas(run, schema)


def pending_prompts(prompts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Idempotent re-runs: prompts whose key has no stored result yet."""
    return prompts.join(done.select(key), key, "left_anti")


RESULT_COLUMNS = [c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")]


def generate_into(df: DataFrame, prompt_col: str, key_cols: list[str], candidates: list[str],
                  factory: Callable[[], dict], store: str, policy: RetryPolicy = RetryPolicy(),
                  sleep: Callable[[float], None] = time.sleep,
                  partitions: int | None = None) -> DataFrame:
    """A-27 as a resumable batch over the parquet folder ``store``, keyed by
    ``prompt_key`` (SHA-256 of the prompt).

    Distinct prompts without a good result are generated once and appended; a
    job's append commits whole, so a failed run leaves its prompts pending,
    and so does a stored error.  Returns the rows of ``df`` (``key_cols``,
    ``prompt_key``) with the result of their prompt: of several stored ones
    the last good one, else the last."""
    spark = df.sparkSession
    schema = f"prompt_key string, stored_at timestamp, {RESULT_SCHEMA}"
    keyed = df.withColumn("prompt_key", F.sha2(F.col(prompt_col), 256))
    todo = keyed.select("prompt_key", F.col(prompt_col).alias("_prompt")).dropDuplicates(["prompt_key"])
    try:
        done = spark.read.schema(schema).parquet(store)
        todo = pending_prompts(todo, done.where("error_kind IS NULL"), "prompt_key")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise  # nothing stored yet
    out = generate(todo, "_prompt", ["prompt_key"], candidates, factory, policy, sleep, partitions)
    out.withColumn("stored_at", F.current_timestamp()).write.mode("append").parquet(store)
    best = F.max_by(F.struct(*RESULT_COLUMNS), F.struct(F.col("error_kind").isNull(), "stored_at"))
    results = (spark.read.schema(schema).parquet(store).groupBy("prompt_key").agg(best.alias("_r"))
               .select("prompt_key", "_r.*"))
    return keyed.select(*dict.fromkeys(key_cols + ["prompt_key"])).join(results, "prompt_key", "left")
