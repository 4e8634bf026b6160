import pytest
from pyspark.sql import functions as F

from tessera.functions import errors as ERR
from tessera.operators import generate as G


def test_candidate_list(spark):
    df = spark.createDataFrame([(" a ", "b, a,,c ,b")], "p string, f string")
    assert df.select(G.candidate_list(F.col("p"), F.col("f")).alias("c")).first().c == ["a", "b", "c"]


def _kinds(spark, etype, msg):
    df = spark.createDataFrame([(etype, msg)], "t string, m string")
    t, m = F.col("t"), F.col("m")
    return df.select(ERR.client_kind(t, m), ERR.public_kind(t, m), ERR.status_code(t, m),
                     ERR.unavailable(t, m)).first()


def test_certificate_before_timeout_in_public_message(spark):
    client, public, status, unavailable = _kinds(spark, "SSLError", "CERTIFICATE_VERIFY_FAILED ... timeout")
    assert (client, public, status, unavailable) == ("timeout", "certificate", 504, False)


def test_blocked_and_unavailable(spark):
    assert tuple(_kinds(spark, "OSError", "[WinError 10013] denied")) == ("blocked", "blocked", 502, False)
    assert _kinds(spark, "NotFound", "gone")[3] is True
    assert _kinds(spark, "Exc", "model is no longer available")[3] is True


class NotFound(Exception):
    pass


def test_generate_one_fallback_and_stop():
    calls = []

    def gone(p):
        raise NotFound("x")

    def broken(p):
        raise ValueError("bad request")

    def ok(p):
        calls.append(p)
        return p.upper()

    r = G.generate_one("hi", ["a", "b"], {"a": gone, "b": ok}, G.RetryPolicy(), sleep=lambda s: None)
    assert (r["text"], r["candidate"], r["tried"]) == ("HI", "b", ["a", "b"])
    r = G.generate_one("hi", ["a", "b"], {"a": broken, "b": ok}, G.RetryPolicy(), sleep=lambda s: None)
    assert r["text"] is None and r["error_kind"] == "failed" and r["tried"] == ["a"]
    r = G.generate_one("hi", ["a", "c"], {"a": gone}, G.RetryPolicy(), sleep=lambda s: None)
    assert r["error_kind"] == "unavailable" and r["tried"] == ["a", "c"]


def test_retry_backoff_and_deadline():
    waits = []
    state = {"n": 0}

    def flaky(p):
        state["n"] += 1
        if state["n"] <= 5:
            raise G.TransientError("503")
        return "ok"

    r = G.generate_one("x", ["m"], {"m": flaky}, G.RetryPolicy(), sleep=waits.append)
    assert r["text"] == "ok" and waits == [1.0, 2.0, 4.0, 5.0, 5.0] and r["waited_seconds"] == 17.0

    waits.clear()
    now = [0.0]

    def slow(p):  # a call takes four seconds, and they count
        now[0] += 4
        raise G.TransientError("503")

    def rest(s):
        waits.append(s)
        now[0] += s

    r = G.generate_one("x", ["m"], {"m": slow}, G.RetryPolicy(deadline=10), sleep=rest, clock=lambda: now[0])
    assert r["error_kind"] == "transient" and now[0] <= 10 + 4
    assert (r["attempts"], r["waited_seconds"]) == (2, 1.0) and waits == [1.0]


def test_output_token_limit_reaches_the_client():
    seen = {}

    def client(p, max_output_tokens):
        seen["n"] = max_output_tokens
        return p

    G.generate_one("x", ["m"], {"m": client}, G.RetryPolicy(max_output_tokens=7))
    assert seen == {"n": 7}


def test_generate_over_dataframe(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")

    def factory():
        return {"up": lambda p: p.upper()}

    out = G.generate(df, "prompt", ["k"], ["up"], factory).orderBy("k").collect()
    assert [(r.k, r.text, r.candidate) for r in out] == [(1, "A", "up"), (2, "B", "up")]


def test_prompts_are_spread_over_tasks(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "k int, prompt string").coalesce(1)
    out = G.generate(df, "prompt", ["k"], ["m"], lambda: {"m": str.upper}, partitions=5)
    assert out.rdd.getNumPartitions() == 5 and out.count() == 40


def test_failures_stay_pending_and_prompts_are_stored_once(spark, tmp_path):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, p string")

    def run(fn):
        out = G.generate_into(df, "p", ["k"], ["m"], lambda: {"m": fn}, store).collect()
        return sorted((r.k, r.text, r.error_kind) for r in out)

    def broken(p):
        raise ValueError("bad request")

    assert run(broken) == [(1, None, "failed"), (2, None, "failed"), (3, None, "failed")]
    assert run(str.upper) == [(1, "A", None), (2, "A", None), (3, "B", None)]
    assert run(broken) == [(1, "A", None), (2, "A", None), (3, "B", None)]
    assert spark.read.parquet(store).count() == 4


def test_responses(spark):
    rows = [("upload", "ValueError", "vazio", 400, "vazio"), ("generation", "X", "Read timed out", 504, None),
            ("generation", "X", "boom", 502, "boom"), ("other", "X", "boom", 500, ERR.UNEXPECTED_TEXT + "boom")]
    df = spark.createDataFrame(rows, "s string, t string, m string, status int, detail string")
    for r in df.withColumn("r", ERR.response(F.col("s"), F.col("t"), F.col("m"))).collect():
        assert r.r.status == r.status and r.r.detail == (r.detail or ERR.PUBLIC_TEXT["timeout"])


def test_pending_prompts(spark):
    prompts = spark.createDataFrame([(1,), (2,)], "k int")
    done = spark.createDataFrame([(2,)], "k int")
    assert [r.k for r in G.pending_prompts(prompts, done, "k").collect()] == [1]


def test_generate_into_resumes_without_regenerating(spark, tmp_path):
    store = str(tmp_path / "store")

    def clients(tag):
        return lambda: {"m": lambda p: f"{tag}:{p}"}

    first = spark.createDataFrame([("a",), ("b",)], "p string")
    G.generate_into(first, "p", ["p"], ["m"], clients("run1"), store).collect()
    both = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    out = G.generate_into(both, "p", ["p"], ["m"], clients("run2"), store)
    assert sorted((r.p, r.text) for r in out.collect()) == [
        ("a", "run1:a"), ("b", "run1:b"), ("c", "run2:c")]
