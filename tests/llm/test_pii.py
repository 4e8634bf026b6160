import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii


def luhn(d):
    total = 0
    for k, ch in enumerate(reversed(d)):
        v = int(ch)
        if k % 2:
            v = 2 * v - (9 if v > 4 else 0)
        total += v
    return total % 10 == 0


def plain(t):
    """Base spans by the patterns as they are stated."""
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


CASES = [
    None, "", "no data here", "a@b.c", "a@b.c_d@e.f", "x@y.z@q.r", "..a@b.c.", "é@b.co ä.b@c.de", "a@b", "a@-.-",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "01.002.3.255", "1.2.3.256", "1..2.3.4", "999999999999.1.1.1",
    "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "x4111111111111111y", "41111111111111112",
    "0" * 16, "0" * 19, "0" * 20, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "+1 (017) 555-7713", "+1", "+12345678", "+1234567", "+1 23 45 67 89 01 23 45 67", "++49 30 123456-78.", "+1((((((((2",
    "call +1 212 555 0100, or mail é.x@y.org from 10.0.0.1 with 4111-1111-1111-1111\nand \U0001f600 +44 20 7946 0958",
]


def random_texts():
    rng = random.Random(8)
    return ["".join(rng.choices("0123456789" * 2 + "aZ._%+-@ ()é\n", k=rng.choice([5, 30, 120]))) for _ in range(400)]


def test_base_spans_match_the_plain_patterns(spark):
    texts = CASES + random_texts()
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, spans string")
    out = pii.detect(df, "text", ["doc_id", "spans"]).select("doc_id", pii.span_text("base_spans").alias("b"),
                                                             pii.span_text("spans").alias("s"))
    for r in out.collect():
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(texts[r["doc_id"]]))
        assert r["b"] == want, texts[r["doc_id"]]
        assert set(filter(None, want.split(","))) <= set(r["s"].split(","))


def test_very_long_texts(spark):
    """Neither recursion nor quadratic search (which the plain patterns would need)."""
    n = 200_000
    want = {"a" * n: "", "a." * (n // 2): "", "1 " * (n // 2): "", "+1" + "(" * n: "", "( " * (n // 2): "",
            "aB3/" * (n // 4): "", "9" * n: "", "a@b" + ".c" * (n // 4): f"email:0:{3 + n // 2}",
            "1." * (n // 2): ",".join(f"ip:{i}:{i + 7}" for i in range(0, n, 8))}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id int, text string")
    got = pii.detect(df, "text", ["doc_id"]).select("doc_id", pii.span_text("base_spans").alias("b")).collect()
    assert {r["doc_id"]: r["b"] for r in got} == dict(enumerate(want.values()))


def test_model_adds_secrets_by_format(spark):
    """Keys that stand behind ``token =`` teach their format; long plain words don't look like it."""
    rng = random.Random(1)
    key = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    rows = [f'see token = "{key()}" here {i}' for i in range(60)]
    rows += [f"plain {'ab' * 15}-part-{i}-of-a-long-name" for i in range(60)]
    bare = f"nothing before it {key()} end"
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, bare])], "doc_id int, text string")
    got = {r["doc_id"]: r["s"] for r in pii.detect(df, "text", ["doc_id"]).select(
        "doc_id", pii.span_text("spans").alias("s")).collect()}
    assert got[len(rows)] == "secret:18:58"
    assert sum(bool(got[i]) for i in range(60)) >= 55
    assert not any(got[i] for i in range(60, 120))


def test_secret_around_a_card_is_redacted_whole(spark):
    rng = random.Random(3)
    key = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    rows = [f'token = "{key()}" {i}' for i in range(60)]
    rows += ["token=abcdefghijkl4111111111111111mnopqr end", "card 4111111111111111 end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id int, text string")
    got = {r["doc_id"]: r["s"] for r in pii.detect(df, "text", ["doc_id"]).select(
        "doc_id", pii.span_text("spans").alias("s")).collect()}
    assert got[60] == "card:18:34,secret:6:40" and got[61] == "card:5:21"
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[60] == "token=[SECRET] end" and out[61] == "card [CARD] end"


def test_added_spans_against_all_pairs(spark):
    """Overlapping spans of all kinds: those inside another go, all others stay."""
    rng = random.Random(4)
    rows = []
    for i in range(200):
        spans = [(s, -(s + rng.randint(1, 6)), rng.random() < 0.6, rng.choice(pii.KINDS))
                 for s in (rng.randint(0, 20) for _ in range(rng.randint(0, 8)))]
        rows.append((i, sorted(set(spans))))
    df = spark.createDataFrame(rows, "i int, s array<struct<start:int,minus_end:int,added:boolean,kind:string>>")
    got = {r["i"]: [tuple(x) for x in r["m"]] for r in df.select("i", pii._added(df["s"]).alias("m")).collect()}
    for i, spans in rows:
        want = [(k, s, -e) for n, (s, e, added, k) in enumerate(spans) if added and not any(
            s2 <= s and -e2 >= -e and ((s2, e2) != (s, e) or m < n) for m, (s2, e2, _, _) in enumerate(spans) if m != n)]
        assert got[i] == want, spans


def test_many_spans_in_one_text(spark):
    """4,000 keys and as many addresses in one text; a search of pairs would take 16 million steps for each kind."""
    text = " ".join(f"token=abcdefgh{i:06d}klmnopqrst a{i}@b.org" for i in range(4000))
    rows = [text] + [f"token=abcdefgh{i:06d}klmnopqrst {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    found = pii.detect(df, "text", ["doc_id"]).where("doc_id = 0")
    (row,) = found.select(F.size("base_spans").alias("b"), F.size(pii.of_kind(F.col("spans"), "secret")).alias("n")).collect()
    assert row["b"] == 4000 and row["n"] == 4000


def test_trees_find_the_planted_rule():
    rows = []
    rng = random.Random(2)
    for half in (0, 1):
        for digits in range(7):
            for left in range(4):
                good = digits >= 4 and left == 0
                for label in (0, 1):
                    n = 95 if label == good else 1
                    rows.append((2, digits, rng.randrange(1), 0, 0, left, 0, 0, label, half, n))
    model = pii.fit(rows)
    import numpy as np
    x = np.array([r[:8] for r in rows])
    p = pii.scores(model, x)
    truth = np.array([r[1] >= 4 and r[5] == 0 for r in rows])
    assert p[truth].min() > 0.9 and p[~truth].max() < 0.1
    assert 0.1 < model.thresholds["card"] <= p[truth].min() and model.thresholds["email"] > 1


def test_redaction(spark):
    text = "mail a@b.org or +1 212 555 0100 é from 10.0.0.1."
    df = spark.createDataFrame([(1, text, 9), (2, None, 0), (3, "clean", 5)], "doc_id int, text string, n_chars long")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[1]["text"] == "mail [EMAIL] or [PHONE] é from [IP]." and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "clean" and out[3]["n_chars"] == 5
    assert pii.redact(df).schema.simpleString() == df.schema.simpleString()


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert pii.detect(df).collect() == [] and pii.redact(df).collect() == []
    same = spark.createDataFrame([(1, "a@b.c")] * 3, "doc_id int, text string")
    assert [r["text"] for r in pii.redact(same).collect()] == ["[EMAIL]"] * 3


def test_main_path_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id int, text string")
    plan = pii.redact(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
