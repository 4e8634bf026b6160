"""Personal data by candidate generation and gradient boosting.

Generators propose spans with high recall, and their spans may overlap: the
four base patterns (with the matches that fail their check), bare numbers with
separators, and long mixes of letters and digits.  Each candidate has a few
small features of its format and its context.  Boosted trees score candidates,
a threshold per kind is calibrated for precision on a held-out half of the
texts, and candidates above it are redacted, besides all base spans.  Of these
only spans that lie inside another are dropped: one that goes beyond a base
span it overlaps stays beside it, and both are redacted as one.

Labels are weak, as nothing here is annotated: a base match is positive if it
passes its check (octets, Luhn, digit counts); a number or a mixed run is
positive if a word like ``phone`` or an assignment to ``token`` stands before
it, and for these two the context is then no feature.

All rows are used: the corpus is one count per combination of features and
label, a table bounded by the features' value ranges whatever the corpus, and
the trees are fitted on these counts by the driver.  Trees become nested CASE
expressions.  All work on rows is built-in functions; offsets are rebuilt from
the lengths of the pieces between matches.

Patterns are written so that they match what the plain ones match, without
recursion or quadratic search: quantifiers are possessive where no shorter
match can succeed, and a run that failed is not tried again from its middle.

Defined cases: null texts are like empty ones, without spans; repeated rows are
each searched; an empty table gives no rows; columns named like the results
are replaced, others pass through where they are carried.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, whole_row

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![A-Za-z0-9.(+-])\(?[0-9][\x20().0-9-]{5,}[0-9](?![A-Za-z0-9])"
MIXED = (r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])"
         r"[A-Za-z0-9_+/-]{20,}+")

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = BASE_KINDS + ["number", "secret"]
PATTERNS = dict(zip(KINDS, [EMAIL, IP, CARD, PHONE, NUMBER, MIXED]))

NUMBER_WORDS = r"(?i)\b(?:phone|tel|telephone|mobile|fax|call|ssn|account|iban|passport)\b[^A-Za-z0-9]*$"
SECRET_WORDS = r"(?i)(?:token|secret|password|passwd|api[_-]?key|key|auth)[\"']?\x20*[=:]\x20*[\"']?$"
ANY_WORDS = (r"(?i)\b(?:phone|tel|telephone|mobile|fax|call|card|visa|credit|account|mail|e-mail|contact|"
             r"ip|host|address|version)\b")

#: Names and number of values of the features: their product bounds the counts.
FEATURES = {"kind": len(KINDS), "digits": 7, "size": 6, "letters": 4, "marks": 5,
            "left": 4, "right": 4, "word": 2}
TREES, DEPTH, RATE = 40, 3, 0.3
PRECISION = 0.95
CONTEXT = 24


# -- candidates ---------------------------------------------------------------

def _luhn(digits: Column) -> Column:
    def add(total, i):
        v = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).otherwise(2 * v - F.when(v > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, match: Column, before: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]+", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return before.rlike(NUMBER_WORDS if kind == "number" else SECRET_WORDS)


def _side(char: Column) -> Column:
    return (F.when((char == "") | char.rlike("\\s"), 0).when(char.rlike("[\\p{L}0-9]"), 1)
             .when(char.rlike("[\"'`]"), 2).otherwise(3))


def _bucket(n: Column, ends: list[int]) -> Column:
    out = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        out = F.when(n < ends[i], i).otherwise(out)
    return out


def _features(kind: str, match: Column, before: Column, after: Column) -> dict[str, Column]:
    base = kind in BASE_KINDS
    letters = F.regexp_replace(match, "[^A-Za-z]+", "")
    none = F.lit(0)
    return {
        "kind": F.lit(KINDS.index(kind)),
        "digits": _bucket(F.length(F.regexp_replace(match, "[^0-9]+", "")), [1, 8, 13, 16, 17, 20]),
        "size": _bucket(F.length(match), [10, 16, 20, 32, 48]),
        "letters": F.when(letters == "", 0).when(letters.rlike("^[a-f]+$"), 1)
                    .when(match.rlike("[0-9]"), 2).otherwise(3),
        "marks": F.when(match.rlike("@"), 4).when(match.rlike("[()+]"), 3).when(match.rlike("\\."), 2)
                  .when(match.rlike("[ -]"), 1).otherwise(0),
        "left": _side(F.substring(before, -1, 1)) if base else none,
        "right": _side(F.substring(after, 1, 1)) if base else none,
        "word": before.rlike(ANY_WORDS).cast("int") if base else none,
    }


def _hits(kind: str, text: Column) -> Column:
    """Array of (gap before, hit, gap behind) of one pattern; null where a text can't have any."""
    pieces = F.split(text, PATTERNS[kind], -1)
    hits = F.arrays_zip(pieces.alias("gap"),
                        F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit"),
                        F.slice(pieces, 2, F.greatest(F.lit(1), F.size(pieces))).alias("next"))
    wanted = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
    return F.when(wanted, F.filter(hits, lambda x: x["hit"].isNotNull()))


def _found(kind: str, hits: Column) -> Column:
    """Array of (kind, start, end, label, features) of the hits of one pattern, in order."""
    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["hit"])).alias("at"),
                        F.concat(acc["starts"], start.cast("string"), F.lit(" ")).alias("starts"))

    def span(x):
        hit, start = x["h"]["hit"], x["s"].cast("int")
        before = F.substring(x["h"]["gap"], -CONTEXT, CONTEXT)
        return F.struct(F.lit(kind).alias("kind_name"), start.alias("start"),
                        (start + F.length(hit)).alias("end"),
                        _passes(kind, hit, before).cast("int").alias("label"),
                        *[c.cast("int").alias(n)
                          for n, c in _features(kind, hit, before, x["h"]["next"]).items()])

    # running offsets gathered as text: appending to an array copies it element by element
    starts = F.aggregate(hits, F.struct(F.lit(0).alias("at"), F.lit("").alias("starts")), add)["starts"]
    spans = F.transform(F.filter(F.arrays_zip(hits.alias("h"), F.split(starts, " ").alias("s")),
                                 lambda x: x["h"].isNotNull()), span)
    fields = "".join(f", {n}:int" for n in FEATURES)
    empty = F.array().cast(f"array<struct<kind_name:string,start:int,end:int,label:int{fields}>>")
    return F.coalesce(spans, empty)


def add_candidates(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``found``: all proposed spans of a text, by kind as listed, then start.

    Hits are columns of their own, since each is read twice."""
    hits = {f"_hits_{kind}": _hits(kind, text) for kind in KINDS}
    return (df.withColumns(hits)
              .withColumn("found", F.concat(*[_found(k, F.col(f"_hits_{k}")) for k in KINDS]))
              .drop(*hits))


# -- boosted trees on counts --------------------------------------------------

class Node(NamedTuple):
    """``feature <= cut`` goes to ``low``, else to ``high``; a leaf has only a value."""

    feature: int
    cut: int
    low: "Node | None"
    high: "Node | None"
    value: float


class Model(NamedTuple):
    start: float
    trees: list[Node]
    #: probability from which on candidates of a kind are redacted (above 1: none)
    thresholds: dict[str, float]


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, 0)
    for f in range(x.shape[1]) if depth else ():
        for cut in range(int(x[rows, f].min()), int(x[rows, f].max())):
            left = rows[x[rows, f] <= cut]
            gl, hl = grad[left].sum(), hess[left].sum()
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, f, cut)
    _, f, cut = best
    if f < 0:
        return Node(-1, 0, None, None, float(RATE * g / (h + 1)))
    below = x[rows, f] <= cut
    return Node(f, cut, _grow(x, grad, hess, rows[below], depth - 1),
                _grow(x, grad, hess, rows[~below], depth - 1), 0.0)


def _value(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _value(node.low, x), _value(node.high, x))


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    odds = model.start + sum((_value(t, x) for t in model.trees), np.zeros(len(x)))
    return 1 / (1 + np.exp(-odds))


def fit(rows: list[tuple]) -> Model:
    """From (*features, label, half, count): trees on half 0, thresholds on half 1."""
    width = len(FEATURES)
    data = np.array(sorted(rows), np.int64).reshape(-1, width + 3)
    train = data[data[:, width + 1] == 0]
    x, label, n = train[:, :width], train[:, width].astype(float), train[:, -1].astype(float)
    share = ((n * label).sum() + 0.5) / (n.sum() + 1)
    model = Model(math.log(share / (1 - share)), [], {})
    for _ in range(TREES if len(x) else 0):
        p = scores(model, x)
        model.trees.append(_grow(x, n * (label - p), n * p * (1 - p), np.arange(len(x)), DEPTH))
    held = data[data[:, width + 1] == 1]
    p = scores(model, held[:, :width])
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = held[:, 0] == k
        thresholds[kind] = _threshold(p[own], held[own, width], held[own, -1])
    return Model(model.start, model.trees, thresholds)


def _threshold(p: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """Lowest score from which on candidates are positive at the wanted precision."""
    best = 2.0
    for cut in sorted(set(p.tolist()), reverse=True):
        above = p >= cut
        if (n * label)[above].sum() >= PRECISION * n[above].sum():
            best = cut
    return best


def _tree_column(node: Node, x: Column) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    field = x[list(FEATURES)[node.feature]]
    return F.when(field <= node.cut, _tree_column(node.low, x)).otherwise(_tree_column(node.high, x))


def selected(model: Model, x: Column) -> Column:
    """Whether the model redacts a candidate that is no base span."""
    wanted = {k: t for k, t in model.thresholds.items() if t <= 1}
    if not wanted:
        return F.lit(False)
    odds = F.lit(model.start)
    for tree in model.trees:
        odds = odds + _tree_column(tree, x)
    cuts = F.lit(None).cast("double")
    for kind, t in wanted.items():
        t = min(max(t, 1e-12), 1 - 1e-12)
        cuts = F.when(x["kind_name"] == kind, math.log(t / (1 - t)) - 1e-9).otherwise(cuts)
    return F.coalesce(odds >= cuts, F.lit(False))


# -- operator -----------------------------------------------------------------

def detect(df: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: all) with ``base_spans`` and ``spans``: arrays of
    (kind, start, end) by kind as listed, then start; ``spans`` has the model's too.

    Candidates are found once and staged, the model is fitted on the counts of
    all of them, then applied to all.
    """
    carry = df.columns if carry is None else carry
    text = F.coalesce(F.col("_text"), F.lit(""))
    texts = df.select(whole_row(df.select(*[F.col(f"`{c}`") for c in carry])).alias("_row"),
                      F.col(text_col).alias("_text"))
    rows = stage(add_candidates(texts, text)
                 .withColumn("half", F.pmod(F.xxhash64(text), F.lit(2)).cast("int")).drop("_text"), "pii")
    each = rows.select("half", F.inline("found"))
    counts = each.groupBy(*FEATURES, "label", "half").agg(F.count("*").alias("n")).collect()
    model = fit([tuple(r) for r in counts])
    is_base = lambda x: x["kind_name"].isin(BASE_KINDS) & (x["label"] == 1)
    place = lambda x: F.struct(x["kind_name"].alias("kind"), x["start"].alias("start"),
                               x["end"].alias("end"))
    chosen = F.transform(F.filter("found", lambda x: is_base(x) | selected(model, x)), lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("minus_end"), (~is_base(x)).alias("added"),
        x["kind_name"].alias("kind")))
    found = (rows.withColumn("_base", F.transform(F.filter("found", is_base), place))
                 .withColumn("_chosen", F.array_sort(chosen))
                 .withColumn("_more", _added(F.col("_chosen"))))
    ordered = F.concat(*[F.array_sort(of_kind(F.concat("_base", "_more"), k)) for k in KINDS])
    kept = [c for c in carry if c not in ("base_spans", "spans")]
    return found.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept],
                        F.col("_base").alias("base_spans"), ordered.alias("spans"))


def _added(spans: Column) -> Column:
    """The model's spans that no other span holds: of spans by start, the longest
    first, one lies inside another if an earlier one ends where it does or later.

    A span that only overlaps others stays, so that nothing of it is left
    readable; equal ones count once, base spans first, then by kind."""
    def step(acc, x):
        end = -x["minus_end"]
        return F.struct(F.greatest(acc["end"], end).alias("end"),
                        F.concat(acc["inside"], F.when(acc["end"] >= end, F.lit("1")).otherwise(F.lit("0")))
                        .alias("inside"))

    # one letter for each span: appending to an array copies it element by element
    inside = F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit("").alias("inside")), step)["inside"]
    left = F.filter(F.arrays_zip(spans.alias("span"), F.split(inside, "").alias("inside")),
                    lambda x: x["span"]["added"] & (x["inside"] == "0"))
    return F.transform(left, lambda x: F.struct(x["span"]["kind"].alias("kind"), x["span"]["start"].alias("start"),
                                                (-x["span"]["minus_end"]).alias("end")))


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, like ``[EMAIL]``.

    Overlapping spans are one: the first by start (then the longer) names it.
    """
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["kind"].alias("kind"))))

    def cut(acc, x):
        end = -x["minus_end"]
        new = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(end, acc["at"]).alias("at"),
            F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]),
                                 F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the spans redacted in its text; ``n_chars``, if there, is the new length."""
    wrapped = df.select(whole_row(df).alias("_doc"), F.col(text_col).alias("_body"))
    found = detect(wrapped, "_body", ["_doc"]).select(
        "_doc", redacted(F.col(f"_doc.`{text_col}`"), F.col("spans")).alias("_new"))
    new = {text_col: F.col("_new")}
    if "n_chars" in df.columns:
        new["n_chars"] = F.length("_new").cast(df.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in df.columns])
