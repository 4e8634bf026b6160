"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document.  No rule is
trusted outright: expectation-maximisation estimates, from the votes of all
documents, how often a rule votes bad on good documents and on each defect, and
the posterior probability of being good replaces the all-must-pass filter.

Votes alone cannot tell a rule's false alarms from a defect that only this rule
sees: both are texts with one bad vote.  What the rule measures can: the rates
of good texts thin out towards the bad threshold, so at most as many good texts
lie behind it as lie in the rule's middle, where it abstains.  The share in the
middle bounds a rule's false alarms, and EM starts from it: a rule that fires
on the tail of good texts is outvoted, one whose bad texts lie apart is not.

Votes are few, so the corpus is one count per vote pattern (at most 3 to the
power of the number of rules): one pre-aggregated pass over all documents.
Estimation runs on these counts on the driver; the posterior is then a column
expression, a sum of log ratios.  All of it is built-in functions.

Words are runs of other than space and 0x09-0x0D.

Defined cases: null and empty texts have no words, all counts 0, and fail the
base rule; an empty table gives no rows; repeated rows are each judged; columns
named like the results are replaced.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage, whole_row

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

PRIOR_GOOD = 0.8
ROUNDS = 30
#: Pseudo-counts of the starting rates: they keep a rule that never fires from a zero.
SMOOTHING = 1.0
#: A rule votes bad on this share of good documents where nothing is known of its middle,
#: on at least ``OWN_DEFECT`` of its own defect, never with certainty, and on good
#: documents at most half of the time.
FALSE_ALARM, OWN_DEFECT, LEAST_RATE, MOST_ALARMS = 0.01, 0.8, 1e-4, 0.5


def metrics(text: Column) -> dict[str, Column]:
    """Column expressions of one text, each over those before it (see ``add_metrics``)."""
    c = F.col
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    hashes = F.transform(c("_words"), lambda w: F.xxhash64(w))
    windows = F.when(c("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(c("_hashes"), i, WINDOW))))
    # (hash, place) in hash order: a window is repeated if a neighbour has its hash
    ordered = F.array_sort(F.transform(c("_windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = F.array_sort(F.filter(F.transform(c("_ordered"), lambda x, k: F.when(
        (F.get(c("_ordered"), k - 1)["h"] == x["h"]) | (F.get(c("_ordered"), k + 1)["h"] == x["h"]),
        x["i"])), lambda p: p.isNotNull()))
    covered = F.aggregate(F.transform(c("_places"), lambda p, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get(c("_places"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)
    has_repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    return {
        "_t": F.coalesce(text, F.lit("")),
        "_words": F.array_remove(F.split("_t", SPACE, -1), ""),
        "n_words": F.size("_words").cast("long"),
        "_hashes": hashes,
        "_windows": windows,
        "_ordered": F.when(has_repeats, ordered),
        "_places": F.when(c("_ordered").isNotNull(), repeated),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "word_chars": F.length(F.translate("_t", " \t\n\u000b\f\r", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "_lines": lines,
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_n_lines": F.size("_lines"),
        "_distinct": F.size(F.array_distinct("_hashes")),
        "_upper": F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", "")),
        "_letters": F.length(F.regexp_replace("_t", "[^\\p{L}]+", "")),
        "_exclaim": F.length("_t") - F.length(F.translate("_t", "!", "")),
    }


KEPT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["_n_lines", "_distinct", "_upper", "_letters", "_exclaim"]


class Rule(NamedTuple):
    """Bad at or above ``bad``, good at or below ``good`` of ``numerator / denominator``."""

    name: str
    numerator: str
    denominator: str
    good: float
    bad: float
    least: int = 1  # abstain below this denominator


RULES = [
    Rule("symbols", "n_symbols", "n_words", 0.02, 0.10),
    Rule("repeated_words", "n_repeat_words", "n_words", 0.05, 0.30, 8),
    Rule("duplicate_lines", "n_dup_lines", "_n_lines", 0.05, 0.30, 5),
    Rule("upper_case", "_upper", "_letters", 0.10, 0.40),
    Rule("exclamations", "_exclaim", "n_words", 0.02, 0.20),
    Rule("word_length", "word_chars", "n_words", 8.0, 12.0),
    Rule("vocabulary", "n_words", "_distinct", 3.0, 6.0, 10),
]
#: Too few words: no rate is reliable, and the count itself votes.
LENGTH_GOOD, LENGTH_BAD = 50, 20


def votes() -> dict[str, Column]:
    """One tinyint column per rule over the metric columns: 1 good, -1 bad, 0 abstain."""
    out = {}
    for r in RULES:
        rate = F.try_divide(r.numerator, r.denominator)
        out[f"vote_{r.name}"] = (F.when(F.col(r.denominator) < r.least, 0).when(rate >= r.bad, -1)
                                  .when(rate <= r.good, 1).otherwise(0).cast("tinyint"))
    n = F.col("n_words")
    out["vote_length"] = (F.when(n < LENGTH_BAD, -1).when(n >= LENGTH_GOOD, 1).otherwise(0)
                           .cast("tinyint"))
    return out


def middles() -> Column:
    """Bit j is set where rule j abstains because its rate lies between good and bad."""
    flags = []
    for r in RULES:
        rate = F.try_divide(r.numerator, r.denominator)
        flags.append((F.col(r.denominator) >= r.least) & (rate > r.good) & (rate < r.bad))
    flags.append((F.col("n_words") >= LENGTH_BAD) & (F.col("n_words") < LENGTH_GOOD))
    bits = [F.when(flag, 1 << j).otherwise(0) for j, flag in enumerate(flags)]
    return sum(bits[1:], bits[0]).cast("int")


def alarm_bounds(counts: dict[tuple[int, ...], int], middle: dict[tuple[int, ...], list[int]],
                 n_rules: int) -> list[float]:
    """Per rule: the share in its middle of the texts that no rule calls bad, which bounds its
    false alarms; ``middle[p][j]`` texts of vote pattern p lie in the middle of rule j."""
    clean = [p for p in counts if -1 not in p]
    out = []
    for j in range(n_rules):
        between = sum(middle[p][j] for p in clean)
        good = sum(counts[p] for p in clean if p[j] == 1)
        share = (between + SMOOTHING * FALSE_ALARM) / (between + good + SMOOTHING)
        out.append(min(MOST_ALARMS, max(LEAST_RATE, share)))
    return out


class LabelModel(NamedTuple):
    """Classes are good (first) and one defect per rule.

    ``weights[c]`` is the share of class c, ``fails[c][j]`` the probability
    that rule j, when it votes, votes bad on a document of class c.
    """

    weights: list[float]
    fails: list[list[float]]

    def log_ratios(self) -> list[tuple[float, list[dict[int, float]]]]:
        """Per defect: log odds against good before any vote, and what each vote adds."""
        good, out = self.fails[0], []
        for weight, rates in zip(self.weights[1:], self.fails[1:]):
            adds = [{-1: math.log(f / g), 1: math.log((1 - f) / (1 - g))}
                    for f, g in zip(rates, good)]
            out.append((math.log(weight / self.weights[0]), adds))
        return out

    def posteriors(self, pattern) -> list[float]:
        odds = [1.0] + [math.exp(start + sum(a[v] for a, v in zip(adds, pattern) if v))
                        for start, adds in self.log_ratios()]
        return [x / sum(odds) for x in odds]


def fit_label_model(counts: dict[tuple[int, ...], int], n_rules: int,
                    alarms: list[float] | None = None) -> LabelModel:
    """EM over vote patterns and their counts.

    Two classes would not do: defects exclude each other (shouting text has few
    symbols), so the rules that fire together take the bad class for themselves
    and a lone rule looks like noise on good documents.  With one defect class
    per rule, a rule's bad votes are weighed against its false alarms on good
    documents.  Rules err independently given the class, an abstention says
    nothing, and the bounds keep each class tied to what it is named for.
    ``alarms`` (see ``alarm_bounds``) bounds each rule's false alarms.
    """
    alarms = [FALSE_ALARM] * n_rules if alarms is None else alarms

    def bounded(c: int, j: int, rate: float) -> float:
        low, high = ((LEAST_RATE, alarms[j]) if c == 0 else
                     (OWN_DEFECT, 1 - LEAST_RATE) if c == j + 1 else (LEAST_RATE, 1 - LEAST_RATE))
        return min(high, max(low, rate))

    start = [[alarms[j] if c == 0 else 0.95 if c == j + 1 else 0.05 for j in range(n_rules)]
             for c in range(n_rules + 1)]
    weights = [PRIOR_GOOD] + [(1 - PRIOR_GOOD) / n_rules] * n_rules
    model, total = LabelModel(weights, start), sum(counts.values())
    for _ in range(ROUNDS if total else 0):
        shares = {p: model.posteriors(p) for p in counts}
        mass = [SMOOTHING * w + sum(n * shares[p][c] for p, n in counts.items())
                for c, w in enumerate(weights)]
        fails = []
        for c in range(n_rules + 1):
            rates = []
            for j in range(n_rules):
                bad = sum(n * shares[p][c] for p, n in counts.items() if p[j] == -1)
                voted = sum(n * shares[p][c] for p, n in counts.items() if p[j])
                rates.append(bounded(c, j, (bad + SMOOTHING * start[c][j]) / (voted + SMOOTHING)))
            fails.append(rates)
        model = LabelModel([m / sum(mass) for m in mass], fails)
    return model


def posterior_column(model: LabelModel, names: list[str]) -> Column:
    """Probability of good as a column over the vote columns."""
    odds = F.lit(1.0)
    for start, adds in model.log_ratios():
        log = F.lit(start)
        for add, name in zip(adds, names):
            log = log + (F.when(F.col(name) == -1, add[-1]).when(F.col(name) == 1, add[1])
                          .otherwise(0.0))
        odds = odds + F.exp(log)
    return F.lit(1.0) / odds


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def add_metrics(df: DataFrame, text_col: str) -> DataFrame:
    """``_row`` (all columns of ``df``) and the metric and vote columns."""
    out = df.select(whole_row(df).alias("_row"), F.col(text_col).alias("_src"))
    for name, column in metrics(F.col("_src")).items():
        out = out.withColumn(name, column)
    out = out.withColumns(votes()).withColumn("_middle", middles())
    return out.select("_row", *KEPT, *votes(), "_middle")


def judge(df: DataFrame, text_col: str = "text", carry: list[str] | None = None,
          threshold: float = 0.5) -> DataFrame:
    """The columns of ``carry`` (default: all) with metrics, votes, ``p_good``,
    ``base_failed`` and ``kept``.

    Metrics are computed once and staged; the model is fitted on the vote
    patterns of all rows, then applied to all rows.
    """
    carry = df.columns if carry is None else carry
    measured = add_metrics(df, text_col)
    names = list(votes())
    rows = stage(measured.withColumn("_row", F.struct(*[F.col(f"_row.`{c}`") for c in carry])),
                 "quality")
    between = [F.count_if(F.col("_middle").bitwiseAND(F.lit(1 << j)) != 0) for j in range(len(names))]
    patterns = rows.groupBy(*names).agg(F.count("*").alias("n"), F.array(*between).alias("middle")).collect()
    counts = {tuple(r[n] for n in names): r["n"] for r in patterns}
    middle = {tuple(r[n] for n in names): r["middle"] for r in patterns}
    model = fit_label_model(counts, len(names), alarm_bounds(counts, middle, len(names)))
    own = [*KEPT, *names, "p_good", "base_failed", "kept"]
    kept = ~F.col("base_failed") & (F.col("p_good") >= threshold)
    return (rows.withColumn("p_good", posterior_column(model, names))
                .withColumn("base_failed", base_failed())
                .withColumn("kept", kept)
                .select(*[F.col(f"_row.`{c}`").alias(c) for c in carry if c not in own], *own))


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that the label model keeps, columns as given."""
    wrapped = df.select(whole_row(df).alias("_doc"), F.col(text_col).alias("_body"))
    return (judge(wrapped, "_body", ["_doc"], threshold).filter("kept").select("_doc.*"))
