"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a glob-like pattern with an action.  Its literal tokens (runs of
letters and digits with a fixed end on both sides) must all be tokens of any
URL that it can match, so it is enough to file it under one of them, and the
rarest one in the corpus fetches the fewest candidates.  URL tokens are joined
to this index, and only the fetched rules run their regular expression.

Pattern syntax: ``||`` at the start ties the pattern to a host label boundary
(the host itself or any subdomain), ``*`` is any text, ``^`` is a separator
(any character but letters and digits, or an end), everything else is literal.

The judged string is host + path, then the query with its ``?``.  Among the
rules that fit, the highest priority wins, then the longest pattern, then the
pattern's text.

Defined cases: a null url or one without ``://`` has an empty host and path,
meets no rule and is allowed; empty tables give no rows; repeated rows are each
judged; extra columns are left out, only the key and the results return.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import if_small, lower_ascii, stage

TOKEN = "[a-z0-9]+"


class Rule(NamedTuple):
    pattern: str
    action: str           # "block" or "allow"
    priority: int = 0


def regex_of(pattern: str) -> str:
    """Java and RE2 regular expression of a rule's pattern."""
    body, start = (pattern[2:], r"^(?:[^/?]*\.)?") if pattern.startswith("||") else (pattern, "")
    parts = {"*": ".*", "^": "(?:[^A-Za-z0-9]|^|$)"}
    return start + "".join(parts.get(ch, re.escape(ch) if not ch.isalnum() else ch) for ch in body)


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every matching URL holds whole; runs beside ``*`` or an open end are left out."""
    anchored = pattern.startswith("||")
    body = pattern[2:] if anchored else pattern
    out = []
    for m in re.finditer("[A-Za-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else ("." if anchored else "*")
        right = body[m.end()] if m.end() < len(body) else "*"
        if "*" not in (left, right):
            out.append(m[0].lower())
    if not out:
        raise ValueError(f"rule without a literal token: {pattern!r}")
    return sorted(set(out))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(target), F.lit(f"({TOKEN})"), F.lit(1)))


def index_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per rule, filed under its rarest literal token among ``urls(target)``.

    Counts cover all URLs; ties take the first token in alphabetical order.
    """
    spark = urls.sparkSession
    listed = spark.createDataFrame(
        [(i, r.pattern, regex_of(r.pattern), r.action, r.priority, literal_tokens(r.pattern))
         for i, r in enumerate(rules)],
        T.StructType([T.StructField("rule_id", T.IntegerType()),
                      T.StructField("pattern", T.StringType()),
                      T.StructField("regex", T.StringType()),
                      T.StructField("action", T.StringType()),
                      T.StructField("priority", T.IntegerType()),
                      T.StructField("tokens", T.ArrayType(T.StringType()))]))
    wanted = listed.select(F.explode("tokens").alias("token")).distinct()
    counts = (urls.select(F.explode(_tokens(F.col("target"))).alias("token"))
                  .join(if_small(wanted, 64 * sum(len(r.pattern) for r in rules)), "token", "left_semi")
                  .groupBy("token").agg(F.count("*").alias("n")))
    rare = (listed.select("rule_id", F.explode("tokens").alias("token"))
                  .join(counts, "token", "left")
                  .groupBy("rule_id")
                  .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rare")))
    return (listed.join(rare, "rule_id")
                  .select(F.col("rare.token").alias("token"), "rule_id", "pattern", "regex",
                          "action", "priority"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id",
                url_col: str = "url") -> DataFrame:
    """Per row: ``id_col``, host, path, pattern (of the winning rule, or null), action.

    Each distinct URL is judged once.  The rule side of the joins is as large
    as the rule list: it is broadcast below the size limit and shuffled beyond,
    where adaptive execution splits a skewed token.
    """
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"))
    parsed = rows.select("key", "url", host_of(F.col("url")).alias("host"),
                         path_of(F.col("url")).alias("path"))
    urls = (rows.filter(F.col("url").contains("://")).select("url").distinct()
                .select("url", F.concat(host_of(F.col("url")), path_of(F.col("url")),
                                        query_of(F.col("url"))).alias("target")))
    index = index_rules(urls, rules)
    best = F.max(F.struct("priority", F.length("pattern").alias("size"), "pattern", "action"))
    # staged, so that the join of a much repeated url is a plain one, whose skew can be split
    hits = stage(urls.select("url", "target", F.explode(_tokens(F.col("target"))).alias("token"))
                 .join(if_small(index, 64 * sum(len(r.pattern) for r in rules)), "token")
                 .filter(F.expr("target rlike regex"))
                 .groupBy("url").agg(best.alias("best")), "url-hits")
    return (parsed.join(hits, "url", "left")
                  .select(F.col("key").alias(id_col), "host", "path",
                          F.col("best.pattern").alias("pattern"),
                          F.coalesce("best.action", F.lit("allow")).alias("action"),
                          F.coalesce("best.priority", F.lit(0)).alias("priority")))
