"""The dealt operators bound to the driver tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import (conversations, decontaminate, jaccard, license_scan, line_dedup, packing, pii,
                         quality, sharding, simhash, spelling, toxicity, url_filter)
from tessera.llm.common import table

SHARDS = 24

#: The rules of the contract.
BASE_RULES = [
    url_filter.Rule("||net/", "block", 1),
    url_filter.Rule("||example.net/en/", "allow", 1),
    url_filter.Rule("||example.com/de/", "block", 1),
    url_filter.Rule("||org/fr/", "allow", 1),
]

#: Common words of gambling, adult, pharmacy and advertising hosts.
KEYWORDS = ["adult", "ads", "bets", "casino", "gambling", "pills", "poker", "porn", "spam",
            "viagra", "xxx"]
URL_RULES = BASE_RULES + [url_filter.Rule(f"^{w}^", "block") for w in KEYWORDS] + [
    url_filter.Rule("^free^bets^", "block"), url_filter.Rule("^cheap^pills^", "block"),
    url_filter.Rule("^track^click^", "block")]


def op1_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_shard(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    return sharding.hypergeometric_shuffle(rows, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_pii(spark, sf_dir):
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
    counts = [F.size(pii.of_kind(F.col("base_spans"), k)).cast("long").alias(f"n_{k}")
              for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts,
                        F.sha2(pii.span_text(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.span_text(F.col("spans")).alias("spans"))


def op4_decontaminate(spark, sf_dir):
    return decontaminate.find_overlaps(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark"), short_words=decontaminate.SHORT_WORDS)


def op5_url_filter(spark, sf_dir):
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    base = F.col("priority") == 1
    return judged.select("page_id", "host", "path",
                         F.when(base, F.substring("pattern", 3, 1 << 30)).alias("rule"),
                         F.col("action").alias("verdict"), "pattern")


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, "text", ["doc_id"]).select(
        "doc_id", *quality.KEPT, "base_failed", "kept", "p_good")


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.find_repeats(docs).drop("row")


def op8_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.flatten(F.map_values("places"))
    return found.select("doc_id", "n_words", F.size(starts).cast("long").alias("n_base"),
                        F.array_min(starts).cast("long").alias("first_word"),
                        F.array_max(starts).cast("long").alias("last_word"),
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


#: Rows in this class of crc32(doc_id) never train; a score from here on is called toxic.
HELD_OUT, TOXIC = 2, 0.3


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.add_score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_simhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op11_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op12_conversations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return conversations.survey(rows, conversations.repair(conversations.damage(rows)))


def op13_spelling(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.count_words(docs))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_shard": op2_shard,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_jaccard": op11_jaccard,
    "op12_conversations": op12_conversations,
    "op13_spelling": op13_spelling,
}


def _url_sql() -> str:
    listed = ",\n    ".join(
        f"('{r.pattern}', '{url_filter.regex_of(r.pattern)}', '{r.action}', {r.priority})"
        for r in URL_RULES)
    return f"""
WITH rules(pattern, regex, act, priority) AS (VALUES
    {listed}),
parsed AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') = 0 OR url IS NULL THEN '' ELSE
      translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN strpos(url, '://') = 0 OR url IS NULL THEN '' ELSE
      regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) END AS path,
    CASE WHEN strpos(url, '://') = 0 OR url IS NULL THEN '' ELSE
      regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1) END AS query
  FROM pages),
urls AS (SELECT DISTINCT host || path || query AS target FROM parsed),
best AS (
  SELECT target, pattern, act, priority FROM urls JOIN rules ON regexp_matches(target, regex)
  QUALIFY row_number() OVER (PARTITION BY target
    ORDER BY priority DESC, length(pattern) DESC, pattern DESC) = 1)
SELECT page_id, host, path,
  CASE WHEN priority = 1 THEN substr(pattern, 3) END AS rule,
  coalesce(act, 'allow') AS verdict, pattern
FROM parsed LEFT JOIN best ON host || path || query = target"""


#: Units are sentences, a line cut behind every run of .!? (the pattern covers the whole text).
LINE_SQL = f"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_extract_all(text, '[^.!?\\n]*[.!?]*\\n?'), lambda x: x <> '') AS l
  FROM documents WHERE text <> ''),
pieces AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS piece FROM split),
placed AS (
  SELECT doc_id, i, trim(regexp_replace(lower(piece), '\\s+', ' ', 'g')) AS norm,
         coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + length(regexp_extract(piece, '^\\s*')) AS start,
         length(regexp_replace(regexp_replace(piece, '^\\s+', ''), '\\s+$', '')) AS size,
         len(regexp_extract_all(piece, '\\S+')) AS words
  FROM pieces),
units AS (
  SELECT doc_id, start, size, words, norm,
         row_number() OVER w - 1 AS unit,
         seen - words - coalesce(lag(seen) OVER w, 0) AS gap
  FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS seen FROM placed)
  WHERE words >= {line_dedup.UNIT_WORDS}
  WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY norm) AS copies
  FROM units WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, unit)),
later AS (
  SELECT *, CASE WHEN unit - lag(unit) OVER w > 1 OR gap > {line_dedup.GAP_WORDS} THEN 1 ELSE 0 END AS breaks
  FROM ranked WHERE place > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
passages AS (
  SELECT *, sum(breaks) OVER (PARTITION BY doc_id ORDER BY unit) AS passage FROM later)
SELECT doc_id, CAST(min(unit) AS INTEGER) AS unit, CAST(count(*) AS INTEGER) AS units,
       CAST(min(start) AS INTEGER) AS start, CAST(max(start + size) AS INTEGER) AS "end",
       CAST(sum(words) AS INTEGER) AS words, min(keep_id) AS keep_id, max(copies) AS copies
FROM passages GROUP BY doc_id, passage HAVING sum(words) >= {line_dedup.MIN_WORDS}"""


SQL = {
    "op7_line_dedup": LINE_SQL,
    "op5_url_filter": _url_sql(),
}
