"""A-33 and group D: Markdown parsing and report checks; C-10 report building.

Documents are split into lines with ``posexplode`` on the executors; every
per-document step (sections, lists) is bounded by one document's size, and
cross-document work (number grounding) is a plain join on the number key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: required report sections (reference prompt structure) --
CLI_SECTIONS = ("Resumo Executivo", "Achados Principais", "Riscos Identificados", "Recomendações")
WEB_SECTIONS = ("Resumo Executivo", "Indicadores-Chave", "Achados Principais",
                "Riscos Identificados", "Próximos Passos")
WEB_WORD_RANGE = (500, 700)
# List items each section must hold (lowest, highest), as the prompts ask.
CLI_ITEM_RANGES = (("Achados Principais", 4, 6), ("Riscos Identificados", 2, 4),
                   ("Recomendações", 3, 5))
WEB_ITEM_RANGES = (("Indicadores-Chave", 3, 5), ("Achados Principais", 3, 4),
                   ("Riscos Identificados", 2, 3), ("Próximos Passos", 3, 3))
# White space removed around a line before the rule test (JS trim subset).
TRIM_CLASS = "[ \t\r\f\x0b\u00a0\ufeff]"
# ---------------------------------------------------------------------------

LINE_SPLIT = r"\r?\n"
BOLD = r"\*\*([^\n]*?)\*\*"
WORD = "[^ \t\r\n]+"
SENTENCE_END = r"[.!?)][ \t\r\n]*\z"


def line_kind(line: Column) -> Column:
    """heading / rule / item / paragraph, null for a blank line.  Heading and
    item tests look at the raw line, the rule test at the trimmed one."""
    is_rule = line.rlike(f"^{TRIM_CLASS}*(---|\\*\\*\\*){TRIM_CLASS}*\\z")
    return (F.when(line.startswith("## "), F.lit("heading"))
            .when(is_rule, F.lit("rule"))
            .when(line.startswith("- ") | line.startswith("* "), F.lit("item"))
            .when(line.rlike("[^" + TRIM_CLASS[1:]), F.lit("paragraph")))


def _lines(text: Column) -> Column:
    return F.split(text, LINE_SPLIT, -1)


def _kinds(text: Column) -> Column:
    return F.transform(_lines(text), line_kind)


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A-33: one row per non-blank line: kind (heading, rule, item,
    paragraph), content without its marker, bold spans (items and
    paragraphs only, as the reference renderer), and for list items
    whether the item starts a new list (the previous line is not an item).

    A document is one row, so the line kinds and the list starts are array
    functions inside that row: the plan is a single map stage (no shuffle,
    no window), and one huge document costs only its own task."""
    lines, kinds = _lines(F.col(text_col)), F.col("_kinds")

    def one(line, i):
        prev = F.when(i == 0, F.lit(None)).otherwise(F.element_at(kinds, i))
        kind = F.element_at(kinds, i + 1)
        start = F.when(kind == "item", prev.isNull() | (prev != "item"))
        return F.struct(i.cast("bigint").alias("line_no"), line.alias("line"), kind.alias("kind"),
                        start.alias("list_start"))

    rows = (docs.select(id_col, F.col(text_col))
            .withColumn("_kinds", _kinds(F.col(text_col)))
            .select(id_col, F.explode(F.transform(lines, one)).alias("b"))
            .select(id_col, "b.*")
            .where(F.col("kind").isNotNull()))
    content = (F.when(F.col("kind") == "heading", F.substring("line", 4, 1 << 30))
               .when(F.col("kind") == "item", F.substring("line", 3, 1 << 30))
               .when(F.col("kind") == "rule", F.lit(""))
               .otherwise(F.col("line")))
    return rows.select(id_col, "line_no", "kind", content.alias("content"),
                       F.when(F.col("kind").isin("item", "paragraph"),
                              F.regexp_extract_all(content, F.lit(BOLD), 1))
                       .otherwise(F.array().cast("array<string>")).alias("bold"), "list_start")


def headings(text: Column) -> Column:
    """Headings of a document in order (the heading test comes first, so a
    line starting with "## " is always a heading)."""
    return F.transform(F.filter(_lines(text), lambda l: l.startswith("## ")),
                       lambda l: F.substring(l, 4, 1 << 30))


def section_check(docs: DataFrame, id_col: str, text_col: str,
                  required: tuple[str, ...] = CLI_SECTIONS) -> DataFrame:
    """D-01: headings found in order, missing, extra, and whether the
    required ones that are present appear in the required order.  Per
    document, in-row: a map-only plan."""
    req = F.array(*[F.lit(x) for x in required])
    out = docs.select(id_col, headings(F.col(text_col)).alias("found"))
    f = F.col("found")
    return out.select(
        id_col, "found",
        F.filter(req, lambda x: ~F.array_contains(f, x)).alias("missing"),
        F.filter(f, lambda x: ~F.array_contains(req, x)).alias("extra"),
        (F.filter(f, lambda x: F.array_contains(req, x))
         == F.filter(req, lambda x: F.array_contains(f, x))).alias("in_order"),
        (f == req).alias("exact"),
    )


def misplaced_sections(docs: DataFrame, id_col: str, text_col: str,
                       required: tuple[str, ...] = CLI_SECTIONS) -> DataFrame:
    """D-01: the fewest required headings that would have to move (``misplaced``,
    in the order of the text) for the rest to stand in the required order.

    What may stay is a longest increasing subsequence of the headings' places in
    ``required``; of equally long ones the one that starts earliest, heading by
    heading.  A repeated heading is misplaced from its second use on; headings
    that are not required don't count; a null text has none.  In-row: per place
    the best subsequence that ends there is carried along the headings, so the
    work is headings times required ones, in a map-only plan."""
    req = F.array(*[F.lit(x) for x in required])
    none = F.array(*[F.array().cast("array<int>")] * len(required))

    def rank(path):
        return F.struct((-F.size(path)).alias("n"), path.alias("path"))

    def step(best, h):
        shorter = F.filter(F.slice(best, 1, h["place"] - 1), lambda path: F.size(path) > 0)
        start = F.coalesce(F.array_min(F.transform(shorter, rank))["path"], F.array().cast("array<int>"))
        path = F.concat(start, F.array(h["at"]))
        return F.transform(best, lambda old, i: F.when(
            (i + 1 == h["place"]) & (rank(path) < rank(old)), path).otherwise(old))

    named = F.transform(headings(F.col(text_col)), lambda x, i: F.struct(
        i.alias("at"), F.array_position(req, x).cast("int").alias("place"), x.alias("heading")))
    return (docs.select(id_col, F.filter(named, lambda h: h["place"] > 0).alias("_found"))
            .withColumn("_stay", F.array_min(F.transform(F.aggregate("_found", none, step), rank))["path"])
            .select(id_col, F.coalesce(F.transform(
                F.filter("_found", lambda h: ~F.array_contains("_stay", h["at"])), lambda h: h["heading"]),
                F.array().cast("array<string>")).alias("misplaced")))


def completeness_check(docs: DataFrame, id_col: str, text_col: str,
                       word_range: tuple[int, int] = WEB_WORD_RANGE) -> DataFrame:
    """D-02: size and completeness per document: words, headings, items,
    paragraphs, word range, and whether the text ends a sentence (in-row)."""
    text = F.col(text_col)
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("bigint")
    kinds = F.col("_kinds")

    def n(kind):
        return F.size(F.filter(kinds, lambda k: k == kind)).cast("bigint")

    lo, hi = word_range
    return (docs.select(id_col, text, _kinds(text).alias("_kinds"))
            .select(id_col, words.alias("words"), text.rlike(SENTENCE_END).alias("ends_sentence"),
                    n("heading").alias("headings"), n("item").alias("items"),
                    n("paragraph").alias("paragraphs"))
            .withColumn("within_word_range", F.col("words").between(lo, hi)))


def section_items(blocks: DataFrame, id_col: str) -> DataFrame:
    """D-02 detail: list items per section (section = the last heading above)."""
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sec = F.last(F.when(F.col("kind") == "heading", F.col("content")), ignorenulls=True).over(w)
    tagged = blocks.withColumn("section", sec)
    return (tagged.where(F.col("section").isNotNull())
            .groupBy(id_col, "section")
            .agg(F.count(F.when(F.col("kind") == "item", 1)).alias("items")))


def item_ranges(docs: DataFrame, id_col: str, text_col: str,
                ranges: tuple[tuple[str, int, int], ...] = CLI_ITEM_RANGES) -> DataFrame:
    """D-02: list items of every required section against its range, one
    row per (document, required section); a missing section has 0 items,
    a repeated heading adds to its section.

    In-row, like the other text checks, and one pass over a document's lines:
    the running section is the last heading above, and an item adds to the
    count of its section if that is a required one.  A single map stage; the
    required sections are a literal array exploded per document."""
    names = F.array(*[F.lit(name) for name, _, _ in ranges])
    none = F.array(*[F.lit(0).cast("bigint")] * len(ranges))

    def step(acc, line):
        kind = line_kind(line)
        section = F.when(kind == "heading", F.array_position(names, F.substring(line, 4, 1 << 30)).cast("int"))
        return F.struct(
            F.coalesce(section, acc["section"]).alias("section"),
            F.when(kind == "item", F.transform(acc["n"], lambda n, i: F.when(
                i + 1 == acc["section"], n + 1).otherwise(n))).otherwise(acc["n"]).alias("n"))

    counts = F.coalesce(F.aggregate(_lines(F.col(text_col)), F.struct(
        F.lit(0).alias("section"), none.alias("n")), step)["n"], none)  # a null text has no lines

    def check(i, name, lo, hi):
        n = F.get("_n", F.lit(i))
        return F.struct(F.lit(name).alias("section"), n.alias("items"), F.lit(lo).alias("min_items"),
                        F.lit(hi).alias("max_items"), n.between(lo, hi).alias("within_range"))

    return (docs.select(id_col, counts.alias("_n"))
            .select(id_col, F.explode(F.array(*[check(i, *r) for i, r in enumerate(ranges)])).alias("c"))
            .select(id_col, "c.*"))


# ---- D-03 number grounding ------------------------------------------------

# a number not glued to a word character on its left (identifiers such as
# "NATION_11" or hex tokens are not numbers); group 2 is the number, group 3
# the word that scales it ("1,75 mi")
SCALES = {"mil": 1_000, "mi": 1_000_000, "milhão": 1_000_000, "milhões": 1_000_000,
          "bi": 1_000_000_000, "bilhão": 1_000_000_000, "bilhões": 1_000_000_000}
NUMBER = (r"(^|[^\w])(\d+(?:[.,]\d+)*)(?:[ \x{a0}](" + "|".join(sorted(SCALES, key=len, reverse=True))
          + r")(?:[^\p{L}\p{N}_]|$))?")
THOUSANDS_ONLY = r"^\d{1,3}(\.\d{3})+$"


def normalize_number(text: Column) -> Column:
    """pt-BR text -> decimal: with a comma, "." groups thousands and "," is
    the decimal mark; without one, "1.234.567" is grouped thousands and a
    single "." is a decimal point."""
    canon = (F.when(text.contains(","), F.translate(F.regexp_replace(text, r"\.", ""), ",", "."))
             .when(text.rlike(THOUSANDS_ONLY), F.regexp_replace(text, r"\.", ""))
             .otherwise(text))
    return canon.try_cast("decimal(38,6)")


def grounding_keys(values: DataFrame, value_col: str) -> DataFrame:
    """The accepted forms of every source number, (scale, key): as is, or in
    thousands, millions or billions, rounded or truncated to 2, 1 and 0
    decimals (reports do both)."""
    v = F.col(value_col).cast("decimal(38,6)")
    forms = [F.struct(F.lit(1).cast("bigint").alias("scale"), v.alias("key"))]
    for scale in sorted({1, *SCALES.values()}):
        x = (v / F.lit(scale)).cast("decimal(38,9)")
        for places in (0, 1, 2):
            cut = F.floor(x * 10 ** places).cast("decimal(38,6)") / F.lit(10 ** places)
            forms += [F.struct(F.lit(scale).cast("bigint").alias("scale"), y.cast("decimal(38,6)").alias("key"))
                      for y in (F.round(x, places), cut)]
    return (values.select(F.explode(F.array_distinct(F.array(*forms))).alias("k")).select("k.*")
            .where(F.col("key").isNotNull()).distinct())


def number_grounding(docs: DataFrame, id_col: str, text_col: str, keys: DataFrame) -> DataFrame:
    """D-03: every number in a text, normalised, flagged grounded when it
    equals an accepted form of a source number in its scale (left join on the
    value; ``keys`` is distinct, so the join never multiplies rows)."""
    text = F.col(text_col)
    numbers, words = (F.regexp_extract_all(text, F.lit(NUMBER), F.lit(g)) for g in (2, 3))
    nums = docs.select(id_col, F.posexplode(F.arrays_zip(numbers.alias("number_text"), words.alias("word")))
                       .alias("pos", "m")).select(id_col, "pos", "m.number_text", "m.word")
    scale = F.coalesce(F.try_element_at(F.create_map(*[x for w, n in SCALES.items() for x in (
        F.lit(w), F.lit(n).cast("bigint"))]), F.col("word")), F.lit(1).cast("bigint"))
    nums = nums.withColumn("value", normalize_number(F.col("number_text"))).withColumn("_scale", scale)
    k = keys.select("scale", "key", F.lit(True).alias("grounded"))
    return (nums.join(k, (nums["value"] == k["key"]) & (nums["_scale"] == k["scale"]), "left")
            .select(id_col, F.col("pos").cast("bigint").alias("pos"), "number_text",
                    F.col("value").cast("double").alias("value"), F.col("_scale").alias("scale"),
                    F.coalesce(F.col("grounded"), F.lit(False)).alias("grounded")))


# ---- D-03 derived numbers of named groups ------------------------------------

DERIVED = r"(\d+(?:[.,]\d+)*) ?(%|vezes|times)"
SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"


def _words(text: Column) -> Column:
    """Lower-cased words, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _is_cut(value: Column, above: Column, below: Column) -> Column:
    """Whether ``value`` is above / below, rounded or truncated to 0, 1 or 2
    decimals, in whole numbers."""
    hit = F.lit(False)
    for places in (0, 1, 2):
        n = above * F.lit(10 ** places).cast("decimal(38,0)")
        cut = F.floor(F.try_divide(n, below)).cast("decimal(38,0)")
        cut = F.when(cut * below > n, cut - 1).when((cut + 1) * below <= n, cut + 1).otherwise(cut)
        near = F.when((n - cut * below) * 2 >= below, cut + 1).otherwise(cut)
        v = value * 10 ** places
        hit = hit | (v == cut) | (v == near)
    return F.coalesce(hit, F.lit(False))


def derived_grounding(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame,
                      name_col: str, units_col: str) -> DataFrame:
    """D-03 for numbers derived from groups that their sentence names.

    ``groups`` has one row per group: its name and a whole-number amount.  A
    percentage must be the named groups' share of the total, a number of times
    ("vezes", "times") the ratio of the first named group to one of the others;
    rounded or truncated to 0, 1 or 2 decimals.  Names are found through an
    index of their first words, joined to the words of the sentences, and then
    compared whole; only groups of the sentence enter its sums and ratios, so a
    wrong list of groups is not grounded.  A sentence without a name grounds
    nothing; a group without a name is never named but counts in the total.

    Output: one row per number, with its sentence, place, kind (share, ratio)
    and the number of groups named."""
    text = F.col(text_col)
    sentences = (docs.select(id_col, F.posexplode(F.split(text, SENTENCE_BREAK)).alias("sentence", "_s"))
                 .where(F.col("_s").rlike(DERIVED)))
    numbers, kinds = (F.regexp_extract_all("_s", F.lit(DERIVED), F.lit(g)) for g in (1, 2))
    found = (sentences.select(id_col, "sentence", F.posexplode(
        F.arrays_zip(numbers.alias("number_text"), kinds.alias("unit"))).alias("pos", "m"))
        .select(id_col, "sentence", "pos", "m.number_text",
                F.when(F.col("m.unit") == "%", "share").otherwise("ratio").alias("kind")))

    units = F.col(units_col).cast("decimal(20,0)")
    amounts = groups.groupBy(F.col(name_col).alias("_name")).agg(F.sum(units).alias("_units"))
    # over () on one row per group
    names = (amounts.withColumn("_total", F.sum("_units").over(Window.partitionBy()))
             .withColumn("_key", _words(F.col("_name"))).where(F.length("_key") > 2)
             .withColumn("_first", F.split(F.trim("_key"), " ")[0]))
    words = sentences.select(id_col, "sentence", _words(F.col("_s")).alias("_w"))
    index = words.select(id_col, "sentence", "_w", F.explode(F.array_distinct(F.split(F.trim("_w"), " "))).alias("_first"))
    named = index.join(names, "_first").where(F.contains("_w", F.col("_key")))
    per_sentence = named.groupBy(F.col(id_col).alias("_id"), F.col("sentence").alias("_sent")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_units").alias("_sum"), F.max("_total").alias("_total"),
        F.array_sort(F.collect_list(F.struct(F.expr("locate(_key, _w)").alias("at"), F.col("_units").alias("u")))).alias("_u"))
    value = normalize_number(F.col("number_text"))
    joined = found.join(per_sentence, (F.col(id_col) == F.col("_id")) & (F.col("sentence") == F.col("_sent")), "left")
    share = _is_cut(F.col("_value"), F.col("_sum") * 100, F.col("_total"))
    ratio = F.exists(F.slice("_u", 2, 1 << 20), lambda o: _is_cut(F.col("_value"), F.col("_u")[0]["u"], o["u"]))
    grounded = F.when(F.col("kind") == "share", share).otherwise(ratio)
    return joined.withColumn("_value", value).select(
        id_col, F.col("sentence").cast("bigint").alias("sentence"), F.col("pos").cast("bigint").alias("pos"),
        "number_text", "kind", F.coalesce("_n", F.lit(0).cast("bigint")).alias("named"),
        F.coalesce(grounded, F.lit(False)).alias("grounded"))


# ---- C-10 report from findings ---------------------------------------------

def money_text(x: Column) -> Column:
    """R$-style amount with a decimal comma, from the exact decimal."""
    cents = (F.round(x.cast("decimal(38,4)"), 2) * 100).cast("bigint")
    return F.concat(F.lit("R$ "), F.when(cents < 0, F.lit("-")).otherwise(F.lit("")),
                    F.floor(F.abs(cents) / 100).cast("bigint").cast("string"), F.lit(","),
                    F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))


def percent_text(ratio: Column) -> Column:
    """A ratio as a percentage with two decimals and a decimal comma."""
    bp = (F.round(ratio.cast("decimal(38,6)") * 100, 2) * 100).cast("bigint")
    return F.concat(F.floor(bp / 100).cast("bigint").cast("string"), F.lit(","),
                    F.lpad((bp % 100).cast("string"), 2, "0"), F.lit("%"))


def build_report(lines: DataFrame, headings: tuple[str, ...]) -> DataFrame:
    """C-10: a Markdown report from the section headings and one frame of
    (sec, pos, line) rows, already bounded (top-k per section).  A section
    without lines keeps its heading.  Output: one row, column ``report``."""
    heads = lines.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("sec"), F.lit(-1).cast("bigint").alias("pos"),
                 F.lit(("\n" if i else "") + f"## {h}\n\n").alias("line"))
        for i, h in enumerate(headings)])))
    body = lines.select(F.col("sec").cast("int").alias("sec"), F.col("pos").cast("bigint").alias("pos"),
                        F.concat(F.col("line"), F.lit("\n")).alias("line"))
    return heads.unionByName(body).agg(
        F.expr("listagg(line, '') WITHIN GROUP (ORDER BY sec, pos)").alias("report"))
