"""Operator 3: line dedup by a log-template tree, with DataFrame functions only.

Lines are parsed to a fixed depth: count of the tokens between spaces (or tabs, carriage returns, form feeds), then the leading
``DEPTH`` tokens, tokens with a digit standing for a field (``<*>``). In a leaf that occurs in at least ``MIN_DOCS`` documents, a
later position whose most frequent token covers more than half of the leaf's lines is constant and any other position a
variable field; a line follows the leaf's template if at least ``SIMILAR`` tenths of its later tokens are the constants. A line
that doesn't, but recurs itself, is a template of its own. A template
that recurs in ``MIN_DOCS`` documents is dropped from all of them but the first (lowest id).
Besides, a line whose tokens are exactly the same, digits too, in ``EXACT_DOCS`` documents is dropped from all but the first:
only what is generalised needs a third document. A template's first line is also the first of its exact copies, so one stays.

A line of at most ``DEPTH`` tokens is all prefix, so its leaf is its template: "Page 7" recurs as "Page <*>". That needs a field to
generalise and a token that stays; a short line of fields only ("12"), one without a field, and a line of a script without
spaces, which is one token, recur by the exact rule only.

Copies are merged to one row per distinct line before its tokens are counted, every grouping has a partial step, and the
rows of a hot line or leaf are spread over the tasks when they meet what was counted.

Defined cases: a null text stays null; blank lines are kept, all others count, however short; a repeated line of one
document counts as one document; rows that share an id are one document for counting and are cut each by its own text;
a null id counts as the id -1; an empty table gives an empty result. All columns are kept; extra columns may have
any name (those used inside start with ``_ld_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, prepare, spread_join, stored, table

DEPTH = 3
MIN_DOCS = 3
EXACT_DOCS = 2
SIMILAR = 6
#: Words of the bit table (a power of two): six MB in all.
WORDS = 1 << 18


def _lines(docs: DataFrame) -> DataFrame:
    """(d, h, line_no, leaf, lid, exact, line): parsed lines, with fields masked; leaf, lid and exact are hashes, exact without a mask.
    Short lines without a field or without any other token have only exact."""
    spaced = F.col("text")
    for blank in "\t\r\f":
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))  # a split at one character takes no regular expression
    keyed = docs.where("text is not null").select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text").alias("h"), spaced.alias("text"))
    lines = keyed.select("d", "h", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    tokens = F.filter(F.split("raw", " "), lambda t: t != "")
    masked = F.when(F.col("raw").rlike("[0-9]"), F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t))).otherwise(tokens)
    parsed = lines.select("d", "h", "line_no", F.xxhash64(F.array_join(tokens, " ")).alias("exact"), masked.alias("tokens")).where(F.size("tokens") > 0)
    line = F.array_join("tokens", " ")
    tree = {"leaf": F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)), "lid": F.xxhash64(line), "line": line}
    field = F.array_contains("tokens", "<*>")
    general = (F.size("tokens") > DEPTH) | (field & F.exists("tokens", lambda t: t != "<*>"))
    leaf, lid, line = (F.when(general, c).alias(name) for name, c in tree.items())
    return parsed.select("d", "h", "line_no", leaf, lid, "exact", line)


def _classes(lines: DataFrame) -> DataFrame:
    """(leaf, lid, template, n): the template of every line that has one, its leaf's or the line's own, and the line's copies."""
    distinct = stored(lines.groupBy("leaf", "lid").agg(F.count(F.lit(1)).alias("c"), F.first("line").alias("line")), "line-distinct")
    tokens = distinct.select("leaf", "lid", "c", F.posexplode(F.split("line", " ")).alias("pos", "tok")).where(F.col("pos") >= DEPTH)
    leaves = distinct.groupBy("leaf").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("n"))
    # at most one token of a place covers more than half, so a leaf has one row with the constants of its places
    often = tokens.groupBy("leaf", "pos", "tok").agg(F.sum("c").alias("k")).groupBy("leaf", "pos").agg(F.max(F.struct("k", "tok")).alias("most"))
    constants = often.join(leaves.select("leaf", "total"), "leaf").where("2 * most.k > total").groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("pos", "most.tok"))).alias("constant"))
    constants = stored(leaves.join(constants, "leaf", "left"), "line-constants")
    split = F.split("line", " ")
    hits = F.size(F.filter(F.transform(split, lambda t, i: F.when(F.col("constant")[i] == t, 1)), lambda x: x.isNotNull()))
    docs = lines.select("leaf", "lid", "d").distinct().groupBy("leaf", "lid").agg(F.count(F.lit(1)).alias("docs"))
    found = spread_join(distinct, constants, ["leaf"], "n", distinct.count()).select("leaf", "lid", "c", F.size(split).alias("size"), F.coalesce(hits, F.lit(0)).alias("hits"))
    follows = 10 * F.col("hits") >= SIMILAR * (F.col("size") - DEPTH)
    found = found.join(docs, ["leaf", "lid"]).where(follows | (F.col("docs") >= MIN_DOCS))
    found = stored(found.select("leaf", "lid", F.when(follows, F.xxhash64("leaf")).otherwise(F.xxhash64("leaf", "lid")).alias("template"), F.col("c").alias("n")), "line-classes")
    discard(lines.sparkSession, distinct, constants)
    return found


def _repeats(lines: DataFrame) -> DataFrame:
    """(d, h, line_no): lines that stand in ``EXACT_DOCS`` documents, without the first of each."""
    assert EXACT_DOCS == 2  # two documents have two ids, so that the least and the greatest tell
    at = F.struct("d", "h", "line_no")
    often = lines.groupBy("exact").agg(F.min(at).alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first.d < last")
    often = stored(often.select("exact", "first", "n"), "line-exact")
    return spread_join(lines.select("exact", "d", "h", "line_no"), often, ["exact"], "n", lines.count()).where(at != F.col("first")).select("d", "h", "line_no")


def _perhaps(rows: DataFrame, often: DataFrame) -> DataFrame:
    """``rows`` without most of those whose leaf isn't in ``often``: these have no bit in a table of ``WORDS`` words of 64 bits, which is all that is
    broadcast, however many leaves there are. It only saves lines that nothing will come of from the shuffle."""
    word, bit = F.shiftrightunsigned("leaf", 64 - WORDS.bit_length() + 1).alias("_word"), F.col("leaf").bitwiseAND(63).cast("int")
    # shifts by a column are SQL only
    marks = often.select(word, bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    met = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(marks), "_word").where(F.expr("(shiftrightunsigned(_bits, _bit) & 1) = 1"))
    return met.select(*rows.columns)


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(d, h, drop array<int>): line numbers to drop from the text of hash h of the document d."""
    spark = docs.sparkSession
    parsed = stored(_lines(docs), "line-parsed")
    repeats = _repeats(parsed)
    parsed = parsed.where("leaf is not null").drop("exact")
    total = parsed.count()
    often = parsed.select("leaf", "d").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= MIN_DOCS).select("leaf")
    sizes = parsed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    often = stored(often.join(sizes, "leaf"), "line-often")
    lines = stored(spread_join(_perhaps(parsed, often), often, ["leaf"], "n", total), "line-leaves")
    classes = _classes(lines)
    found = spread_join(lines.select("d", "h", "line_no", "leaf", "lid"), classes, ["leaf", "lid"], "n", lines.count()).select("template", "d", "h", "line_no")
    found = stored(found, "line-templates")
    discard(spark, often, lines, classes)
    by_doc = found.groupBy("template", "d").agg(F.min(F.struct("h", "line_no")).alias("at"), F.count(F.lit(1)).alias("n"))
    often = by_doc.groupBy("template").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min(F.struct("d", "at")).alias("first")).where(F.col("docs") >= MIN_DOCS)
    often = often.select("template", "n", F.col("first.d").alias("_d"), F.col("first.at.h").alias("_h"), F.col("first.at.line_no").alias("_line"))
    often = stored(often, "line-first")
    drop = spread_join(found, often, ["template"], "n", found.count()).where("not (d = _d and h = _h and line_no = _line)").select("d", "h", "line_no").unionAll(repeats)
    return drop.groupBy("d", "h").agg(F.collect_set("line_no").alias("drop"))


def line_dedup(docs: DataFrame, counted: bool = False) -> DataFrame:
    """``docs`` with the lines of recurring templates cut from ``text``; ``counted`` adds n_lines and n_dropped."""
    prepare(docs.sparkSession)
    drop = recurring_lines(docs.select("doc_id", "text")).select(F.col("d").alias("_ld_d"), F.col("h").alias("_ld_h"), F.col("drop").alias("_ld_drop"))
    rows = docs.withColumns({"_ld_id": F.coalesce("doc_id", F.lit(-1)), "_ld_hash": F.xxhash64("text")})
    rows = rows.join(drop, (F.col("_ld_id") == F.col("_ld_d")) & (F.col("_ld_hash") == F.col("_ld_h")), "left")
    lines = F.split("text", "\n")
    # kept and dropped numbers in order beside the lines: no line looks through all dropped ones
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_ld_drop"))
    mark = lambda numbers, kept: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(kept).alias("kept")))
    beside = F.arrays_zip(lines.alias("line"), F.array_sort(F.concat(mark(stay, True), mark(F.col("_ld_drop"), False))).alias("at"))
    kept = F.array_join(F.transform(F.filter(beside, lambda z: z["at"]["kept"]), lambda z: z["line"]), "\n")
    text = F.when(F.col("_ld_drop").isNull() | F.col("text").isNull(), F.col("text")).otherwise(kept)
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counted:
        columns += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_ld_drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return rows.select(*columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counted=True)
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("kept_text"), F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_dropped")


#: Lines of a relation docs(doc_id, text) to drop: (d, line_no).
ORACLE_DROP = r"""
lines AS (SELECT doc_id AS d, unnest(range(len(s))) AS line_no, unnest(s) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM docs WHERE text IS NOT NULL)
), parsed AS (
  SELECT d, line_no, list_transform(list_filter(string_split_regex(raw, '[ \t\r\f]+'), lambda x: x <> ''), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS w, array_to_string(list_filter(string_split_regex(raw, '[ \t\r\f]+'), lambda x: x <> ''), ' ') AS exact FROM lines
), keyed AS (
  SELECT d, line_no, len(w) AS n, concat_ws(' ', CAST(len(w) AS VARCHAR), array_to_string(w[1:3], ' ')) AS leaf, array_to_string(w, ' ') AS line FROM parsed WHERE len(w) > 3 OR (list_contains(w, '<*>') AND len(list_filter(w, lambda x: x <> '<*>')) > 0)
), hot AS (SELECT leaf FROM keyed GROUP BY leaf HAVING count(DISTINCT d) >= 3
), lv AS (SELECT * FROM keyed WHERE leaf IN (SELECT leaf FROM hot)
), dl AS (SELECT leaf, line, n, count(*) AS c, count(DISTINCT d) AS docs FROM lv GROUP BY ALL
), tok AS (SELECT leaf, line, c, unnest(range(len(s))) AS pos, unnest(s) AS t FROM (SELECT leaf, line, c, string_split(line, ' ') AS s FROM dl)
), later AS (SELECT * FROM tok WHERE pos >= 3
), totals AS (SELECT leaf, sum(c) AS total FROM dl GROUP BY leaf
), constants AS (SELECT leaf, pos, t FROM later JOIN totals USING (leaf) GROUP BY leaf, pos, t, total HAVING 2 * sum(c) > total
), hits AS (SELECT leaf, line, count(*) AS hits FROM later JOIN constants USING (leaf, pos, t) GROUP BY leaf, line
), classes AS (
  SELECT leaf, line, CASE WHEN 10 * coalesce(hits, 0) >= 6 * (n - 3) THEN '' ELSE line END AS own
  FROM dl LEFT JOIN hits USING (leaf, line) WHERE 10 * coalesce(hits, 0) >= 6 * (n - 3) OR docs >= 3
), found AS (SELECT leaf, own, d, line_no FROM lv JOIN classes USING (leaf, line)
), often AS (SELECT leaf, own, min((d, line_no)) AS first FROM found GROUP BY leaf, own HAVING count(DISTINCT d) >= 3
), copies AS (SELECT exact, d, line_no FROM parsed WHERE len(w) > 0
), twice AS (SELECT exact, min((d, line_no)) AS first FROM copies GROUP BY exact HAVING count(DISTINCT d) >= 2
), dropped AS (
  SELECT d, line_no FROM found JOIN often USING (leaf, own) WHERE (d, line_no) <> first
  UNION SELECT d, line_no FROM copies JOIN twice USING (exact) WHERE (d, line_no) <> first
)"""

ORACLE = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {ORACLE_DROP},
cut AS (
  SELECT d, string_agg(raw, chr(10) ORDER BY line_no) AS kept FROM lines ANTI JOIN dropped USING (d, line_no) GROUP BY d
), n AS (SELECT d, count(*) AS n_dropped FROM dropped GROUP BY d)
SELECT doc_id, coalesce(kept, '') AS kept_text, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM docs LEFT JOIN cut ON doc_id = cut.d LEFT JOIN n ON doc_id = n.d
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {"op3_line_dedup": ORACLE}
