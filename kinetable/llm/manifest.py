"""Operator 13: Merkle manifest of a dataset by a nested-struct rollup.

A document is a leaf, the SHA-256 of its fields. Within a language, leaves ascend by doc_id and runs of eight become their
parent until one node, the subroot, is left; subroots ordered by language give the root in the same way.

The rank of a leaf is written in digits of base eight, and ranks that share all but the last ``LEVELS`` digits are one block.
Blocks are the shuffle key. Inside a block the digits are grouped away one by one, the children of a node being nested in
its struct, so a block ends as one row with a tree of 8**LEVELS leaves at most. Block nodes are the leaves of the next tier,
whose blocks hold nothing but digests, until a language has one block. Proofs go down again without joins: a tier's blocks and
what the tier above knows about them are put together by one grouping, and the nested children are exploded level by level,
each taking along its siblings' digests. Ranks come from a range-partitioned sort, so no language is ever in one task.

Defined cases: a null field counts as ``-``; an empty text is ``0:``; leaves with equal or null ids (nulls first) are ordered by
their digest, and repeated rows are leaves of their own; a null language is the first one; a language of one document has
its leaf as subroot; one language alone has its subroot as root; an empty table gives no rows. Only the five columns of the
contract are read, so further columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stored, table

FAN = 8
#: Digits that are grouped away inside one block.
LEVELS = 4
_BLOCK = FAN**LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(text: Column) -> Column:
    """Digest of a row of documents with this text."""
    field = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    one = (F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text)
    return F.sha2(F.concat(*map(field, one)), 256)


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """(g, doc_id, leaf, altered): ``g`` names the language, ordered like it; ``altered`` is another leaf to be held against the proof."""
    g = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    return docs.select(g.alias("g"), "doc_id", leaf_digest(F.col("text")).alias("leaf"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (stored) with their rank from 0 within g and the size n of g: a row's place in its range partition, less the
    place at which its group starts there, plus the group's rows in earlier partitions."""
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("_at", 33)), "manifest-places")
    parts = placed.groupBy("g", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of_g = Window.partitionBy("g")
    before = F.coalesce(F.sum("_n").over(of_g.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("g", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of_g).alias("n"))
    return placed.join(starts, ["g", "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(g, block, n, node) from (g, n, rank, node): each block's digits grouped away, its tree nested in ``node``."""
    digits = [F.expr(f"cast(rank div {FAN**i} % {FAN} as int)").alias(f"d{i}") for i in range(LEVELS)]
    rows = nodes.select("g", "n", F.expr(f"rank div {_BLOCK}").alias("block"), *digits, "node").repartition("g", "block")
    for level in range(LEVELS):
        keys = ["g", "block", "n", *(f"d{i}" for i in range(level + 1, LEVELS))]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{level}").alias("d"), "node")))
        digests = F.transform("kids", lambda k: k["node"]["h"])
        h = F.when(F.col("n") > FAN**level, F.sha2(F.array_join(digests, ""), 256)).otherwise(digests[0])
        rows = rows.groupBy(*keys).agg(kids.alias("kids")).select(*keys, F.struct(h.alias("h"), "kids").alias("node"))
    return rows


def _grown(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of every tier, the lowest first; in the last one each g has one block, whose digest is that of g."""
    tiers, most = [], None
    while most is None or most > 1:
        tiers.append(stored(_rolled(nodes), f"manifest-{name}"))
        above = F.expr(f"(n + {_BLOCK - 1}) div {_BLOCK}")
        nodes = tiers[-1].select("g", above.alias("n"), F.col("block").alias("rank"), F.struct("node.h").alias("node"))
        most = nodes.agg(F.max("n")).first()[0] or 0
    return tiers


def _met(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks with what the tier above knows about them (g, block, up), put together by a grouping."""
    void = lambda c, like: F.lit(None).cast(like.schema[c].dataType).alias(c)
    both = blocks.select("g", "block", "n", "node", void("up", known)).unionByName(known.select("g", "block", void("n", blocks), void("node", blocks), "up"))
    return both.groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "up")))


def _unrolled(blocks: DataFrame) -> DataFrame:
    """(g, rank, node, up) of a tier's nodes; ``up.path`` has been given the siblings within the block, the lowest level first."""
    rows = blocks.select("g", "n", F.col("block").alias("rank"), "node", F.col("up.path").alias("path"), F.col("up").dropFields("path").alias("of"))
    for level in reversed(range(LEVELS)):
        rows = rows.select("g", "n", "rank", "path", "of", F.transform("node.kids", lambda k: k["node"]["h"]).alias("hs"), F.posexplode("node.kids").alias("i", "kid"))
        left, right = F.slice("hs", F.lit(1), F.col("i")), F.slice("hs", F.col("i") + 2, F.lit(FAN))
        sides = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
        path = F.when(F.col("n") > FAN**level, F.concat(F.array(sides), "path")).otherwise(F.col("path"))
        rows = rows.select("g", "n", (F.col("rank") * FAN + F.col("kid.d")).alias("rank"), path.alias("path"), "of", F.col("kid.node").alias("node"))
    return rows.select("g", "rank", "node", F.struct("path", "of.*").alias("up"))


def _down(tiers: list[DataFrame], known: DataFrame | None) -> DataFrame:
    """Nodes of the lowest tier with all siblings up to the root. ``known`` (g, block, up) is about the last tier's blocks; without it
    that is the root's own."""
    for blocks in reversed(tiers):
        if known is None:
            void = F.array().cast("array<struct<left: string, right: string>>")
            rows = _unrolled(blocks.withColumn("up", F.struct(void.alias("path"), F.col("node.h").alias("root"))))
        else:
            rows = _unrolled(_met(blocks, known))
        known = rows.select("g", F.col("rank").alias("block"), "up")
    return rows


def proofs(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, altered, subroot, root, path) from ``leaves``: ``path`` has for each level from the leaf to the root
    the siblings' digests to its left and to its right, joined."""
    at = stored(rows.withColumn("at", F.monotonically_increasing_id()), "manifest-leaves")
    ranked = _ranked(at, ["doc_id", "leaf", "at"])
    trees = _grown(ranked.select("g", "n", "rank", F.struct(F.col("leaf").alias("h"), "doc_id", "altered").alias("node")), "blocks")
    discard(rows.sparkSession, at)
    subroots = stored(trees[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("node.h").alias("h")), "manifest-subroots")
    crown = _grown(_ranked(subroots, ["name"]).select("g", "n", "rank", F.struct("h", "name").alias("node")), "crown")
    named = _down(crown, None).select(F.col("node.name").alias("g"), F.lit(0).cast("long").alias("block"), F.struct("up.path", "up.root", F.col("node.h").alias("subroot")).alias("up"))
    lang = F.when(F.col("g") != "", F.expr("substr(g, 2)"))
    return _down(trees, named).select("node.doc_id", lang.alias("lang"), F.col("node.h").alias("leaf"), "node.altered", "up.subroot", "up.root", "up.path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot, root, digest of its proof, and the root that the proof gives after every third text is lower-cased."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(F.translate("text", _UPPER, _LOWER)))
    out = proofs(leaves(table(spark, sf_dir, "documents"), tampered))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path"))).withColumn("proof_sha256", F.sha2(siblings, 256))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _oracle(levels: int = 9) -> str:
    """The same by whole levels, for up to 8**levels rows a language and languages."""
    field = lambda c: f"coalesce(strlen({c})::varchar || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({field('doc_id::varchar')} || {field('source')} || {field('lang')} || {field('n_chars::varchar')} || {field(text)})"
    bits = "flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: list_transform(range(0, 8), lambda b: (ascii(substr(doc_id::varchar, i::int, 1)) >> b::int)::bigint & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"

    def tree(name: str) -> list[str]:
        """CTEs of the levels: (g, i, h, m) with the siblings to the left and right, ``m`` nodes a level."""
        steps = []
        for k in range(levels):
            kin = f"over (partition by g, i // {FAN} order by i rows between"
            sides = f"coalesce(string_agg(h, '') {kin} unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') {kin} 1 following and unbounded following), '') as r"
            steps.append(f"{name}{k}s as (select *, {sides} from {name}{k})")
            steps.append(f"{name}{k + 1} as (select g, i // {FAN} as i, sha256(string_agg(h, '' order by i)) as h, (m + {FAN - 1}) // {FAN} as m from {name}{k} where m > 1 group by all)")
        return steps

    joins = "".join(f" left join n{k}s p{k} on p{k}.m > 1 and p{k}.g = d.g and p{k}.i = d.i // {FAN**k}" for k in range(levels))
    joins += " join u0 q on q.name = d.g" + "".join(f" left join u{k}s q{k} on q{k}.m > 1 and q{k}.i = q.i // {FAN**k}" for k in range(levels))
    folded_sql, every = "coalesce(d.altered, d.h)", []
    for t in [f"p{k}" for k in range(levels)] + [f"q{k}" for k in range(levels)]:
        every.append(f"coalesce({t}.l || {t}.r, '')")
    chain, last = [], "e"
    for step, t in enumerate([f"p{k}" for k in range(levels)] + [f"q{k}" for k in range(levels)]):
        chain.append(f"f{step} as (select * exclude f, case when {t}_l is null then f else sha256({t}_l || f || {t}_r) end as f from {last})")
        last = f"f{step}"
    sides = ", ".join(f"{t}{k}.l as {t}{k}_l, {t}{k}.r as {t}{k}_r" for t in "pq" for k in range(levels))
    ctes = [
        f"a as (select doc_id, coalesce('=' || lang, '') as g, {leaf('text')} as h, case when {crc} % 3 = 0 then {leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} end as altered from documents)",
        "d as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as m from a)",
        "n0 as (select g, i, h, m from d)", *tree("n"),
        "top as (" + " union all ".join(f"select g as name, h from n{k} where m = 1" for k in range(levels + 1)) + ")",
        "u0 as (select '' as g, name, h, row_number() over (order by name) - 1 as i, count(*) over () as m from top)", *tree("u"),
        "rt as (" + " union all ".join(f"select h from u{k} where m = 1" for k in range(levels + 1)) + ")",
        f"e as (select d.doc_id, d.h as leaf, q.h as subroot, sha256({' || '.join(every)}) as proof_sha256, {folded_sql} as f, {sides} from d{joins})", *chain,
    ]
    return f"with {', '.join(ctes)} select doc_id, leaf, subroot, rt.h as root, proof_sha256, f as folded_root, f = rt.h as verified from {last}, rt"


QUERIES = {"op13_manifest": op13_manifest}
ORACLES = {"op13_manifest": _oracle()}
