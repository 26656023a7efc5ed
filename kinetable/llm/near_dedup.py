"""Operator 1: near-duplicates by BagMinHash.

A text is the multiset of its 5-word shingles (words as in ``decontaminate``). Its signature is a weighted MinHash: for each
shingle a Poisson process runs over (time, weight) and drops its events into registers at random; only events below the
shingle's count belong to it, and a register keeps the first. The weight axis is discretised in dyadic blocks [0,1), [1,2),
[2,4), ..., each with a process of its own, so a count adds blocks and a partial block is thinned by the event's place in
it: two registers agree with probability Σmin/Σmax exactly. (So the hierarchy is one of blocks, not of one process split down a
tree.) Events after the time at which all registers are expected to be filled are never made; a text whose registers aren't
full by then is run again with twice the time.

Signatures are cut into bands. Texts with equal multisets are one node. In each bucket all nodes are linked to two leaders
(the most popular node and one by chance, other ones in each band), and the links are verified on the multisets
(Σmin/Σmax >= 0.8) and joined to components. Links it may have missed can only be between nodes of one bucket in different
components. So the nodes outside of a bucket's largest component are compared with all of its nodes, block by block
inside small tasks, which return only links, and no candidate link is lost. That work is linear in the copies of one text;
it grows with the square only of nodes of one bucket that are unlike each other.

Defined cases: texts without words (null, empty) are one class; a text of 1 to 4 words has one shingle of all of them; rows that
share an id are told apart by their text, and the least id of a class is its class_id (null only if no row of it has an id);
an empty table gives an empty result. ``near_dedup`` keeps all columns, whatever their names (those inside start with _nd_).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, discard, prepare, regrouped, release, spread_join, stored, table
from .components import components
from .decontaminate import grams, mix, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
_REGISTERS = BANDS * ROWS
_SLACK = 4.0
#: Nodes of a block when the nodes of a bucket are compared with each other.
BLOCK = 128
_BATCH_BYTES = 2 << 20
#: A row: its id is null, id (or -1), hash of the text.
_KEY = ["z", "d", "h"]
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all shingles of concatenated texts, in the order of the texts."""
    words, bounds = word_hashes(data, offsets)
    count = np.diff(bounds)
    h = grams(words, bounds, n)
    doc = np.repeat(np.arange(len(count)), count)
    whole = np.arange(len(words)) + n <= np.repeat(bounds[1:], count)
    docs, hashes = [doc[whole]], [h[whole]]
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            docs.append(short)
            hashes.append(mix(grams(words, bounds, m)[bounds[:-1][short]] + _U(m)))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order]


def multisets(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of the distinct shingles of each text."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.r_[first, len(h)])


def _blocks(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element, block) of the dyadic blocks that the weights reach into: block 0 is [0,1), block j is [2^(j-1), 2^j)."""
    n = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    element = np.repeat(np.arange(len(weight)), n)
    return element, np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = _REGISTERS) -> np.ndarray:
    """Times of the first events, (n_docs, registers); texts without shingles keep infinite times."""
    sig = np.full(n_docs * registers, np.inf)
    total = np.bincount(doc, weight, n_docs)
    limit = registers / np.maximum(total, 1) * (np.log(registers) + _SLACK)
    open_docs = total > 0
    element, block = _blocks(weight)
    seed = mix(h[element] + _U(0x9E3779B97F4A7C15) * (block + 1).astype(np.uint64))
    low = np.where(block > 0, np.exp2(block - 1.0), 0.0)
    rate = np.where(block > 0, low, 1.0)
    while open_docs.any():
        mine = open_docs[doc[element]]
        s, d, r, lo, w = seed[mine], doc[element][mine], rate[mine], low[mine], weight[element][mine].astype(float)
        t, step = np.zeros(len(s)), 0
        while len(s):
            step += 1
            x = mix(s + _U(step * 0xD1B54A32D192ED03 % 2**64))
            t = t - np.log(_uniform(x)) / r
            on = t <= limit[d]
            s, d, r, lo, w, t, x = s[on], d[on], r[on], lo[on], w[on], t[on], x[on]
            x = mix(x + _U(0x8CB92BA72F3D8DD7))
            register = ((x >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
            inside = lo + r * _uniform(mix(x ^ _U(0xA0761D6478BD642F))) < w
            np.minimum.at(sig, d[inside] * registers + register[inside], t[inside])
        open_docs &= ~np.isfinite(sig.reshape(n_docs, registers)).all(1)
        limit = limit * 2
        sig.reshape(n_docs, registers)[open_docs] = np.inf
    return sig.reshape(n_docs, registers)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands): a hash of each band's registers."""
    bits = mix(np.ascontiguousarray(sig).view(np.uint64)).reshape(len(sig), bands, -1)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        out = mix(out * _U(0xD1B54A32D192ED03) + bits[:, :, k])
    return out


def _key_columns() -> list[Column]:
    return [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(-1)), F.xxhash64("text")]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*(c.alias(k) for c, k in zip(_key_columns(), _KEY, strict=True)), F.coalesce("text", F.lit("")).alias("text"))


def _signed(keyed: DataFrame) -> DataFrame:
    """(z, d, h, node binary(16) naming the multiset, size, bands) of every text."""

    def run(batches):
        for part in regrouped(batches, _BATCH_BYTES):
            n = part.num_rows
            doc, h = shingles(*byte_column(part.column("text")))
            a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            np.add.at(a, doc, mix(h + _U(1)))
            np.add.at(b, doc, mix(h + _U(0x632BE59BD9B4E019)))
            size = np.bincount(doc, minlength=n)
            doc, h, count = multisets(doc, h)
            keys = band_keys(signatures(doc, h, count, n)).view(np.int64)
            node = np.stack([mix(a + size.astype(np.uint64)), mix(b + size.astype(np.uint64))], 1)
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(node.tobytes())])
            some = np.where(size > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some)].astype(np.int32)), pa.array(keys[size > 0].ravel()))
            yield from pa.table([*(part.column(k) for k in _KEY), raw, pa.array(size.astype(np.int64)), lists], [*_KEY, "node", "size", "bands"]).to_batches()
        release()

    return keyed.mapInArrow(run, "z boolean, d long, h long, node binary, size long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes whose multisets are at least ``similarity`` similar."""

    def run(batches):
        for part in regrouped(batches, 2 * _BATCH_BYTES, "text_a"):
            n = part.num_rows
            found = []
            for side, name in enumerate(("text_a", "text_b")):
                doc, h = shingles(*byte_column(part.column(name)))
                found.append((doc, h, np.full(len(doc), side)))
            pair, h, side = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((h, pair))
            pair, h, side = pair[order], h[order], side[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])
            first = np.flatnonzero(new)
            b = np.add.reduceat(side, first) if len(first) else side
            a = np.diff(np.r_[first, len(h)]) - b
            low, high = (np.bincount(pair[first], f(a, b), n) for f in (np.minimum, np.maximum))
            yield from part.select(["a", "b"]).filter(pa.array(low >= similarity * high)).to_batches()

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _compared(placed: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of one group (b, node, root) with different roots, of which one at least is outside of the
    group's largest component ``top``, which has all of its ``n`` nodes but ``others``.

    Both sides are cut into blocks of about ``BLOCK`` nodes; each pair of blocks is one small task of its own, and only links
    leave it. Multisets become sets of (shingle, occurrence), so all overlaps of two blocks are one matrix product."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), blocks(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    rows = placed.join(texts, "node")
    left = rows.where("root <> top").select("b", "node", "root", "text", F.lit(True).alias("outside"), block("others").alias("i"), F.explode(all_of("n")).alias("j"))
    right = rows.select("b", "node", "root", "text", F.lit(False).alias("outside"), F.explode(all_of("others")).alias("i"), block("n").alias("j"))
    rows = left.unionByName(right)

    def compare(part: pa.Table) -> pa.Table:
        n = part.num_rows
        doc, h = shingles(*byte_column(part.column("text")))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        element = mix(h + (np.arange(len(h)) - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        _, column, count = np.unique(element, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        size = np.bincount(doc, minlength=n)
        doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
        overlap = np.zeros((n, n), np.float32)
        for start in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
            inside = (column >= start) & (column < start + 4096)
            m = np.zeros((n, 4096), np.float32)
            m[doc[inside], column[inside] - start] = 1
            overlap += m @ m.T
        alike = overlap >= similarity * (size[:, None] + size[None, :] - overlap) - 1e-6
        root = np.unique(np.array(part.column("root").to_pylist(), object), return_inverse=True)[1] if n else np.zeros(0, int)
        outside = part.column("outside").to_numpy()
        alike &= (root[:, None] != root[None, :]) & (outside[:, None] & ~outside[None, :])
        x, y = np.nonzero(alike)
        node = part.column("node")
        return pa.table([node.take(pa.array(x)), node.take(pa.array(y))], ["a", "b"])

    return rows.groupBy("b", "i", "j").applyInArrow(lambda t: compare(t), "a binary, b binary")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """((z, d, h, node, class_id, class_h) of every text, verified links (a, b) between nodes)."""
    spark = docs.sparkSession
    prepare(spark)
    keyed = _keyed(docs)
    signed = stored(_signed(keyed), "near-signatures")
    nodes = signed.groupBy("node").agg(F.min(F.struct(*_KEY)).alias("at"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes, "near-nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("key"))
    total = BANDS * nodes.count()

    # two leaders a bucket: the node that shares most buckets (the centre of a group of copies), and one by chance
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("w", F.col("n")), "near-sizes")
    in_bucket = stored(spread_join(members, sizes, ["key"], "n", total), "near-buckets")
    popular = in_bucket.groupBy("node").agg(F.sum("w").alias("p"))
    rank = lambda *first: F.max(F.struct(*first, F.xxhash64("node", "key").alias("r"), F.col("node").alias("b"), F.col("size").alias("s")))
    leaders = in_bucket.join(popular, "node").groupBy("key").agg(F.first("w").alias("n"), F.array(rank("p").dropFields("p"), rank()).alias("leaders"))
    leaders = stored(leaders, "near-leaders")
    led = spread_join(in_bucket, leaders, ["key"], "n", total).select("node", "size", F.posexplode("leaders").alias("which", "l"))
    led = stored(led.select("node", "size", "which", "l.b", "l.s").distinct(), "near-led")
    groups = led.where("which = 0").select("b", "node")  # nodes that share a bucket share its popular leader
    pairs = led.where((F.col("node") != F.col("b")) & _fits("size", "s", similarity)).select(F.col("node").alias("a"), "b")
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")

    # the text of each node that shares a bucket, from one of its documents
    wanted = in_bucket.select("node").distinct().join(nodes.select("node", *(f"at.{k}" for k in _KEY)), "node")
    one_each = keyed.join(wanted, _KEY).select("node", "text").dropDuplicates(["node"])
    texts = stored(one_each, "near-texts")
    discard(spark, sizes, in_bucket, leaders)
    links = stored(_verified(pairs, texts, similarity), "near-links")
    roots = components(links)

    # nodes of one bucket that are in different components have not been compared with each other yet
    placed = stored(groups.join(roots, "node", "left").select("b", "node", F.coalesce("root", "node").alias("root")), "near-placed")
    parts = placed.groupBy("b", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("b").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top"))
    parts = parts.where("n > top.c").select("b", "n", F.col("n").alias("_n"), (F.col("n") - F.col("top.c")).alias("others"), F.col("top.root").alias("top"))
    parts = stored(parts, "near-parts")
    rest = spread_join(placed, parts, ["b"], "_n", placed.count())
    both = stored(links.unionByName(_compared(rest, texts, similarity)), "near-links")
    discard(spark, led, pairs, texts, placed, parts, links, roots)
    roots = components(both)

    rooted = nodes.select("node", "at", "copies").join(roots, "node", "left").select("node", "at", "copies", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "near-roots")
    heads = rooted.groupBy("root").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n"))
    classes = spread_join(rooted, heads, ["root"], "n", rooted.count()).select("node", "copies", *(F.col(f"head.{k}").alias(f"class_{k}") for k in _KEY))
    classes = stored(classes, "near-classes")
    discard(spark, nodes, roots, rooted)
    out = spread_join(signed.select(*_KEY, "node"), classes, ["node"], "copies", signed.count())
    return out.withColumn("class_id", F.when(~F.col("class_z"), F.col("class_d"))), both


def _fits(a: str, b: str, similarity: float) -> Column:
    """Sizes that allow the similarity at all."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each class: that with the least id (a null last), then the least hash of the text."""
    classes, _ = near_duplicates(docs.select("doc_id", "text"), similarity)
    own = [f"_nd_{k}" for k in _KEY]
    heads = classes.where(" and ".join(f"{k} = class_{k}" for k in _KEY)).select(*(F.col(k).alias(o) for k, o in zip(_KEY, own, strict=True))).distinct()
    rows = docs.withColumns(dict(zip(own, _key_columns(), strict=True)))
    kept = rows.join(heads, own, "left_semi").dropDuplicates(own)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select(F.when(~F.col("z"), F.col("d")).alias("doc_id"), "class_id", F.col("d").eqNullSafe(F.col("class_id")).alias("kept"))


QUERIES = {"op1_near_dedup": op1_near_dedup}
ORACLES: dict[str, str] = {}
