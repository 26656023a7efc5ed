"""Operator 10: repeated 200-byte strings, by distributed prefix doubling.

A rank stands for a string's class: r1 are the bytes' ranks, and r2h of a place comes from the pair (rh, rh of the place
h further), up to r64; r128 and r200 come from overlapping pairs. Ranks are 64-bit hashes of those pairs, so they are the
same in every task and no pass over the corpus is needed to number them; what Spark sorts are (place, rank) rows, at
length 64, then at the growing lengths of what is left, until a rank is unique or the length passes the threshold.

Thinning. Each 200-byte string has an anchor: its first place with the smallest r64. Equal strings have equal anchors,
so one row stands for all strings of an anchor (about 68). Rows are sorted by (inner, outer): inner is the rank that all
of the row's strings contain (r64 of the anchor), outer the rank of their whole span. A unique inner rank makes all of the
row's strings unique; an outer rank found twice makes them all repeated. Only what is left between the two (edges of
copies) goes on, together with one row of each repeated outer rank that it may equal: small groups of one inner rank are
decided on their own strings; groups of over ``SMALL`` rows are sorted again at 16 strings a row, then one string a row.

Defined cases: a null text is empty; a text under 200 bytes is never cut; matches never cross rows; rows that share their id
are told apart by a hash of their text, and equal rows are copies of each other; an empty table gives an empty result.
Only the id and the text are read, so extra columns never clash. Removed runs end on byte, not character, borders:
``kept`` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import HOT, byte_column, discard, id_text, prepare, regrouped, spread_join, stored, table

LENGTH = 200
_INNER = 64
#: Rows of one inner rank that are decided in one place; more are sorted again.
SMALL = 64
_BLOCK = 16
_BATCH_BYTES = 2 << 20
_KEY = ["doc_id", "doc_hash"]
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the pairs (a, b)."""
    x = a * _A
    x ^= x >> np.uint64(32)
    x += b * _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


_BYTE_RANK = pair(np.arange(1, 257, dtype=np.uint64), np.arange(1, 257, dtype=np.uint64))


def ranks64(data: np.ndarray) -> np.ndarray:
    """r64 of every place that has 64 bytes."""
    r = _BYTE_RANK[data]
    for h in (1, 2, 4, 8, 16, 32):
        r = pair(r[:-h], r[h:])
    return r


def rank_of(r: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Rank of the strings of ``length`` (128 to 256) at the places ``at``, from two pairs of r64."""
    last = at + length - 128
    return pair(pair(r[at], r[at + 64]), pair(r[last], r[last + 64]))


def rows_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first and last string's place, anchor's place, inner and outer rank), places in ``data``."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    r = ranks64(data)
    n, wide = len(data) - length + 1, length - _INNER + 1
    least, at, span = r, np.arange(len(r), dtype=np.int32), 1
    while span < wide:
        s = min(span, wide - span)
        later = least[s:] < least[:-s]
        at = np.where(later, at[s:], at[:-s])
        least = np.where(later, least[s:], least[:-s])
        span += s
    at = at[:n]
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    whole = np.arange(n) + length <= ends
    new = np.ones(n, bool)
    new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])
    new[offsets[:-1][offsets[:-1] < n]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], n] - 1
    first, last = first[whole[first]], last[whole[first]]
    anchor = at[first].astype(np.int64)
    outer = pair(rank_of(r, first, length), rank_of(r, last, length))
    outer = pair(outer, ((last - first) << 16 | (anchor - first)).astype(np.uint64))
    return np.searchsorted(offsets, first, "right") - 1, first, last, anchor, r[anchor], outer


_ROWS = "doc_id long, doc_hash long, first int, last int, reach int, anchor int, g long, e long, n int"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _int(x) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int32))


def _anchored(keyed: DataFrame) -> DataFrame:
    def run(batches):
        for part in regrouped(batches, _BATCH_BYTES):
            data, offsets = byte_column(part.column("text"))
            doc, first, last, anchor, g, e = rows_of(data, offsets)
            # in periodic text neighbouring rows have equal ranks: they repeat each other, and the first stands for the run
            start = np.ones(len(doc), bool)
            start[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1]) | (doc[1:] != doc[:-1]) | (first[1:] != last[:-1] + 1)
            head = np.flatnonzero(start)
            size = np.diff(np.r_[head, len(doc)])
            reach = last[head + size - 1]
            doc, first, last, anchor, g, e = (x[head] for x in (doc, first, last, anchor, g, e))
            base = offsets[doc]
            cols = [part.column(c).take(pa.array(doc)) for c in _KEY]
            out = pa.table([*cols, _int(first - base), _int(last - base), _int(reach - base), _int(anchor - base), _long(g), _long(e), _int(np.minimum(size, 2))], [*_KEY, "first", "last", "reach", "anchor", "g", "e", "n"])
            yield from out.to_batches(max_chunksize=20_000)

    return keyed.mapInArrow(run, _ROWS)


def _decided(rows: DataFrame) -> DataFrame:
    """Rows (of a stored table) with: total (weight of the inner rank's rows), go (undecided, or
    stands for a repeated outer rank that an undecided row may equal), n (1, or 2 for a repeated outer rank), members (how
    many rows of the inner rank go on).

    Rows are dealt by inner rank. Those of a hot one take another way, over counts; a sample of the rows finds the hot ones, as
    only the way of a row hangs on it."""
    some = rows.where(F.pmod(F.xxhash64(*_KEY, "first"), F.lit(16)) == 0)
    hot = some.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * HOT > some.count() + HOT).select("g")
    is_hot = F.col("g").isin([r.g for r in hot.collect()])  # fewer than HOT numbers
    by_g, by_e = Window.partitionBy("g"), Window.partitionBy("g", "e")
    # dealt by g once: that also brings the rows of each (g, e) together
    out = rows.where(~is_hot).repartition("g").withColumn("same", F.sum("n").over(by_e)).withColumn("_rn", F.row_number().over(by_e.orderBy("doc_id", "doc_hash", "first")))
    out = out.withColumns({
        "total": F.sum("n").over(by_g),
        "_open": F.max(F.col("same") == 1).over(by_g),
        "members": F.sum((F.col("_rn") == 1).cast("int")).over(by_g),
    })
    out = out.withColumn("go", F.col("_open") & (F.col("_rn") == 1))

    warm = rows.where(is_hot)
    here = F.struct("doc_id", "doc_hash", "first")
    each = warm.groupBy("g", "e").agg(F.sum("n").alias("same"), F.min(here).alias("head"), F.count(F.lit(1)).alias("c"))
    each = stored(each, "repeat-hot-outer")
    whole = each.groupBy("g").agg(F.sum("same").alias("total"), F.max(F.col("same") == 1).alias("_open"), F.count(F.lit(1)).alias("members"))
    more = spread_join(warm, each, ["g", "e"], "c", warm.count()).join(F.broadcast(whole), "g").withColumn("go", F.col("_open") & (here == F.col("head")))
    columns = [*(c for c in rows.columns if c != "n"), "total", "go", F.least("same", F.lit(2)).cast("int").alias("n"), "members"]
    return out.select(*columns).unionByName(more.select(*columns))


def _with_context(open_rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Adds the bytes from the first string's start to the last one's end."""
    per_doc = open_rows.groupBy(*_KEY).agg(F.collect_set(F.struct("g", "first", "last", "anchor", "n", "members")).alias("rows"))

    def run(batches):
        for b in batches:
            doc, found = [], []
            texts, rows = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("rows"))
            for i in range(b.num_rows):
                data = texts[i].as_py().encode("utf-8", "surrogatepass")
                for r in rows[i].as_py():
                    doc.append(i)
                    found.append((r["g"], r["first"], r["last"], r["anchor"], r["n"], r["members"], data[r["first"] : r["last"] + LENGTH]))
            if doc:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                cols = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                keys = [b.column(b.schema.get_field_index(c)).take(pa.array(doc)) for c in _KEY]
                yield pa.RecordBatch.from_arrays([*keys, *cols], [*_KEY, "g", "first", "last", "anchor", "n", "members", "context"])

    schema = "doc_id long, doc_hash long, g long, first int, last int, anchor int, n int, members long, context binary"
    return keyed.join(per_doc, _KEY).select(*_KEY, "text", "rows").mapInArrow(run, schema)


_UNIQUE = "doc_id long, doc_hash long, first int, last int"


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring places of one row joined: (row, first, last)."""
    if not len(at):
        return doc, at, at
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(at)] - 1
    return doc[start], at[start], at[end]


def _unique_in_small(rows: DataFrame) -> DataFrame:
    """Unique strings of the groups that are decided in one place: at most SMALL rows a group."""
    members = rows.groupBy("g").agg(F.collect_list(F.struct(*_KEY, "first", "last", "n", "context")).alias("rows"))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            inner = lists.flatten()
            group = np.repeat(np.arange(b.num_rows, dtype=np.uint64), np.diff(lists.offsets.to_numpy()))
            data, offsets = byte_column(inner.field("context"))
            first, last = inner.field("first").to_numpy(), inner.field("last").to_numpy()
            n = inner.field("n").to_numpy()
            if not len(first):
                continue
            count = last - first + 1
            row = np.repeat(np.arange(len(first)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            key = pair(rank_of(ranks64(data), offsets[row] + place, LENGTH), group[row])
            _, back = np.unique(key, return_inverse=True)
            alone = np.bincount(back, n[row])[back] == 1
            r, a, z = _runs(row[alone], first[row[alone]] + place[alone])
            keys = [inner.field(c).take(pa.array(r)) for c in _KEY]
            yield pa.RecordBatch.from_arrays([*keys, _int(a), _int(z)], [*_KEY, "first", "last"])

    return members.mapInArrow(run, _UNIQUE)


def _split(rows: DataFrame, width: int) -> DataFrame:
    """Rows of at most ``width`` strings whose distances to the anchor fall in one step of ``width``, with new ranks."""

    def run(batches):
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            data, offsets = byte_column(col["context"])
            if not b.num_rows:
                continue
            r = ranks64(data)
            first, last, anchor = (col[c].to_numpy().astype(np.int64) for c in ("first", "last", "anchor"))
            low, high = (anchor - last) // width, (anchor - first) // width
            row = np.repeat(np.arange(len(first)), high - low + 1)
            step = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
            a = np.maximum(first[row], anchor[row] - step * width - width + 1)
            z = np.minimum(last[row], anchor[row] - step * width)
            shift = offsets[row] - first[row]  # from places in the text to places here
            inner = rank_of(r, anchor[row] - step * width + shift, LENGTH - width + 1)
            g = pair(pair(inner, step.astype(np.uint64)), col["g"].to_numpy().view(np.uint64)[row])
            e = pair(pair(rank_of(r, a + shift, LENGTH), rank_of(r, z + shift, LENGTH)), ((z - a) << 16 | (anchor[row] - a)).astype(np.uint64))
            from_, to = a + shift, z + shift + LENGTH
            context = pa.array([data[i:j].tobytes() for i, j in zip(from_.tolist(), to.tolist(), strict=True)], pa.binary())
            keys = [col[c].take(pa.array(row)) for c in (*_KEY, "n")]
            yield pa.RecordBatch.from_arrays([*keys[:2], _long(g), _long(e), _int(a), _int(z), _int(anchor[row]), keys[2], context], [*_KEY, "g", "e", "first", "last", "anchor", "n", "context"])

    return rows.mapInArrow(run, "doc_id long, doc_hash long, g long, e long, first int, last int, anchor int, n int, context binary")


def _unique_in_large(rows: DataFrame) -> DataFrame:
    """Unique strings of the other groups: 16 strings a row, then one."""
    blocks = stored(_decided(stored(_split(rows, _BLOCK), "repeat-split")), "repeat-blocks")
    done = blocks.where("total = 1").select(*_KEY, "first", "last")
    single = _split(blocks.where("go and total > 1").drop("e", "total", "members", "go"), 1).select(*_KEY, "g", "first", "last", "n")
    # a group is one string now: its weight is all that is asked
    alone = single.groupBy("g").agg(F.sum("n").alias("total"), *(F.first(c).alias(c) for c in (*_KEY, "first", "last"))).where("total = 1")
    return done.unionByName(alone.select(*_KEY, "first", "last"))


_CUT = "doc_id long, doc_hash long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:int,end:int>>, kept binary"


def _cut(text: str, repeated: list, unique: list) -> tuple[list[tuple[int, int]], bytes, int]:
    """(removed spans, kept bytes, bytes)."""
    data = text.encode("utf-8", "surrogatepass")
    if not repeated:
        return [], data, len(data)
    starts = np.zeros(len(data) + 1, np.int64)
    for r in repeated:
        starts[r["first"] : r["last"] + 1] = 1
    for r in unique:
        starts[r["first"] : r["last"] + 1] = 0
    at = np.flatnonzero(starts)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + LENGTH, -1)
    gone = np.cumsum(edge)[:-1] > 0
    turn = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)), np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data)


def remove_repeats(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans in bytes, kept binary) of every whole text."""
    prepare(docs.sparkSession)
    keyed = id_text(docs).withColumn("doc_hash", F.xxhash64("doc_id", "text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    keyed = keyed.select(*_KEY, "text")
    anchored = stored(_anchored(keyed), "repeat-anchored")
    rows = _decided(anchored).where("total > 1").select(*_KEY, "first", "last", "reach", "anchor", "g", "n", "go", "members")
    rows = stored(rows, "repeat-rows")
    discard(docs.sparkSession, anchored)
    opened = stored(_with_context(rows.where("go"), keyed), "repeat-context")
    unique = _unique_in_small(opened.where(F.col("members") <= small)).unionByName(_unique_in_large(opened.where(F.col("members") > small)))
    # per text: places where repeated strings may start, less those of unique ones
    span = F.struct("first", "last")
    parts = rows.select(*_KEY, F.struct("first", F.col("reach").alias("last")).alias("r"), F.lit(None).cast("struct<first:int,last:int>").alias("u"))
    parts = parts.unionByName(unique.select(*_KEY, F.lit(None).cast("struct<first:int,last:int>").alias("r"), span.alias("u")))
    per_doc = parts.groupBy(*_KEY).agg(F.collect_set("r").alias("repeated"), F.collect_set("u").alias("unique"))

    def run(batches):
        for b in batches:
            col = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            out = []
            for text, rep, uni in zip(col["text"], col["repeated"], col["unique"], strict=True):
                spans, kept, n = _cut(text.as_py(), rep.as_py() or [], uni.as_py() or [])
                out.append((n, n - len(kept), len(spans), [{"start": a, "end": z} for a, z in spans], kept))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([col["id"], *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    source = id_text(docs).withColumn("doc_hash", F.xxhash64("doc_id", "text")).withColumn("id", F.col("doc_id")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))
    joined = source.join(per_doc, _KEY, "left").select("id", "text", "repeated", "unique")
    return joined.mapInArrow(run, _CUT.replace("doc_hash long, ", ""))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_repeats": op10_repeats}
ORACLES: dict[str, str] = {}
