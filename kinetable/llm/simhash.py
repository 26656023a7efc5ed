"""Operator 11: near-duplicates by SimHash fingerprints and pivot distance tables.

A text is the list of its 3-word shingles (A-Z lower-cased, words between ASCII white space, repeats included, joined by spaces;
fewer words: all of them). A bit of the 64-bit fingerprint is set if it is set in over half of the shingles' XXH64. Texts whose
fingerprints differ in two bits at most are linked.

The pivot table has each distinct fingerprint's Hamming distances to many reference fingerprints. No distance of two linked
fingerprints differs by more than two. ``GLOBAL`` references are drawn at random; their coordinates discard pairs by the largest
difference before the rest is verified. All others differ from one base reference inside of one block of bits only, so their
distance less that of the base depends on nothing but that block. Of four blocks, two linked fingerprints agree in at least two, and so in
all coordinates of these: the six pairs of blocks give six keys, and linked fingerprints share one of them. Members of a bucket with
more than ``LIMIT`` fingerprints get finer keys from the blocks that are still free, cut into four again: 32, 16 and then 8 bits stay
free, and 256 fingerprints is the most that a bucket of the last kind can hold. So no link is lost, and no bucket of
any size is compared pair by pair.

Defined cases: texts without words (null, empty) have fingerprint zero, which links like any other; equal fingerprints are one node, so
copies cost nothing; rows that repeat or share an id are judged one by one; a null id is never the id of a component unless no row of it has one; an
empty table gives no rows. Long texts are read piece by piece. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, discard, id_text, prepare, regrouped, spread_join, stored, table
from .components import components

SHINGLE, SEED, NEAR = 3, 42, 2
#: References for all bits, and those of each block, by the bits of a block.
GLOBAL, PIVOTS = 8, {16: 8, 8: 5, 4: 4}
#: Fingerprints that a bucket may have to be compared as it is.
LIMIT = 256
_PIECE = 1 << 20
_BATCH_BYTES = 2 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: For each byte, its bits as eight counters of one byte each.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_RUN = 255


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, a piece of it at a time."""
    from xxhash import xxh64_intdigest

    held, short, at = [], True, 0
    while at < len(text):
        gap = _SPACE.search(text, at + _PIECE)
        end = gap.end() if gap else len(text)
        words = held + text[at:end].lower().split()
        at = end
        if len(words) >= SHINGLE:
            runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
            yield np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), np.uint64, len(words) - SHINGLE + 1)
            words, short = words[1 - SHINGLE :], False
        held = words
    if short and held:
        yield np.array([xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    lanes = _COUNTERS[h.view(np.uint8).reshape(-1, 8)]
    runs = np.add.reduceat(lanes, np.arange(0, len(h), _RUN), axis=0)
    return runs.view(np.uint8).sum(0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        counts += bit_counts(h)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long."""
    prepare(docs.sparkSession)
    rows = id_text(docs)
    name = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for part in regrouped(batches, _BATCH_BYTES):
            data, off = byte_column(part.column("text"))
            fp = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
            yield from pa.table([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"]).to_batches()

    return rows.mapInArrow(run, f"doc_id {name}, fp long")


# --- pivot table ------------------------------------------------------------------------------------------------------------


def _reference(*seed: int) -> int:
    """A reference fingerprint by rule (signed)."""
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(repr(seed).encode(), SEED)
    return x - (1 << 64) if x >> 63 else x


_BASE = _reference(0)


def _distance(reference: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(reference).cast("long")))


def _coordinates(width: int) -> Column:
    """Array of one code a block of ``width`` bits: the distances to its references less that to the base, as digits."""
    base, codes = _distance(_BASE), []
    for block in range(64 // width):
        code = F.lit(0).cast("long")
        for j in range(PIVOTS[width]):
            inside = (_reference(width, block, j) & ((1 << width) - 1)) << (block * width)
            other = _BASE ^ (inside - (1 << 64) if inside >> 63 else inside)
            code = code * (2 * width + 1) + (_distance(other) - base + width)
        codes.append(code)
    return F.array(*codes)


def pivot_table(prints: DataFrame) -> DataFrame:
    """(fp, g, key, blocks): distances to the global references; no key yet, all four blocks free."""
    g = F.array(*(_distance(_reference(1, i)).cast("tinyint") for i in range(GLOBAL)))
    return prints.select("fp", g.alias("g"), F.lit(0).cast("long").alias("key"), F.array(*map(F.lit, range(4))).alias("blocks"))


def _keyed(rows: DataFrame, width: int) -> DataFrame:
    """Six rows for one: a key for each pair of the free blocks, and what stays free, in blocks of half the width."""
    rows, keys = rows.withColumn("c", _coordinates(width)), []
    for i, j in combinations(range(4), 2):
        b, (k, m) = F.col("blocks"), (x for x in range(4) if x not in (i, j))
        at = lambda x, b=b: F.get(F.col("c"), F.get(b, F.lit(x)))
        free = F.array(*(F.get(b, F.lit(x)) * 2 + half for x in (k, m) for half in (0, 1)))
        keys.append(F.struct(F.xxhash64("key", F.lit(i), F.lit(j), at(i), at(j)).alias("key"), free.alias("blocks")))
    return rows.select("fp", "g", F.explode(F.array(*keys)).alias("k")).select("fp", "g", "k.*")


def _compared(rows: DataFrame) -> DataFrame:
    """Verified links (a, b) of fingerprints that share a key."""
    a, b = (rows.select("key", F.col("fp").alias(s), F.col("g").alias(f"g{s}")) for s in "ab")
    apart = F.greatest(*(F.abs(F.get("ga", F.lit(i)).cast("int") - F.get("gb", F.lit(i)).cast("int")) for i in range(GLOBAL)))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR
    return a.join(b, "key").where((F.col("a") < F.col("b")) & (apart <= NEAR) & near).select("a", "b")


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints ``fp`` that differ in one or two bits; a pair may come more than once."""
    spark, rows, found = prints.sparkSession, pivot_table(prints), []
    for width in PIVOTS:
        last = width == min(PIVOTS)
        members = stored(_keyed(rows, width), "simhash-keys")
        sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("w", F.col("n"))
        counted = stored(spread_join(members, sizes, ["key"], "n", members.count()), "simhash-buckets")
        discard(spark, members)
        found.append(stored(_compared(counted if last else counted.where(F.col("w") <= limit)), "simhash-links"))
        rows = counted.where(F.col("w") > limit).drop("w")
        if last or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp, component_id) of every row, links (a, b) between distinct fingerprints)."""
    signed = stored(fingerprints(docs), "simhash-rows")
    prints = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-prints")
    found = links(prints)
    rooted = prints.join(components(found).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "simhash-roots")
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    classes = spread_join(rooted, heads, ["root"], "m", rooted.count()).select("fp", "n", "component_id")
    return spread_join(signed, classes, ["fp"], "n", signed.count()), found


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op11_simhash": op11_simhash}
ORACLES: dict[str, str] = {}
