"""Operator 6: benchmark decontamination by winnowing.

Texts are word sequences (A-Z lower-cased). In every window of 13 words (9 consecutive 5-gram hashes) the smallest 5-gram hash
is the fingerprint, so equal windows have equal fingerprints wherever they stand (5 + 9 - 1 = 13). Fingerprints of documents
are joined with those of the benchmark; each hit is extended to the windows that have it, which are compared whole (by a
hash of all of their words). The words of equal windows are hit. An item of fewer than 13 words is one window, with the
hash of all its words as fingerprint, and is looked up at every place.

Work and memory grow with the words, also in periodic texts: places are marked in flat arrays, and no pairs of places are made.

The benchmark is a query set: its distinct word sequences are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of
text, so documents are never shuffled. Blocks come one after the other: a pass over the rows is stored before the next block is
read, so that no task and not the driver holds more than one.

Defined cases: a null text has no words and is never contaminated; null or empty benchmark texts have no window; repeated
items count by distinct item_id, null item_ids don't count; repeated documents are judged one by one; empty tables
give no hits or no rows. Extra columns of either table are ignored by ``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_column, discard, prepare, regrouped, stored, table

SPAN, K = 13, 5
WINDOW = SPAN - K + 1
BLOCK_BYTES = 16 << 20
_BATCH_BYTES = 2 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)

_byte = np.arange(256)
_LOWER = np.where((_byte >= 0x41) & (_byte <= 0x5A), _byte + 32, _byte).astype(np.uint8)
_IS_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
_IS_WORD |= (_byte >= 0x41) & (_byte <= 0x5A)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words before each text) of concatenated texts."""
    word = _IS_WORD[data]
    before = np.empty(len(data), bool)
    before[1:] = word[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    if len(data):
        before[0] = False
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    at = np.flatnonzero(word)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = _LETTER[data[at]] * _powers(int(lengths.max()) if len(lengths) else 1)[place]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64)) if len(first) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def grams(words: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place; places whose n words leave their text have none."""
    out = np.full(len(words), _NONE)
    if len(words) >= n:
        total = np.zeros(len(words) - n + 1, np.uint64)
        for k, p in enumerate(_powers(n)):
            total += words[k : len(words) - n + 1 + k] * p
        out[: len(total)] = np.minimum(mix(total), _NONE - np.uint64(1))
        ends = np.repeat(bounds[1:], np.diff(bounds))
        out[np.arange(len(words)) + n > ends] = _NONE
    return out


def _places(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each hash in the ascending ``wanted``, -1 if it isn't there."""
    if not len(wanted):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    return np.where(wanted[at] == h, at, -1)


def fingerprints(words: np.ndarray, bounds: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first places of the windows inside their text, smallest k-gram hash of each)."""
    h = grams(words, bounds, k)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = h[:n].copy()
    for i in range(1, window):
        np.minimum(least, h[i : i + n], out=least)
    at = np.flatnonzero(np.arange(n) + window + k - 1 <= np.repeat(bounds[1:], np.diff(bounds))[:n])
    return at, least[at]


def _hash_at(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place."""
    total = np.zeros(len(at), np.uint64)
    for k, p in enumerate(_powers(n)):
        total += words[at + k] * p
    return mix(total)


class Block:
    """Windows of distinct benchmark texts by their hash, with the item_ids of each text."""

    def __init__(self, texts: list[bytes], ids: list[list[int]]):
        self.ids = ids
        words, bounds = word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        at, least = fingerprints(words, bounds)
        self.fingerprints = np.unique(least)
        #: By window length: ascending hashes, where the owners of each begin, and the owners (numbers of texts).
        self.windows = {SPAN: self._sorted(_hash_at(words, at, SPAN), owner[at])} if len(at) else {}
        for m in np.unique(n[(n > 0) & (n < SPAN)]).tolist():
            at = bounds[:-1][n == m]
            self.windows[m] = self._sorted(_hash_at(words, at, m), owner[at])

    @staticmethod
    def _sorted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[first], np.r_[first, len(h)], owner

    def occurrences(self, words: np.ndarray, bounds: np.ndarray):
        """(window length, places, numbers of the equal windows) of concatenated documents."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        for m, (h, _, _) in self.windows.items():
            if m == SPAN:
                at, least = fingerprints(words, bounds)
                # neighbouring windows share their fingerprint mostly
                turn = np.flatnonzero(np.r_[True, least[1:] != least[:-1]]) if len(least) else np.zeros(0, np.int64)
                met = _places(least[turn], self.fingerprints) >= 0
                at = at[np.repeat(met, np.diff(np.r_[turn, len(least)]))]
            else:
                at = np.flatnonzero(np.arange(len(words)) + m <= ends)
            number = _places(_hash_at(words, at, m), h)
            yield m, at[number >= 0], number[number >= 0]

    def owners(self, m: int, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, text) of equal windows."""
        _, first, owner = self.windows[m]
        pairs = np.unique(doc.astype(np.int64) * len(first) + number)
        doc, number = pairs // len(first), pairs % len(first)
        n = first[number + 1] - first[number]
        text = owner[np.repeat(first[number] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.unique(np.repeat(doc, n) * len(self.ids) + text)
        return both // len(self.ids), both % len(self.ids)


def _blocks(benchmark: DataFrame, block_bytes: int):
    """(block of the benchmark's distinct texts, whether it is the last); their number is set by the measured size of the table."""
    items = benchmark.select(F.col("item_id"), F.col("text").alias("t")).where("item_id is not null and t is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = -(-size // block_bytes)
    texts = items.groupBy("t").agg(F.collect_set("item_id").alias("ids"))
    for k in range(n):
        rows = texts.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).collect()
        yield Block([r.t.encode("utf-8", "surrogatepass") for r in rows], [sorted(r.ids) for r in rows]), k == n - 1
    if not n:
        yield Block([], []), True  # the words are counted at least


_HITS = "array<struct<start:int,end:int>>"


def _scan(packed: DataFrame, text_col: str, block: Block) -> DataFrame:
    """One pass: hits of one block of items are joined to what earlier passes have found."""
    sent = packed.sparkSession.sparkContext.broadcast(block)
    schema = packed.schema
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        block = sent.value
        for part in regrouped(batches, _BATCH_BYTES, "_row"):
            row = part.column("_row").combine_chunks()
            words, bounds = word_hashes(*byte_column(pc.fill_null(pc.struct_field(row, text_col), "")))
            # +1 where a hit begins and -1 where it ends: first those of earlier blocks
            old, olds = part.column("hits").combine_chunks(), bounds[:-1]
            base = np.repeat(olds, pc.list_value_length(old).to_numpy())
            spans = [(base + old.flatten().field(0).to_numpy(), base + old.flatten().field(1).to_numpy())]
            doc_of = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            items = dict(enumerate(part.column("item_ids").to_pylist()))
            for m, at, number in block.occurrences(words, bounds):
                spans.append((at, at + m))
                for d, t in zip(*(x.tolist() for x in block.owners(m, doc_of[at], number)), strict=True):
                    items[d] = items[d] + block.ids[t]
            turns = np.zeros(len(words) + 1, np.int64)
            for a, z in spans:
                turns += np.bincount(a, minlength=len(turns)) - np.bincount(z, minlength=len(turns))
            hit = np.cumsum(turns[:-1]) > 0
            # runs of hit words, cut at the texts' ends
            edge = np.zeros(len(words) + 1, bool)
            edge[bounds] = True
            starts = np.flatnonzero(hit & (edge[:-1] | ~np.r_[False, hit[:-1]])) if len(hit) else np.zeros(0, np.int64)
            ends = np.flatnonzero(hit & (edge[1:] | ~np.r_[hit[1:], False])) + 1 if len(hit) else starts
            runs = pa.StructArray.from_arrays([pa.array((x - bounds[doc_of[starts]]).astype(np.int32)) for x in (starts, ends)], ["start", "end"])
            hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, bounds).astype(np.int32)), runs)
            out = pa.table([part.column("_row"), pa.array(np.diff(bounds).astype(np.int64)), hits.cast(hit_type), pa.array([sorted(set(x)) for x in items.values()], pa.list_(pa.int64()))], ["_row", "n_words", "hits", "item_ids"])
            yield from out.to_batches()

    return packed.mapInArrow(run, schema)


def _scanned(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """_row, n_words, hits (word places) and item_ids of every row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    empty = [F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<long>").alias("item_ids")]
    out, earlier = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *empty), None
    for block, last in _blocks(benchmark, block_bytes):
        out = _scan(out, "text", block)
        if not last:
            out = stored(out, "decontaminate-block")
            discard(spark, earlier)
            earlier = out
    return out


def _judged(scanned: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(hits, 0L, (s, h) -> s + h.end - h.start)")
    return scanned.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, item_ids, contaminated) of every whole text: ``hits`` are the word places inside
    occurrences of windows of the benchmark's items ``item_ids``; contaminated from a twentieth of the words on."""
    only = docs.select("doc_id", "text")
    return _judged(_scanned(only, benchmark, block_bytes)).select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", "hits", "item_ids", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    clean = _judged(_scanned(docs, benchmark, block_bytes)).where(~F.col("contaminated"))
    return clean.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, g)
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLES = {"op6_decontaminate": ORACLE}
