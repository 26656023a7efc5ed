"""Operator 7: quality rules by compression bands.

A text that repeats itself compresses too well and noise hardly at all. The zstandard ratio (bytes / compressed bytes)
of the whole text and of each fixed chunk must lie in a band, whose limits depend on the length: short texts carry
the frame's overhead and little context, long ones compress better. The limits are set around the ratio of prose of that length. A document is kept if its whole ratio is in its
band and at most a share of its chunks lies outside of theirs.

Base counts (words are maximal runs without the space and U+0009..U+000D): see ``quality_rules``.

Defined cases: a null or empty text has no words, fails the base rule and isn't kept; its ratio is 1.0; repeated rows are
judged one by one; an empty table gives an empty result. Only the id and the text are read, so other columns never clash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, prepare, table

LEVEL = 3
CHUNK_BYTES = 4096
#: (bytes, least ratio, most ratio) of a whole text or a chunk; in between, limits go evenly with the logarithm of the length. Prose of the
#: languages at hand has 1.3 at 128 bytes, 1.67 at 512, 2.03 at 2,048, 2.25 at 8,192, 2.5 at 65,536. The most is 14 % above that for short
#: texts, 7 % at some thousand bytes and more where a text is long enough to have a subject of its own; the least is a quarter below, as other scripts compress less.
BANDS = (
    (128, 0.70, 1.90), (512, 1.20, 1.91), (1024, 1.45, 2.06), (2048, 1.50, 2.20), (4096, 1.58, 2.31), (8192, 1.66, 2.45), (16384, 1.72, 2.65), (65536, 1.80, 3.00),
    (1 << 20, 1.90, 3.40),
)
#: A chunk outside of its band is odd; a text is rejected if more than this share of its chunks is odd.
ODD_CHUNKS = 0.34

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, ratio double, n_chunks int, n_odd_chunks int, band_ok boolean"
)


_KNOTS = np.log2([b[0] for b in BANDS])


def band(n: int) -> tuple[float, float]:
    """(least, most) ratio of ``n`` bytes."""
    at = np.log2(max(n, 1))
    return float(np.interp(at, _KNOTS, [b[1] for b in BANDS])), float(np.interp(at, _KNOTS, [b[2] for b in BANDS]))


def repeat_words(words: list[str]) -> int:
    """Words inside a 3-word window that occurs twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    n = len(number)
    if n < 2_000_000:
        key = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    else:
        _, back, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    often = counts[back.ravel()] > 1
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= often
    return int(hit.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    return len(lines) - len(set(lines))


def ratios(data: bytes, squeeze) -> tuple[float, list[tuple[int, float]]]:
    """Ratio of the whole and (bytes, ratio) of each chunk; a last chunk under half of a chunk joins the one before."""
    if not data:
        return 1.0, []
    whole = len(data) / len(squeeze(data))
    if len(data) <= CHUNK_BYTES:
        return whole, [(len(data), whole)]
    cuts = list(range(0, len(data), CHUNK_BYTES))
    if len(data) - cuts[-1] < CHUNK_BYTES // 2:
        cuts.pop()
    parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    return whole, [(len(p), len(p) / len(squeeze(p))) for p in parts]


def judge(data: bytes, squeeze) -> tuple[float, int, int, bool]:
    """(ratio, chunks, chunks outside of their band, the verdict of the bands)."""
    whole, chunks = ratios(data, squeeze)
    odd = sum(not low <= r <= high for n, r in chunks for low, high in (band(n),))
    low, high = band(len(data))
    return whole, len(chunks), odd, bool(data) and low <= whole <= high and odd <= ODD_CHUNKS * len(chunks)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Of every whole text: n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines,
    n_repeat_words, n_bytes, ratio, n_chunks, n_odd_chunks, band_ok, base_failed and kept."""
    prepare(docs.sparkSession)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = _WORDS.findall(text)
                data = text.encode("utf-8", "surrogatepass")
                rows.append((len(words), sum(map(len, words)), len(text) - len(text.translate(_SYMBOLS)), dup_lines(text), repeat_words(words), len(data), *judge(data, squeeze)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 6 + [pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "ratio", "n_chunks", "n_odd_chunks", "band_ok"]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return id_text(docs).mapInArrow(run, _SCHEMA).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("band_ok"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select(*first, *(c for c in out.columns if c not in first))


QUERIES = {"op7_quality": op7_quality}
ORACLES: dict[str, str] = {}
