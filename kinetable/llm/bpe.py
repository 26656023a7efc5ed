"""Operator 4: BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds (merge rank, position) of adjacent pairs. The
lowest entry is merged if it still describes the two symbols there, and skipped as stale otherwise. Decoding looks up
each id's vocabulary string and joins them as the tokenizer file's (absent) decoder does: with one space.

The Unicode tables are those of the tokenizers library, which Python's may be older than and whose normalisation differs in
rare orders of combining marks: a word beyond U+02FF is normalised by its normalizer, and one with a code point that Python
doesn't know is split into pieces by its pre-tokenizer. The pieces are merged like all others.

Defined cases: a null text is encoded as the empty text (no ids, empty decoding); rows with equal ids or texts are
each encoded; an empty table gives an empty result; columns other than the id and the text are carried through
unless they are named like an output column, in which case the output column replaces them.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, prepare, table

#: White space by the Unicode property, which str.split() would widen by U+001C..U+001F.
_SPACE = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{_SPACE}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Words kept with their ids in one Python worker; the memory is bounded by this and _LONGEST.
_CACHE_WORDS = 100_000
_LONGEST = 48
#: Bits of an id and of a position in the packed entries of merge table and queue.
_ID, _AT = 24, 32
_LOW_ID, _LOW_AT = (1 << _ID) - 1, (1 << _AT) - 1


def _byte_letters() -> list[str]:
    """Letter of each byte: itself if printable Latin-1, else the next free code point from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b] = chr(free)
            free += 1
    return [letters[b] for b in range(256)]


class Known:
    """Ids of words seen lately: a full table becomes the old one, and a word found in the old one moves on."""

    def __init__(self, most: int = _CACHE_WORDS):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, word: str) -> bytes | None:
        ids = self.new.get(word)
        if ids is None and (ids := self.old.get(word)) is not None:
            self.put(word, ids)
        return ids

    def put(self, word: str, ids: bytes) -> bytes:
        if len(word) <= _LONGEST:
            if len(self.new) >= self.most:
                self.new, self.old = {}, self.new
            self.new[word] = ids
        return ids


class Bpe:
    """Encoder and decoder of one tokenizer file (NFC, lower case, split by pattern, byte letters, word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = s
        self.merges: dict[int, int] = {}  # left id, right id: rank, merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << _ID | vocab[b]] = rank << _ID | vocab[a + b]
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + model["end_of_word_suffix"]] for c in letters]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.path = path
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words_known, self.pieces_known = Known(), Known()

    def merge(self, piece: bytes) -> bytes:
        """Ids of one piece (little-endian unsigned 32 bit)."""
        ids = [self.inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        n = len(ids)
        merges = self.merges.get
        queue, pair = [], [None] * n  # pair[i]: the table's entry of symbol i with its right neighbour
        a = ids[0]
        for i in range(1, n):
            b = ids[i]
            if (found := merges(a << _ID | b)) is not None:
                pair[i - 1] = found
                queue.append((found >> _ID) << _AT | i - 1)
            a = b
        if not queue:
            return struct.pack(f"<{n}I", *ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        right[-1] = -1
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & _LOW_AT
            found = pair[i]
            if found is None or found >> _ID != top >> _AT:
                continue  # stale: one of the two symbols has been merged meanwhile
            new, j = found & _LOW_ID, right[i]
            ids[i], ids[j] = new, -1
            pair[i] = pair[j] = None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (found := merges(new << _ID | ids[k])) is not None:
                    pair[i] = found
                    heappush(queue, (found >> _ID) << _AT | i)
            h = left[i]
            if h >= 0:
                pair[h] = found = merges(ids[h] << _ID | new)
                if found is not None:
                    heappush(queue, (found >> _ID) << _AT | h)
        out = [x for x in ids if x >= 0]
        return struct.pack(f"<{len(out)}I", *out)

    def piece(self, text: str) -> bytes:
        ids = self.pieces_known.get(text)
        if ids is None:
            ids = self.pieces_known.put(text, self.merge(text.encode("utf-8", "surrogatepass")))
        return ids

    def word(self, raw: str) -> bytes:
        """Ids of a stretch without white space or special tokens."""
        if raw.isascii() or max(raw) < "\u0300":
            text = raw.lower()
        else:
            text = _library(self.path).normalizer.normalize_str(raw)
        if text.isalpha():
            return self.piece(text)
        if text[-1] in ".,:;!?" and text[:-1].isalpha():
            return self.piece(text[:-1]) + self.piece(text[-1])
        if not text.isascii() and "Cn" in map(unicodedata.category, text):
            found = [at for _, at in _library(self.path).pre_tokenizer.pre_tokenize_str(text)]
        else:
            found = [m.span() for m in self.pattern.finditer(text)]
        return b"".join([self.piece(text[a:b]) for a, b in found])

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.split_special.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            known = self.words_known
            for w in _WORDS.findall(part) if _ODD_SPACE.search(part) else part.split():
                ids = known.new.get(w)
                if ids is None and (ids := known.get(w)) is None:
                    ids = known.put(w, self.word(w))
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I")])


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def _with(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + fields)


def _append(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = {n.lower() for n in new}
    kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n.lower() not in names]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(new.values()), [n for n, _ in kept] + list(new))


def encode(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32 bit) and ``n_tokens`` (long) of the whole ``text_col``."""
    prepare(df.sparkSession)

    def run(batches):
        bpe = _bpe(tokenizer)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids = [bpe.encode(t or "") for t in texts]
            yield _append(batch, {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())})

    schema = _with(df.schema, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (string): the vocabulary strings of ``ids_col``, special tokens included, joined."""
    prepare(df.sparkSession)

    def run(batches):
        bpe = _bpe(tokenizer)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            yield _append(batch, {"decoded": pa.array([bpe.decode(x or b"") for x in ids], pa.string())})

    return df.mapInArrow(run, _with(df.schema, [T.StructField("decoded", T.StringType())]))


def transcode(df: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds ``ids``, ``n_tokens`` and ``decoded``."""
    prepare(df.sparkSession)

    def run(batches):
        bpe = _bpe(tokenizer)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            ids = [bpe.encode(t or "") for t in texts]
            yield _append(batch, {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "decoded": pa.array(map(bpe.decode, ids), pa.string())})

    return df.mapInArrow(run, _with(df.schema, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]))


def bpe_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, of every whole text."""
    return transcode(id_text(docs), tokenizer).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), word_bpe_path())


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
