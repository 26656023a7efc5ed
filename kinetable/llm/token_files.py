"""Operator 2: token-id files compressed by Re-Pair grammars.

Documents are encoded, range-partitioned and sorted by doc_id; each task cuts its documents into shards and replaces
frequent id pairs by nonterminals, round after round, until no pair occurs ``MIN_PAIRS`` times. (A round replaces all frequent
pairs that can't overlap each other, not one, so that a shard takes tens of passes instead of thousands.) A shard keeps its
rules, every symbol's expansion length and an index of its documents, so any token range is decoded without the rest.

Layout of one shard (all integers little-endian): magic ``RPG2``; n_docs, n_rules, n_symbols, first nonterminal (uint32
each); ids before the shard in its partition, n_tokens (uint64 each); doc_id (int64); then, each as byte planes (the number
of planes, then the lowest bytes of all values, the next ones, ..., as many as the largest value needs): doc_id is known,
symbols of each document, tokens of each document, rule left, rule right, rule expansion length, symbols. A shard holds
whole documents and is one row (partition, shard, n_docs, n_tokens, data) of a Parquet table that Spark writes in the
shared folder.

Defined cases: a null text is the empty text (only the end id); a null doc_id comes first, repeated doc_ids follow in
the order of a hash of their text; a document longer than a shard gets a shard of its own; an empty table gives an empty
table; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import word_bpe_path
from .common import byte_column, id_text, prepare, regrouped, shared_dir, table

#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 18
#: A pair is replaced while it occurs this often in a shard: a rule takes about 5 bytes and saves 2 an occurrence.
MIN_PAIRS = 4
END_ID = 1
_MAGIC = b"RPG2"
#: Stretches of text kept with their ids in one Python worker, but for those of one batch.
_KNOWN = 400_000
_BATCH_BYTES = 8 << 20
_SHARDS = "partition int, shard int, n_docs int, n_tokens long, data binary"
_DOCS = "partition int, doc_id long, local_start long, n_tokens long, ids binary"


# --- Re-Pair on one shard -------------------------------------------------------------------------------------------


_SLOTS = 18


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)


def _pick(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequent pairs, most frequent first, whose occurrences can't overlap: no symbol is the left of one and the right of
    another, and a doubled symbol is in no other pair."""
    order = np.lexsort((keys, -counts))
    side: dict[int, int] = {}  # 1: left, 2: right, 3: doubled
    get, chosen = side.get, []
    for at, a, b in zip(order.tolist(), (keys >> np.uint64(32))[order].tolist(), (keys & np.uint64(0xFFFFFFFF))[order].tolist(), strict=True):
        if a != b:
            if get(a, 1) == 1 and get(b, 2) == 2:
                side[a], side[b] = 1, 2
                chosen.append(at)
        elif get(a, 3) == 3:
            side[a] = 3
            chosen.append(at)
    return np.sort(keys[chosen])


def compress(ids: np.ndarray, last: np.ndarray, base: int, min_pairs: int = MIN_PAIRS) -> tuple:
    """(symbols, which of them end a document, rule lefts, rule rights): pairs within a document that occur at least
    ``min_pairs`` times are replaced until none is left. ``last``: ids that end a document; ``base``: the first nonterminal."""
    seq = ids.astype(np.uint64)
    lefts, rights, n = [], [], base
    # places whose pair may be frequent: a rare pair stays rare, only places beside a replaced one have new pairs
    live = ~last
    while len(where := np.flatnonzero(live)):
        pair = (seq[where] << np.uint64(32)) | seq[where + 1]
        # a hashed count leaves few pairs to sort
        slot = _slot(pair)
        often = np.bincount(slot, minlength=1 << _SLOTS)[slot] >= min_pairs
        keys = np.sort(pair[often])
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[first, len(keys)])
        keys, counts = keys[first[counts >= min_pairs]], counts[counts >= min_pairs]
        if not len(keys):
            break
        frequent = np.zeros(1 << _SLOTS, bool)
        frequent[_slot(keys)] = True
        stays = frequent[slot]
        live[where[~stays]] = False
        where, pair, slot = where[stays], pair[stays], slot[stays]
        rules = _pick(keys, counts)
        rule_of = np.full(1 << _SLOTS, -1)
        rule_of[_slot(rules)] = np.arange(len(rules))
        rules = rules[rule_of[_slot(rules)] == np.arange(len(rules))]  # of rules with one slot, the others wait for the next round
        rule_of[_slot(rules)] = np.arange(len(rules))
        at = rule_of[slot]
        hit = at >= 0
        hit &= rules[at] == pair
        where, at = where[hit], at[hit]
        # only a pair of equal symbols overlaps itself: keep every second place of such a run
        place = np.arange(len(where))
        place -= np.maximum.accumulate(np.where(np.diff(where, prepend=-2) != 1, place, 0))
        where, at = where[place % 2 == 0], at[place % 2 == 0]
        seq[where] = at.astype(np.uint64) + np.uint64(n)
        stays = np.ones(len(seq), bool)
        stays[where + 1] = False
        ends = last[where + 1]
        seq, last, live = seq[stays], last[stays], live[stays]
        where = where - np.arange(len(where))
        last[where] = ends
        for left in (where, where[where > 0] - 1):
            live[left] = ~last[left]
        lefts.append((rules >> np.uint64(32)).astype(np.uint32))
        rights.append((rules & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        n += len(rules)
    none = np.zeros(0, np.uint32)
    return seq.astype(np.uint32), last, np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def expansion_lengths(lefts: np.ndarray, rights: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in zip(lefts.tolist(), rights.tolist(), strict=True):
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def _open(symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, base: int) -> np.ndarray:
    """Token ids of ``symbols``; each pass opens every nonterminal by one level."""
    seq = symbols.astype(np.uint32)
    while len(open_at := np.flatnonzero(seq >= base)):
        rule = seq[open_at] - base
        wide = np.ones(len(seq), np.int64)
        wide[open_at] = 2
        first = np.cumsum(wide) - wide
        seq = np.repeat(seq, wide)
        seq[first[open_at]], seq[first[open_at] + 1] = lefts[rule], rights[rule]
    return seq


def expand(symbols: np.ndarray, lefts: np.ndarray, rights: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """Token ids of ``symbols``, from every rule's expansion once; ``lengths``: those of the expansions."""
    used = np.unique(symbols[symbols >= base])
    table = np.r_[np.arange(base, dtype=np.uint32), _open(used, lefts, rights, base)]
    n = lengths[used - base].astype(np.int64)
    start, wide = np.arange(base + len(lengths)), np.ones(base + len(lengths), np.int64)
    start[used], wide[used] = base + np.cumsum(n) - n, n
    n = wide[symbols]
    at = np.repeat(start[symbols] - (np.cumsum(n) - n), n)
    at += np.arange(len(at))
    return table[at]


def _planes(x: np.ndarray) -> bytes:
    """Byte planes of unsigned values under 2^32: their number, then the lowest bytes of all values, the next ones, ..."""
    n = max((int(x.max()).bit_length() + 7) // 8, 1) if len(x) else 1
    return bytes([n]) + x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :n].T.tobytes()


def pack(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, before: int, min_pairs: int = MIN_PAIRS) -> bytes:
    """One shard's bytes."""
    base = int(ids.max()) + 1 if len(ids) else 0
    last = np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    symbols, last, lefts, rights = compress(ids, last, base, min_pairs)
    count = np.zeros(len(lengths), np.int64)
    count[lengths > 0] = np.diff(np.flatnonzero(last) + 1, prepend=0)
    head = np.array([len(doc_ids), len(lefts), len(symbols), base], "<u4").tobytes() + np.array([before, len(ids)], "<u8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint32)
    parts = [known, count, lengths, lefts, rights, expansion_lengths(lefts, rights, base), symbols]
    return _MAGIC + head + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + b"".join(map(_planes, parts))


class Shard:
    """A shard's bytes, opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a token shard")
        docs, rules, symbols, self.base = np.frombuffer(data, "<u4", 4, 4).tolist()
        self.before, self.n_tokens = np.frombuffer(data, "<u8", 2, 20).tolist()
        self.doc_ids = np.frombuffer(data, "<i8", docs, 36)
        at = 36 + 8 * docs

        def take(n: int) -> np.ndarray:
            nonlocal at
            planes = data[at]
            out = np.zeros((n, 4), np.uint8)
            out[:, :planes] = np.frombuffer(data, np.uint8, planes * n, at + 1).reshape(planes, n).T
            at += 1 + planes * n
            return out.view("<u4").ravel()

        self.known = take(docs)
        self.index = np.r_[0, np.cumsum(take(docs), dtype=np.int64)]
        self.lengths, self.lefts, self.rights, self.expansions, self.symbols = (take(n) for n in (docs, rules, rules, rules, symbols))

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.lefts, self.rights, self.expansions, self.base)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; no other document is decoded."""
        return _open(self.symbols[self.index[k] : self.index[k + 1]], self.lefts, self.rights, self.base)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard: only the symbols that cover them are opened."""
        wide = np.ones(len(self.symbols), np.int64)
        rule = np.flatnonzero(self.symbols >= self.base)
        wide[rule] = self.expansions[self.symbols[rule] - self.base]
        ends = np.cumsum(wide)
        i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n)
        cut = start - int(ends[i - 1] if i else 0)
        return _open(self.symbols[i : j + 1], self.lefts, self.rights, self.base)[cut : cut + n]


# --- tokens ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


_byte = np.arange(256)
_BLANK = ((_byte >= 9) & (_byte <= 13)) | (_byte == 32)
_ASCII_LETTER = ((_byte | 32) >= 0x61) & ((_byte | 32) <= 0x7A)
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3 (0x97 and 0xB7 are the signs of arithmetic).
_LATIN_TAIL = (_byte >= 0x80) & (_byte <= 0xBF) & (_byte != 0x97) & (_byte != 0xB7)
_LATIN_CAPITAL = _LATIN_TAIL & (_byte <= 0x9E)
_SYMBOL = (_byte > 0x20) & (_byte < 0x7F) & ~_ASCII_LETTER & ~((_byte >= 0x30) & (_byte <= 0x39))
_LOWER = np.where(_ASCII_LETTER, _byte | 32, _byte).astype(np.uint8)


class _Encoder:
    """The library's ids, asked once for each distinct stretch between blanks of ASCII.

    This file's tokenizer replaces white space by one space, drops it, and joins nothing across it, so such a stretch has the
    same ids anywhere. Stretches of letters of ASCII and Latin-1, which no normalisation changes but lower-casing, are one
    piece each and are asked many in a call, in lower case and without the symbols that close them, which are a piece of
    their own. Everything else is asked as it stands."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self._forget()

    def _ids(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _forget(self) -> None:
        self.row: dict[bytes, int] = {b"": 0}
        self.start, self.length, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _rows(self, found: pa.DictionaryArray, plain: np.ndarray) -> np.ndarray:
        """Row of each stretch; those not known yet are learnt. ``plain``: whether it is letters only."""
        distinct, which = found.dictionary.to_pylist(), found.indices.to_numpy()
        row = np.array([self.row.get(w, -1) for w in distinct], np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            kind = np.zeros(len(distinct), bool)
            kind[which] = plain
            kind = kind[new]
            row[np.r_[new[kind], new[~kind]]] = len(self.row) + np.arange(len(new))
            self._learn([distinct[i] for i in new[kind].tolist()], [distinct[i] for i in new[~kind].tolist()])
        return row[which]

    def _learn(self, pieces: list[bytes], others: list[bytes]) -> None:
        words, ids, lengths = [], [], []
        groups = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        for group, e in zip(groups, self._ids([b" ".join(g).decode() for g in groups]), strict=True):
            found = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[found]) + 1
            assert len(cuts) == len(group)  # one piece each
            words += group
            ids.append(found)
            lengths.append(np.diff(cuts, prepend=0))
        for e in self._ids([w.decode("utf-8", "surrogatepass") for w in others]):
            ids.append(np.array(e.ids, np.uint32))
            lengths.append(np.array([len(e.ids)]))
        words += others
        self.row.update(zip(words, range(len(self.row), len(self.row) + len(words)), strict=True))
        more = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(more) - more]
        self.length, self.ids = np.r_[self.length, more], np.concatenate([self.ids, *ids])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text) of concatenated texts in UTF-8."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        word = ~_BLANK[data]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[cuts], after[cuts - 1] = False, False
        starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        # letters, and their lower case
        tail = np.zeros(len(data), bool)
        tail[1:] = (data[:-1] == 0xC3) & _LATIN_TAIL[data[1:]]
        letter = _ASCII_LETTER[data] | tail
        letter[:-1] |= tail[1:]
        lower = _LOWER[data]
        lower[tail & _LATIN_CAPITAL[data]] += 32
        odd = np.zeros(len(data) + 1, np.int32)
        np.cumsum(~letter, out=odd[1:])
        symbols = np.zeros(len(data) + 1, np.int32)
        np.cumsum(_SYMBOL[data], out=symbols[1:])
        n_odd = odd[ends] - odd[starts]
        # letters, then only symbols
        plain = (n_odd < ends - starts) & (symbols[ends] - symbols[ends - n_odd] == n_odd)
        closing = np.where(plain, n_odd, 0)
        del before, after, tail, letter, odd, symbols  # long texts make these large
        if len(self.row) > _KNOWN:
            self._forget()
        # a stretch is two runs of ids: without its closing symbols, and these
        middle = ends - closing
        inside = _inside(len(data), starts, middle)
        head = np.where(np.repeat(plain, middle - starts), lower[inside], data[inside])
        close = data[_inside(len(data), middle, ends)]
        del lower, word, inside
        row = np.stack([self._rows(_texts(head, middle - starts), plain), self._rows(_texts(close, closing), closing < 0)], 1).ravel()
        n = self.length[row]
        total = np.cumsum(n)
        inner = np.repeat(self.start[row] - (total - n), n)
        inner += np.arange(len(inner))
        return self.ids[inner], np.diff(np.r_[0, total[1::2]][np.searchsorted(starts, offsets)])


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places lie inside of ascending stretches."""
    turns = np.zeros(n + 1, np.int8)
    turns[starts] += 1
    turns[ends] -= 1
    return np.cumsum(turns[:-1], dtype=np.int8).view(bool)


def _texts(data: np.ndarray, lengths: np.ndarray) -> pa.DictionaryArray:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    return raw.dictionary_encode()


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the shards below ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    prepare(spark)

    def run(batches):
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), _encoder(tokenizer)
        ids, lengths, held, total, before, n = [], [], [], 0, 0, 0

        def shard():
            data = pack(held, np.array(lengths), np.concatenate(ids), before)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([total], pa.int64()), pa.array([data], pa.binary())], ["partition", "shard", "n_docs", "n_tokens", "data"])

        for batch in regrouped(batches, _BATCH_BYTES):
            flat, count = encode(*byte_column(batch.column("text")))
            flat, ends = np.insert(flat, np.cumsum(count), end_id), np.cumsum(count + 1)
            at = 0
            for d, c, end in zip(batch.column("doc_id").to_pylist(), (count + 1).tolist(), ends.tolist(), strict=True):
                held.append(d)
                lengths.append(c)
                total += c
                if total >= shard_tokens:
                    ids.append(flat[at:end])
                    yield shard()
                    before, n, at = before + total, n + 1, end
                    ids, lengths, held, total = [], [], [], 0
            ids.append(flat[at:])
        if held:
            yield shard()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs).withColumn("_tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "_tie")
    ordered = ordered.sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    ordered.mapInArrow(run, _SHARDS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the shards below ``path``."""
    prepare(spark)
    shards = spark.read.schema(_SHARDS).parquet(path)

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(4), strict=True):
                s = Shard(data.as_py())
                ends = np.cumsum(s.lengths, dtype=np.int64)
                starts = ends - s.lengths
                raw = pa.Array.from_buffers(pa.binary(), len(s.lengths), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int32).tobytes()), pa.py_buffer(s.all().astype("<u4").tobytes())])
                doc = pa.array(s.doc_ids.astype(np.int64), pa.int64(), mask=s.known == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), part, np.int32)), doc, pa.array(starts + s.before), pa.array(s.lengths.astype(np.int64)), raw], ["partition", "doc_id", "local_start", "n_tokens", "ids"])

    # ids before each write task's part: a running sum over as many rows as there were tasks, so the side is small
    sums = shards.groupBy("partition").agg(F.sum("n_tokens").alias("_n"))
    earlier = sums.select("partition", (F.sum("_n").over(Window.orderBy("partition")) - F.col("_n")).alias("_base"))
    return shards.mapInArrow(run, _DOCS).join(F.broadcast(earlier), "partition").select("doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, word_bpe_path())
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_files": op2_token_files}
ORACLES: dict[str, str] = {}
