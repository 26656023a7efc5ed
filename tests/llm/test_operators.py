"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import bpe, decontaminate, line_dedup, near_dedup, quality, repeats, token_files, toxicity, url_filter, warc
from kinetable.llm.common import shared_dir

random.seed(5)
VOCAB = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 7))) for _ in range(400)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + r.choice(["", "", "", ".", ","]) for _ in range(n))


BASE = prose(300, 1)
TEXTS = [
    BASE, BASE, BASE.replace(BASE.split()[40], "changed", 1), None, "", " \n ", "one", "Two words", "x" * 3000, prose(5000, 2), "ab " * 400, prose(120, 3) + "\n" + prose(60, 4), "é ǅ 日本 ١٢ <|endoftext|> it's",
    prose(100, 6) + " " + BASE[:900],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", "s", 1), (None, prose(80, 9), None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns named like the operators' own outputs."""
    extra = ["n", "ids", "decoded", "score", "hits", "item_ids", "n_words", "g", "e", "node", "line", "leaf", "drop", "kept", "h", "d", "rows", "class_id"]
    return docs.select("*", *(F.lit(7).alias(c) for c in extra))


def empty(docs):
    return docs.limit(0)


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_bpe_path())


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs):
    t = tokenizer()
    for r in bpe.bpe_digests(docs, bpe.word_bpe_path()).join(docs.groupBy("doc_id").agg(F.first("text").alias("text")), "doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_columns_and_empty_table(docs, clashing):
    out = bpe.encode(clashing, bpe.word_bpe_path())
    assert out.columns.count("ids") == 1 and "lang" in out.columns and out.count() == docs.count()
    assert bpe.bpe_digests(empty(docs), bpe.word_bpe_path()).count() == 0


@pytest.fixture(scope="module")
def odd_texts():
    """100,000 short texts from all planes, unassigned code points included, and cases that have gone wrong."""
    r = random.Random(11)
    blanks, odd = "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2003\u2028\u202f\u205f\u3000\u180e\u200b", "İıſKÅΣσςßẞIiJKıǅµªº"

    def one():
        k = r.random()
        if k < 0.4:
            return chr(r.randrange(0x21, 0x7F) if k < 0.25 else r.randrange(0xC0, 0x250))
        if k < 0.72:
            return r.choice(blanks if k < 0.5 else ".,:;!?'" if k < 0.6 else odd) if k < 0.66 else chr(r.randrange(0x300, 0x370))
        c = r.randrange(0x110000 if k < 0.86 else 0x20000)
        return "x" if 0xD800 <= c < 0xE000 else chr(c)

    texts = ["".join(one() for _ in range(r.randint(1, 14))) for _ in range(100_000)]
    texts += ["İ.", "KİŞİ, ev", "ÖZELLİĞİ.", "\u0958.", "J\u030c.", "\u0343\U00011a99", "<|endoftext|>x", "<|ENDOFTEXT|>.", "a<|endoftext|>.", "it's", "IT'S!", ""]
    texts += [f(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 97 == 0 or 0x13460 <= c < 0x13480 or 0x10D40 <= c < 0x10D90) for f in ("a{}".format, "{}.".format)]
    t = tokenizer()
    return texts, [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def test_bpe_any_text(odd_texts):
    own = bpe.Bpe(bpe.word_bpe_path())
    assert [t for t, ids in zip(*odd_texts, strict=True) if np.frombuffer(own.encode(t), "<u4").tolist() != ids] == []


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_token_files_encode_any_text(odd_texts):
    texts, ids = odd_texts
    encode = token_files._Encoder(bpe.word_bpe_path())
    for some in (slice(0, 3), slice(3, None)):
        raw = [t.encode() for t in texts[some]]
        flat, n = encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        ends = np.cumsum(n)
        assert [t for t, a, b, x in zip(texts[some], ends - n, ends, ids[some], strict=True) if flat[a:b].tolist() != x] == []


def test_token_files_round_trip(spark, docs, clashing):
    import uuid

    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, bpe.word_bpe_path(), shard_tokens=1000)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    t = tokenizer()
    texts = {(r.doc_id): r.text for r in docs.collect()}
    at = 0
    for r in got:
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r.doc_id for r in got] == sorted(texts, key=lambda x: (x is not None, x)) [:1] + sorted([r.doc_id for r in docs.collect() if r.doc_id is not None])
    token_files.write_token_files(clashing, path + "-clash", bpe.word_bpe_path())
    again = token_files.read_token_files(spark, path + "-clash").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in again] == [(r.doc_id, r.start, r.ids) for r in got]
    path += "-none"
    token_files.write_token_files(empty(docs), path, bpe.word_bpe_path())
    assert token_files.read_token_files(spark, path).count() == 0


def test_shards_are_smaller_than_two_bytes_an_id():
    r = np.random.default_rng(2)
    ids = (49_000 * r.random(200_000) ** 4).astype(np.uint32)
    ids = np.where(r.random(200_000) < 0.5, np.roll(ids, 2_000), ids)
    for n in (0, 1, 200_000):
        data = token_files.pack([5], np.array([n]), ids[:n], 0)
        assert (token_files.Shard(data).all() == ids[:n]).all()
    assert len(data) < 2 * len(ids)


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(1)
    words = [r.integers(2, 50, n) for n in (3, 5, 2, 4)]
    docs = [np.concatenate([words[i] for i in r.integers(0, 4, n)] + [[1]]).astype(np.uint32) for n in (0, 1, 400, 30)] + [np.array([7] * 99 + [1], np.uint32)]
    ids = np.concatenate(docs)
    s = token_files.Shard(token_files.pack(list(range(5)), np.array([len(d) for d in docs]), ids, 11, min_pairs=2))
    assert (s.all() == ids).all() and len(s.symbols) < len(ids) / 3 and s.before == 11
    for k, d in enumerate(docs):
        assert (s.document(k) == d).all()
    for a, n in ((0, 1), (5, 40), (len(ids) - 3, 3)):
        assert (s.span(a, n) == ids[a : a + n]).all()


# --- 5 ---------------------------------------------------------------------------------------------------------------


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    host = host.translate(LOWER)
    fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, default)


URLS = ["https://m.example.org/es/1", "http://EXAMPLE.org/en/12?x=1", "http://org/", "http://xorg/a", "https://a.b.com/de/7#t", "http://com", None, "", "nothing", "http://notexample.org/es/", "http://example.org.evil.net/es/", "x://a?b/c", "http://a..com/fr/"]


def test_url_filter(spark):
    rules = [*url_filter.RULES, ("allow", "m.example.org", "/es/1"), ("block", "net", "/"), ("block", "net", "/")]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS * 3)], "page_id long, url string, host string")
    for per_block in (100, 2):
        out = url_filter.url_filter(df, rules, rules_per_block=per_block)
        assert sorted(out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
        for r in out.collect():
            assert (r.host, r.path, r.rule, r.verdict) == judged(r.url, rules), r
    odd = spark.createDataFrame([(i, u) for i, u in enumerate(("x://com\x01x/fr/a", "x://a.com\x01/fr/", "x://\x01com/fr/", "x://\x02.com/fr/b", "x://\x01.com/fr/b", "x://com\x00/fr/", "x://com/fr/"))], "page_id long, url string")
    assert [r.rule for r in url_filter.url_filter(odd).orderBy("page_id").collect()] == [None, None, None, "com/fr/", "com/fr/", None, "com/fr/"]
    assert url_filter.url_filter(df, []).where("rule is not null or verdict <> 'allow'").count() == 0
    assert url_filter.url_filter(df.limit(0)).count() == 0


# --- 6 ---------------------------------------------------------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def test_decontaminate(spark, docs, clashing):
    base = BASE.split()
    items = [(1, " ".join(base[10:40])), (2, " ".join(base[100:113]).upper()), (3, "one"), (4, None), (5, ""), (6, " ".join(base[10:40])), (6, prose(40, 77)), (None, BASE), (7, "two, WORDS"), (8, prose(30, 2)), (8, prose(30, 2))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    for d, t in enumerate(TEXTS):
        w, hit, found = words(t), set(), set()
        for i, x in items:
            q = words(x)
            n = min(13, len(q))
            for k in range(len(q) - n + 1 if q and i is not None else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == q[k : k + n]:
                        hit.update(range(a, a + n))
                        found.add(i)
        expected[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    for block in (1 << 20, 300):  # one block and several
        for r in decontaminate.contamination(clashing, bench, block).where("doc_id is not null").collect():
            assert (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) == expected[r.doc_id]
    kept = decontaminate.decontaminate(clashing, bench)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(d for d, x in expected.items() if not x[3])}
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(docs), bench).count() == 0


def test_decontaminate_repetitive_texts_take_linear_time(spark):
    import time

    texts = ["the cat " * 10_000, "a b c " * 6_666, " ".join(f"w{i}" for i in range(19_900)) + " the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, "b c a " * 140), (3, " ".join(f"w{i}" for i in range(300, 500)))], "item_id long, text string")
    start = time.time()
    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in decontaminate.contamination(df, bench).collect()}
    assert got == {0: (20_000, 10_000, [1]), 1: (19_998, 19_998, [2]), 2: (19_901, 201, [1, 3])}
    assert time.time() - start < 10


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_quality(docs):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for d, t in enumerate(TEXTS):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
    assert not got[8].kept and not got[10].kept and not got[3].kept and got[9].kept and got[0].kept
    assert quality.quality_rules(empty(docs)).count() == 0


def test_quality_verdict(docs):
    """``kept`` from the stated bands, whole text and chunks, by a plain restatement."""
    import zstandard

    knots = [(128, 0.70, 1.90), (512, 1.20, 1.91), (1024, 1.45, 2.06), (2048, 1.50, 2.20), (4096, 1.58, 2.31), (8192, 1.66, 2.45), (16384, 1.72, 2.65), (65536, 1.80, 3.00), (1 << 20, 1.90, 3.40)]

    def ok(n, r):
        if n <= 128 or n >= 1 << 20:
            low, high = (knots[0] if n <= 128 else knots[-1])[1:]
        else:
            a, b = next((a, b) for a, b in zip(knots, knots[1:], strict=False) if n <= b[0])
            part = math.log(n / a[0]) / math.log(b[0] / a[0])
            low, high = (x + part * (y - x) for x, y in zip(a[1:], b[1:], strict=True))
        return low <= r <= high

    pack = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3).compress(b))
    for r in quality.quality_rules(docs).where("doc_id is not null").collect():
        data = (TEXTS[r.doc_id] or "").encode()
        parts = [data[i : i + 4096] for i in range(0, len(data), 4096)]
        if len(parts) > 1 and len(parts[-1]) < 2048:
            parts[-2:] = [parts[-2] + parts[-1]]
        odd = sum(not ok(len(p), pack(p)) for p in parts)
        band = bool(data) and ok(len(data), pack(data)) and odd <= 0.34 * len(parts)
        assert (r.n_odd_chunks if data else 0, r.band_ok, r.kept) == (odd, band, band and not r.base_failed), r


def test_quality_bands():
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    assert not quality.judge(b"spam and eggs " * 2000, squeeze)[3]
    assert not quality.judge(random.Random(2).randbytes(5000), squeeze)[3]
    r = random.Random(3)
    for low, high in ((97, 122), (0x4E00, 0x8FFF)):  # letters at random, with and without case for a script
        assert not quality.judge(" ".join("".join(chr(r.randint(low, high)) for _ in range(6)) for _ in range(2000)).encode(), squeeze)[3]


def test_quality_of_labelled_documents(spark):
    """The bands do their part: they reject most of the low quality that the base rules let pass, and hardly any other document."""
    at = "/root/testdata/sf0.1"
    judged = quality.quality_rules(spark.read.parquet(f"{at}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    rate = {r.quality: (r.n, r.rejected) for r in judged.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.avg((~F.col("kept")).cast("double")).alias("rejected")).collect()}
    assert rate[0][0] > 200 and rate[0][1] > 0.5
    assert rate[1][0] > 2000 and rate[1][1] < 0.002


# --- 10 --------------------------------------------------------------------------------------------------------------


def removed(texts, n=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i : i + n] = True
        out.append((len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("small", [64, 0])
def test_repeats(spark, docs, clashing, small):
    r = random.Random(4)
    parts = [prose(40, 50 + i) for i in range(6)]
    texts = [*TEXTS, *("".join(r.choice(parts)[r.randint(0, 60) :] for _ in range(4)) for _ in range(25)), "Thaningha " * 90, "é" * 150, "y" * 199, "z" * 200, "z" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("g", F.lit(1)).withColumn("kept", F.lit("x"))
    got = repeats.remove_repeats(df, small)
    for row, want in zip(got.orderBy("doc_id").select("n_bytes", "n_removed", F.sha2("kept", 256)).collect(), removed(texts), strict=True):
        assert tuple(row) == want
    assert repeats.remove_repeats(docs).where("doc_id = 0").select("n_removed").distinct().count() == 1
    assert repeats.remove_repeats(empty(docs)).count() == 0


# --- 8 ---------------------------------------------------------------------------------------------------------------


def records(data):
    """A plain reader of one whole archive: (id, type, payload)."""
    at, out = 0, []
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("latin-1")
        n = int(re.findall(r"(?m)^Content-Length: (\d+)", head)[-1])
        block = data[end + 4 : end + 4 + n]
        assert data[at : at + 10] == b"WARC/1.1\r\n" and data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        page = re.search(r"Record-ID: <urn:page:(\d*)>", head)[1]
        out.append((int(page or 0), re.search(r"WARC-Type: (\w+)", head)[1], block.split(b"\r\n\r\n", 1)[1]))
        at = end + 8 + n
    return out


@pytest.mark.parametrize("chunk", [300, 1200, 1 << 20])
def test_warc(spark, monkeypatch, chunk):
    import uuid

    fake = warc.record(99, "http://fake", b"inner" * 10, "0" * 40, None)[0].decode("latin-1")
    big = "p" * 1500 + fake
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\nd", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", fake + fake), (8, "v" * 70000, big), (None, "w", big), (9, "u", "é" * 600), (9, "u", "é" * 600)]
    rows += [(20 + i, f"http://h/WARC/1.1\r\nContent-Length: 3\r\n\r\n{i}", fake[: 7 * i] + "q" * (97 * i) + "\r\n\r\n") for i in range(25)] + [(100 + i, "hot", "h" * 2000) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(3))
    monkeypatch.setattr(warc, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 6000)
    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_warc(df, path)
    read = warc.read_warc(spark, path).collect()
    assert all(r.intact for r in read)
    got = sorted(((r.id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in read)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        keep = 8 if h == big else 129 if h == "h" * 2000 else None
        other = keep is not None and i != keep
        want.append((i or 0, len(b), hashlib.sha1(b).hexdigest(), "revisit" if other else "response", keep if other else 0))
    assert got == sorted(want)
    assert {r.url for r in read if r.id in (3, 8)} == {"http://c%0Ad", "v" * 70000}
    whole = [x for r in warc.archive_files(spark, path).collect() for x in records(bytes(r.content))]
    assert sorted((i, k, hashlib.sha1(p).hexdigest()) for i, k, p in whole if k == "response") == sorted((a, d, c) for a, _, c, d, _ in got if d == "response")
    assert len(whole) == len(rows)
    path += "-none"
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_damage_is_seen(spark):
    import uuid

    path = f"{shared_dir(spark)}/w-{uuid.uuid4().hex}"
    warc.write_warc(spark.createDataFrame([(i, "u", "text of page %d" % i) for i in range(9)], "page_id long, url string, html string").coalesce(1), path)
    hurt = spark.read.parquet(path).withColumn("data", F.encode(F.replace(F.decode("data", "ISO-8859-1"), F.lit("page 4"), F.lit("page X")), "ISO-8859-1"))
    hurt.write.parquet(path + "-hurt")
    assert {r.id: r.intact for r in warc.read_warc(spark, path + "-hurt").collect()} == {i: i != 4 for i in range(9)}


def test_warc_candidates_take_linear_time():
    import time

    start = time.process_time()
    magics = b"WARC/1.1\r\n" * 100_000
    assert warc.candidates(magics, b"", 0) == []
    many = warc.candidates(magics + b"Content-Length: 7\r\n\r\n" + b"x" * 11, b"", 5)
    assert len(many) == 100_000 and {to for _, to, _ in many} == {5 + len(magics) + 21 + 7 + 4}
    assert time.process_time() - start < 5


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, clashing):
    notice = "Copyright by Someone, all rights {} reserved here"
    rows = [(i, f"own line number {VOCAB[i]} of text {VOCAB[i + 9]} here\n{notice.format(2000 + i)}\nshort line\n\n" + prose(12, 300 + i)) for i in range(5)] + [(9, None), (10, ""), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(1))
    out = {(r.doc_id, len(r.text or "")): r.text for r in line_dedup.line_dedup(df).collect()}
    texts = [t for (d, n), t in out.items() if t and n > 1]
    assert sum("Copyright" in t for t in texts) == 1 and sum("short line" in t for t in texts) == 1
    assert any(t is None for t in out.values()) and "" in out.values()
    assert all(prose(12, 300 + i) in "".join(texts) for i in range(5))
    assert line_dedup.line_dedup(clashing).columns == clashing.columns and line_dedup.line_dedup(docs).count() == docs.count()
    assert line_dedup.line_dedup(empty(docs)).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------------------------


def bag(t):
    w = words(t)
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def test_near_dedup(spark, docs, clashing):
    r = random.Random(8)
    texts = list(TEXTS)
    for b in range(4):
        base = prose(150, 400 + b).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(VOCAB)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            low, high = sum((a & bags[j]).values()), sum((a | bags[j]).values())
            if low >= 0.8 * high:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    classes, _ = near_dedup.near_duplicates(df)
    assert {r.d: r.class_id for r in classes.collect()} == {i: find(i) for i in range(len(texts))}
    kept = near_dedup.near_dedup(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 1 not in ids and 2 not in ids and None in ids
    assert near_dedup.near_dedup(empty(docs)).count() == 0


def test_stray_nodes_meet_a_large_group(spark):
    """A group of many near copies (over BLOCK nodes), two strays in its buckets that are close to some of its members only, and a
    row without an id beside one with the id -1."""
    r = random.Random(9)
    base = prose(200, 900).split()
    texts = []
    for _ in range(3 * near_dedup.BLOCK):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        texts.append(" ".join(w))
    for start in (0, 120):
        texts.append(" ".join(base[:start] + prose(70, 950 + start).split() + base[start + 70 :]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, prose(90, 960)), (None, prose(90, 960)), (None, prose(91, 961))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            low, high = sum((a & bags[j]).values()), sum((a | bags[j]).values())
            if low >= 0.8 * high:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    found, _ = near_dedup.near_duplicates(df)
    rows = found.collect()
    assert {x.d: x.class_id for x in rows if not x.z and x.d >= 0} == {i: find(i) for i in range(len(texts))}
    assert {(x.z, x.class_id) for x in rows if x.z or x.d < 0} == {(False, -1), (True, -1), (True, None)}
    # forced apart: without any link of leaders, the comparison of blocks finds the same classes
    texts_df = spark.createDataFrame([(bytes([i // 256, i % 256]), t) for i, t in enumerate(texts[:300])], "node binary, text string")
    placed = texts_df.select(F.lit(b"g").alias("b"), "node", F.col("node").alias("root"), F.lit(300).cast("long").alias("n"), F.lit(299).cast("long").alias("others"), F.lit(bytes([0, 0])).alias("top"))
    links = {frozenset((bytes(x.a), bytes(x.b))) for x in near_dedup._compared(placed, texts_df, 0.8).collect()}
    want = {frozenset((bytes([i // 256, i % 256]), bytes([j // 256, j % 256]))) for i in range(300) for j in range(i) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    assert links == want


def test_recall_on_given_documents(spark):
    """All pairs of similarity 0.8 or more of the 1000 documents of the middle scale, by counting shared shingles: their classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    bags = [bag(x.text) for x in rows]
    size = np.array([sum(b.values()) for b in bags])
    holders = {}
    for i, b in enumerate(bags):
        for k, c in b.items():
            for n in range(c):
                holders.setdefault((k, n), []).append(i)
    overlap = np.zeros((len(rows), len(rows)), np.int32)
    for who in holders.values():
        if len(who) > 1:
            overlap[np.ix_(who, who)] += 1
    alike = (overlap >= 0.8 * (size[:, None] + size[None, :] - overlap)) & (size[:, None] > 0)
    near_pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True)]
    classes = {x.d: x.class_id for x in near_dedup.near_duplicates(docs)[0].collect()}
    caught = sum(classes[rows[i].doc_id] == classes[rows[j].doc_id] for i, j in near_pairs)
    different = sum(rows[i].text != rows[j].text for i, j in near_pairs)
    print(f"pairs {len(near_pairs)}, of different texts {different}, caught {caught}")
    assert near_pairs and caught == len(near_pairs)


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(3)
    h = r.integers(0, 2**63, 60).astype(np.uint64)
    wa, wb = r.integers(1, 12, 60), r.integers(1, 12, 60)
    doc = np.repeat([0, 1], 60)
    sig = near_dedup.signatures(doc, np.r_[h, h], np.r_[wa, wb], 2, registers=4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, clashing):
    r = random.Random(6)
    rows = []
    for i in range(400):
        w = prose(60, 1000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["grobian", "lummox"]) if i % 8 else "zzq" + r.choice(VOCAB)
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (5, None), (5, 0)], "doc_id long, toxic int"))
    got = toxicity.toxicity(df.select("doc_id", "text"), labels).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    held = [x for x in got if x.out]
    assert len(held) > 40 and sum((x.score >= 0.5) == bool(rows[x.doc_id][2]) for x in held) >= 0.97 * len(held)
    spotted = next(x for x in got if x.spans)
    s = spotted.spans[0]
    assert rows[spotted.doc_id][1][s.start : s.end].startswith(("grob", "lumm", "zzq"))
    model = toxicity.train(df, labels)
    scores = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert len(scores) == len(TEXTS) + 1 and all(0 <= x <= 1 for x in scores.values()) and scores[3] < 0.5
    kept = toxicity.remove_toxic(clashing, labels)
    assert kept.columns == clashing.columns
    assert {x.score for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty(docs), labels).count() == 0


def test_toxicity_on_held_out_documents(spark):
    """Area under the curve and false alarms on the held-out fifth of the labelled documents of the largest scale."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {x.doc_id: x.toxic for x in labels.where("toxic is not null").collect()}
    got = [(x.score, known[x.doc_id]) for x in toxicity.toxicity(docs, labels).where(toxicity.held_out(F.col("doc_id"))).collect() if x.doc_id in known]
    bad, good = [s for s, y in got if y], [s for s, y in got if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good))
    print(f"held out: {len(bad)} toxic, {len(good)} clean, area {auc:.4f}, clean over a half {sum(s >= 0.5 for s in good)}")
    assert auc > 0.95 and sum(s >= 0.5 for s in good) <= 0.02 * len(good)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    rows = [(i, ("grobian " if i % 3 == 0 else "") + prose(40, 5000 + i), int(i % 3 == 0)) for i in range(120)] + [(500, "x" * 3_000_000, 1), (501, prose(20_000, 8), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df.select("doc_id", "toxic"), max_bytes=20_000)
    assert "theta" in model or 0 <= model["share"] <= 1
    scores = {x.doc_id: x.score for x in toxicity.score(df, toxicity.train(df, df.select("doc_id", "toxic"))).collect()}
    assert len(scores) == 122 and all(0 <= s <= 1 for s in scores.values())


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    logit, trans = r.normal(size=7), r.normal(size=(2, 2))
    p, moved = toxicity.marginals(logit, np.array([0, 3]), np.array([3, 4]), trans)
    for a, b in ((0, 3), (3, 7)):
        weight = {}
        for y in np.ndindex(*(2,) * (b - a)):
            weight[y] = np.exp(sum(logit[a + i] * y[i] for i in range(b - a)) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1)))
        z = sum(weight.values())
        for i in range(b - a):
            assert abs(p[a + i] - sum(w for y, w in weight.items() if y[i]) / z) < 1e-9
    assert abs(moved.sum() - 5) < 1e-9
