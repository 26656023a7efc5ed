"""Fingerprint links, hard negatives and the manifest against plain restatements; nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kinetable.llm import manifest, negatives, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
R = random.Random(17)
WORDS = ["".join(R.choice("abcdeÉ") for _ in range(R.randint(1, 6))) for _ in range(200)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


LONG = prose(900, 1)
TEXTS = [None, "", " \t\n", "One", "one", "Two words", "three words here", LONG, LONG.upper(), LONG.replace(" ", "\x0b\n", 3), LONG + " more", " ".join(["a", "b"]) + " c d e", prose(40, 2)]
TEXTS += [f"Title {i} In Capitals" for i in range(9)]
TEXTS += [" ".join([*(w := LONG.split())[:i], "changed", *w[i + 1 :]]) for i in range(0, 900, 23)]
ROWS = [(i, t, ["en", "fr", None, "EN"][i % 4], None if i % 5 == 0 else "s", None if i % 7 == 0 else i) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[7], ROWS[7], (None, LONG, "en", "s", 1), (None, None, None, None, None), (3, "same id", "fr", "s", 2)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """A folder with tables whose further columns are named like the operators' own."""
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    clash = ["g", "h", "n", "rank", "leaf", "root", "block", "node", "up", "fp", "key", "least", "q", "a", "b", "path"]
    spark.createDataFrame(ROWS, SCHEMA).select("*", *(F.lit(7).alias(c) for c in clash)).repartition(3).write.parquet(f"{at}/documents.parquet")
    r = np.random.default_rng(4)
    vecs = [(int(i), [float(x) for x in r.normal(0, 0.3, 8)], int(i % 3)) for i in range(900)]
    vecs += [(i, vecs[i - 1000][1], 1) for i in range(1000, 1200)]  # ties
    vecs += [vecs[5], (2000, None, 1), (2100, [1.0] * 8, None), (2200, [1.0, None] * 4, 1), (2300, [float("nan")] * 8, 1), (2400, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (2500, [2.0], 1), (2600, [0.0] * 8, 2), (100, vecs[100][1], 9)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<double>, label int").select("*", *(F.lit(7).alias(c) for c in clash)).repartition(5).write.parquet(f"{at}/embeddings.parquet")
    for name, schema in (("documents", SCHEMA), ("embeddings", "vec_id long, embedding array<double>, label int")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/none/{name}.parquet")
    return at, vecs


# --- 11 ---------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable at two differing bits for (id, fingerprint) pairs."""
    at = {fp: fp for _, fp in prints}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for a in list(at):
        for b in at:
            if (a ^ b).bit_count() <= 2:
                at[top(a)] = top(b)
    ids = {}
    for i, fp in prints:
        ids.setdefault(top(fp), []).append(i)
    return {fp: min((i for i in ids[top(fp)] if i is not None), default=None) for _, fp in prints}


def test_simhash_equals_brute_force(spark, sf):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op11_simhash(spark, sf[0]).collect()), key=repr)
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in ROWS]
    root = plain_components(prints)
    assert got == sorted(((i, f"{fp:016x}", root[fp]) for i, fp in prints), key=repr)
    assert len(set(root.values())) < len(set(fp for _, fp in prints))  # some different fingerprints are linked
    assert simhash.op11_simhash(spark, f"{sf[0]}/none").count() == 0


def test_long_text_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 50)
    assert simhash.fingerprint(LONG.encode()) == plain_fingerprint(LONG)
    assert simhash.fingerprint(b"x" * 500 + b" y") == plain_fingerprint("x" * 500 + " y")


@pytest.mark.parametrize("limit", [simhash.LIMIT, 1])
def test_no_link_is_lost_in_dense_buckets(spark, limit):
    r = random.Random(8)
    centre = r.getrandbits(64)
    some = {centre ^ m for m in range(500)} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in (r.sample(range(64), 3) for _ in range(1500))} | {r.getrandbits(64) for _ in range(500)}
    signed = np.array(sorted(some), np.uint64).view(np.int64)
    got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(int(x),) for x in signed], "fp long"), limit).collect()}
    want = set()
    for x in signed:
        apart = np.bitwise_count((signed ^ x).view(np.uint64))
        want |= {(int(x), int(y)) for y in signed[(apart <= 2) & (signed > x)]}
    assert got == want and len(want) > 10_000


# --- 12 ---------------------------------------------------------------------------------------------------------------------


def plain_negatives(vecs):
    one = {}
    for i, v, label in vecs:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            row = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
            one[i] = min(one.get(i, row), row)
    out = []
    for a, (label, q) in one.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), i, other) for i, (other, w) in one.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            hard = [(i, -n) for n, i, other in scored if other != label and 30 * -s <= 100 * -n <= 90 * -s]
            out += [(a, p, k, i, -s, n) for k, (i, n) in enumerate(hard[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("tree, every, chunk", [(negatives.TREE, negatives.PASS_BYTES, negatives.CHUNK), (3, 256, 64)])
def test_hard_negatives_equal_brute_force(spark, sf, monkeypatch, tree, every, chunk):
    for name, value in (("TREE", tree), ("PASS_BYTES", every), ("CHUNK", chunk)):
        monkeypatch.setattr(negatives, name, value)
    if tree == 3:
        monkeypatch.setattr(negatives, "TASK_ROWS", 100)
    got = sorted(tuple(r) for r in negatives.op12_hard_negatives(spark, sf[0]).collect())
    assert got == plain_negatives(sf[1]) and len(got) > 300
    assert negatives.op12_hard_negatives(spark, f"{sf[0]}/none").count() == 0


def test_large_components_stay_whole_numbers(spark):
    rows = spark.createDataFrame([(i, i % 2, [10**9 + i, 3 - i]) for i in range(0, 60)], "vec_id long, label long, q array<long>")
    got = negatives.hard_negatives(rows, rows.where("vec_id = 0"))
    assert got.count() == 0  # all scores are within a tenth of each other
    one = negatives.hard_negatives(rows.unionByName(spark.createDataFrame([(99, 1, [5 * 10**8 + 1, 0])], rows.schema)), rows.where("vec_id = 0")).where("positive_id = 58").first()
    assert (one.negative_id, one.negative_score) == (99, 10**9 * (5 * 10**8 + 1)) and one.positive_score == 10**9 * (10**9 + 58) + 3 * (3 - 58)


def test_bounds_spare_scores():
    r = np.random.default_rng(2)
    a = np.cumsum(r.integers(-2, 3, (60, 16)), 0).astype(float)  # anchors close to each other
    x = r.integers(-50, 50, (3000, 16)).astype(float)
    exact, seen = x @ a.T, 0
    for i, hit, score in negatives.bounded_scores(x, np.sqrt((x**2).sum(1)), a, negatives.spanning_tree(a), lambda i: (float(np.partition(exact[:, i], -5)[-5]), np.inf, np.ones(len(x), bool))):
        seen += len(hit)
        assert (score == exact[hit, i]).all() and set(np.argsort(-exact[:, i])[:5]) <= set(hit)
    assert seen < 0.5 * exact.size


# --- 13 ---------------------------------------------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes):
    """(top, siblings of each leaf as (left, right) by level)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            start = place // 8 * 8
            proofs[i].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 8])))
            at[i] = place // 8
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: digest(*map(field, (r[0], r[3], r[2], r[4], t)))
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    tops = {}
    for lang in langs:
        by[lang].sort(key=lambda x: x[:3])
        tops[lang] = climb([x[2] for x in by[lang]])
    root, above = climb([tops[v][0] for v in langs])
    out = []
    for lang, upper in zip(langs, above, strict=True):
        for (_, _, own, r), lower in zip(by[lang], tops[lang][1], strict=True):
            path = lower + upper
            now = leaf(r, r[1].translate(LOWER)) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None else own
            for left, right in path:
                now = digest(left, now, right)
            out.append((r[0], own, tops[lang][0], root, digest(*(x + y for x, y in path)), now, now == root))
    return sorted(out, key=repr)


def test_manifest_equals_plain_tree(spark, sf):
    got = sorted((tuple(r) for r in manifest.op13_manifest(spark, sf[0]).collect()), key=repr)
    assert got == plain_manifest(ROWS) and not all(r[-1] for r in got)
    assert manifest.op13_manifest(spark, f"{sf[0]}/none").count() == 0


@pytest.mark.parametrize("langs, rows", [(1, 1), (1, 9), (1, 700), (20, 150), (90, 1)])
def test_manifest_over_several_tiers(spark, tmp_path, monkeypatch, langs, rows):
    for name, value in (("LEVELS", 2), ("_BLOCK", 64)):
        monkeypatch.setattr(manifest, name, value)
    table = [(i, f"Text {i}", f"l{i % langs}", "s", i) for i in range(langs * rows)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in manifest.op13_manifest(spark, f"file://{tmp_path}").collect()), key=repr) == plain_manifest(table)


# --- 9: the sample's bound ---------------------------------------------------------------------------------------------------


def test_toxicity_sample_bound_is_decided_on_lengths(spark, monkeypatch):
    """A very long labelled text is left out of the fit without any task holding it beside the others."""
    from kinetable.llm import toxicity

    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append(texts) or {"share": len(texts) / 100})
    rows = [(i, "spiteful words" if i % 2 else "kind words") for i in range(40)] + [(100, "x" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    learnt = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5]
    model = toxicity.train(docs, labels, max_bytes=1_000_000)
    assert 0 < model["share"] * 100 <= len(learnt)
    assert toxicity.train(docs, labels)["share"] == len(learnt) / 100
    assert toxicity.train(docs.limit(0), labels) == {"share": 0.0}
