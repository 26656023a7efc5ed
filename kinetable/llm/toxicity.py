"""Operator 9: toxicity by a linear-chain conditional random field.

Labels are known by document, so tokens are labelled first: a token of a toxic document is toxic if its word or one of
its affixes is among the few features that explain the toxic training documents against the clean ones. A CRF with two states (clean, toxic),
word and affix features and a transition matrix is fitted to these labelled tokens. Forward-backward marginals of every
token of every whole text give the offending offsets (marginal of 0.5 or more) and, through a logistic link fitted to the
document labels, the document's score.

The model is fitted in one task on at most ``max_toxic`` + ``max_clean`` training documents and at most ``max_bytes`` of their
text, chosen by a hash of their id (whole texts: one that would pass the bound is left out with those after it); everything
else covers all documents. Only the text enters a score.

Defined cases: a null or empty text has no token and the score of such a text (low); a row without a label or with a null
label isn't used for fitting; of repeated labels of a document the largest counts; rows with a null id are never in the
training folds' complement (held_out is false) and have no label; without a toxic or without a clean training document every score is
the share of toxic ones (0.0 without any). Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, id_text, prepare, regrouped, release, stored, table

#: Bounds of the training sample: documents and bytes of text.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 3000, 5000, 32 << 20
FOLDS = 5
#: Tokens of a training sequence.
PIECE = 256
_TOKENS = re.compile(r"\w+")
_CACHE_WORDS = 200_000
_BATCH_BYTES = 4 << 20
_SCHEMA = "doc_id long, score double, n_tokens long, expected_toxic double, spans array<struct<start:int,end:int,p:double>>"


def features(word: str) -> list[str]:
    """The word and its affixes."""
    w = word.lower()
    out = ["=" + w]
    out += ["^" + w[:n] for n in (3, 4, 5, 6) if len(w) > n]
    out += ["$" + w[-n:] for n in (4, 5) if len(w) > n]
    return out


def _key(feature: str) -> int:
    """Features are kept by a 64-bit hash, so that no table of their names is held."""
    return xxhash.xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass"))


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from long to short, and how many of them have a token at each step."""
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max()) if len(lengths) else 0
    return order, np.searchsorted(-lengths[order], -np.arange(1, most + 1), "right")


def marginals(logit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token, and the expected transitions (2 x 2). ``logit``: emission of toxic against clean;
    ``trans``: log weights from state to state. All documents advance one token a step, shorter ones drop out."""
    n = len(logit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    order, alive = _by_length(lengths)
    first = starts[order]
    t = np.exp(trans)
    e = np.exp(np.clip(logit, -30, 30))
    ahead, behind = np.empty(n), np.ones(n)  # odds of toxic from the left (own emission in) and from the right (out)
    odds = None
    for k, m in enumerate(alive.tolist()):
        at = first[:m] + k
        odds = e[at] if odds is None else e[at] * (t[0, 1] + odds[:m] * t[1, 1]) / (t[0, 0] + odds[:m] * t[1, 0])
        ahead[at] = odds
    for k in range(len(alive) - 1, 0, -1):
        at = first[: alive[k]] + k
        r = behind[at] * e[at]
        behind[at - 1] = (t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r)
    p = ahead * behind
    p /= 1 + p
    inner = np.ones(n, bool)
    inner[starts[lengths > 0]] = False
    at = np.flatnonzero(inner)
    a, r = ahead[at - 1], behind[at] * e[at]
    all_ = t[0, 0] + t[0, 1] * r + a * (t[1, 0] + t[1, 1] * r)
    ways = (t[0, 0] / all_).sum(), (t[0, 1] * r / all_).sum(), (t[1, 0] * a / all_).sum(), (t[1, 1] * a * r / all_).sum()
    return p, np.array(ways).reshape(2, 2)


def _telling(feat_of: np.ndarray, bounds: np.ndarray, docs: list[np.ndarray], toxic: list[int], lengths: np.ndarray, least: float = 15.0) -> np.ndarray:
    """Features that tell toxic documents: the one with the highest likelihood ratio is taken, the toxic documents with it
    are explained and leave, and so on while the ratio is over ``least`` and the rate five times that of clean documents.
    So copies of a toxic text don't make all of its words toxic: a few features explain them all. Of features nearly as
    telling as the best the longest is taken: a word before its beginning. The features of word w are
    ``feat_of[bounds[w]:bounds[w + 1]]``; ``docs`` has the distinct words of each document."""
    n_features = len(lengths)
    n1, n0 = np.zeros(n_features), np.zeros(n_features)
    left = []
    for words, y in zip(docs, toxic, strict=True):
        n = bounds[words + 1] - bounds[words]
        seen = np.unique(feat_of[np.repeat(bounds[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        (n1 if y else n0)[seen] += 1
        if y:
            left.append(seen)
    t0 = max(len(toxic) - sum(toxic), 1)
    out = np.zeros(n_features, bool)
    some = np.flatnonzero(n1 >= 3)
    n0 = n0[some]
    width = lengths[some]
    place = np.full(n_features, -1)
    place[some] = np.arange(len(some))
    left = [place[x][place[x] >= 0] for x in left]

    def ll(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    while left and len(some):
        t1 = len(left)
        k = np.bincount(np.concatenate(left), minlength=len(some)).astype(float)
        both = (k + n0) / (t1 + t0)
        g2 = 2 * (ll(k, t1, k / t1) + ll(n0, t0, n0 / t0) - ll(k, t1, both) - ll(n0, t0, both))
        g2[k / t1 <= 5 * (n0 + 0.5) / t0] = 0
        close = np.flatnonzero(g2 >= 0.9 * g2.max())
        best = int(close[np.lexsort((g2[close], width[close]))[-1]])
        if g2[best] < least:
            break
        out[some[best]] = True
        left = [x for x in left if best not in x]
    return out


def _link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
    return w


def _evidence(p: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: log of minus the log chance that no token is toxic (tokens under 0.05 don't add up to evidence)."""
    c = np.r_[0, np.cumsum(np.where(p < 0.05, 0, -np.log1p(-np.minimum(p, 1 - 1e-9))))]
    return np.log(c[starts + lengths] - c[starts] + 1e-2)[:, None]


def fit(texts: list[str], toxic: list[int], steps: int = 40) -> dict:
    """CRF and link fitted to labelled documents."""
    share = sum(toxic) / len(toxic) if toxic else 0.0
    if not 0 < share < 1:
        return {"share": share}
    number: dict[str, int] = {}
    tokens = [np.fromiter((number.setdefault(w, len(number)) for w in _TOKENS.findall(t)), np.int32) for t in texts]
    keys, widths, counts = array("Q"), array("H"), array("H")
    for w in number:
        fs = features(w)
        keys.extend(map(_key, fs))
        widths.extend(min(len(f), 60_000) for f in fs)
        counts.append(len(fs))
    n_words = len(number)
    del number
    raw = np.frombuffer(keys, np.uint64)
    names = np.unique(raw)
    feat_of = np.searchsorted(names, raw).astype(np.int32)
    feat_length = np.zeros(len(names), np.int64)
    feat_length[feat_of] = np.frombuffer(widths, np.uint16)
    del raw, keys, widths
    counts = np.frombuffer(counts, np.uint16).astype(np.int64)
    bounds = np.r_[0, np.cumsum(counts)]
    word_of = np.repeat(np.arange(n_words, dtype=np.int32), counts)
    often = _telling(feat_of, bounds, [np.unique(t) for t in tokens], toxic, feat_length)
    bad_word = np.bincount(word_of, often[feat_of], n_words) > 0

    lengths = np.array([len(t) for t in tokens], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(tokens) if len(texts) else np.zeros(0, np.int64)
    y = bad_word[flat] & np.repeat(np.array(toxic, bool), lengths)
    # for fitting, long sequences are cut, so that a step takes as many passes as the longest piece has tokens
    cut = np.unique(np.concatenate([starts[lengths > 0], *(np.arange(a, a + n, PIECE) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True) if n > PIECE)]))
    piece_lengths = np.diff(np.r_[cut, len(flat)])
    inner = np.ones(len(flat), bool)
    inner[cut] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2).astype(float)

    theta, bias, trans = np.zeros(len(names)), -4.0, np.log(np.array([[0.98, 0.02], [0.7, 0.3]]))
    g_theta, g_bias, g_trans = np.full(len(names), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    per_word = np.bincount(flat[y], minlength=n_words).astype(float)
    for _ in range(steps):
        logit = bias + np.bincount(word_of, theta[feat_of], n_words)
        p, moved = marginals(logit[flat], cut, piece_lengths, trans)
        off = per_word - np.bincount(flat, p, n_words)
        grad = np.bincount(feat_of, off[word_of], len(names)) - 0.05 * theta
        g_theta += grad**2
        theta += 0.6 * grad / np.sqrt(g_theta)
        d = off.sum() - 0.05 * bias
        g_bias += d**2
        bias += 0.3 * d / math.sqrt(g_bias)
        d = seen - moved
        g_trans += d**2
        trans = trans + 0.2 * d / np.sqrt(g_trans)
    p, _ = marginals((bias + np.bincount(word_of, theta[feat_of], n_words))[flat], starts, lengths, trans)
    link = _link(_evidence(p, starts, lengths), np.array(toxic, float))
    keep = np.abs(theta) >= 0.01
    strong = dict(zip(names[keep].tolist(), theta[keep].tolist(), strict=True))
    return {"share": share, "theta": strong, "bias": float(bias), "trans": trans, "link": link}


class Scorer:
    """Scores texts with a fitted model."""

    def __init__(self, model: dict):
        self.model, self.cache = model, {}

    def _logit(self, word: str) -> float:
        found = self.cache.get(word)
        if found is None:
            theta = self.model["theta"]
            found = self.model["bias"] + sum(theta.get(_key(f), 0.0) for f in features(word))
            if len(self.cache) >= _CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def __call__(self, texts: list[str]) -> list[tuple]:
        """(score, tokens, expected toxic tokens, offending spans) of each text."""
        if "theta" not in self.model:
            return [(self.model["share"], len(_TOKENS.findall(t)), 0.0, []) for t in texts]
        words = [_TOKENS.findall(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths) - lengths
        get, slow = self.cache.get, self._logit
        logit = np.array([x if (x := get(w)) is not None else slow(w) for ws in words for w in ws], float)
        p, _ = marginals(logit, starts, lengths, self.model["trans"])
        link = self.model["link"]
        score = 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(texts)), _evidence(p, starts, lengths)] @ link, -30, 30)))
        out = []
        hit = np.flatnonzero(p >= 0.5)
        cuts = np.searchsorted(hit, np.r_[starts, len(p)])
        sums = np.r_[0, np.cumsum(p)]
        for k, text in enumerate(texts):
            here = (hit[cuts[k] : cuts[k + 1]] - starts[k]).tolist()
            spans = []
            if here:
                wanted = set(here)
                spans = [{"start": m.start(), "end": m.end(), "p": float(p[starts[k] + i])} for i, m in enumerate(_TOKENS.finditer(text)) if i in wanted]
            out.append((float(score[k]), int(lengths[k]), float(sums[starts[k] + lengths[k]] - sums[starts[k]]), spans))
        return out


def held_out(doc_id: Column) -> Column:
    """True for the fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES) -> dict:
    """Model fitted to labelled documents (doc_id, text) x (doc_id, toxic) outside of the held-out fold."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    chosen = known.where("toxic = 1").orderBy(order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(order).limit(max_clean))
    # each document once, in case ids repeat: the sample's bound holds for texts too
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # the bound on bytes is decided on lengths alone, before any texts meet
    rows = stored(rows.withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), "toxicity-sample")
    so_far = F.sum("_size").over(Window.orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    within = rows.select("doc_id", "_size").withColumn("_bytes", so_far).where(F.col("_bytes") <= max_bytes).select("doc_id")

    def run(batches):
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        got.sort(key=lambda r: r[0])
        model = fit([t or "" for _, t, _ in got], [int(y) for _, _, y in got])
        del got
        release()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    some = rows.join(F.broadcast(within), "doc_id", "left_semi").select("doc_id", "text", "toxic")  # of 8,000 ids at most
    found = some.coalesce(1).mapInArrow(run, "model binary").collect()
    discard(spark, rows)
    return pickle.loads(found[0].model) if found else {"share": 0.0}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, n_tokens, expected_toxic, spans) of every whole text."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for part in regrouped(batches, _BATCH_BYTES):
            rows = scorer(part.column(1).to_pylist())
            s, n, e, spans = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            out = pa.table([part.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(e, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "n_tokens", "expected_toxic", "spans"])
            yield from out.to_batches()

    return id_text(docs).mapInArrow(run, _SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model learnt from ``labels``; see ``score`` for the columns."""
    return score(docs, train(docs, labels))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, with all their columns."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs, labels))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))

    def run(batches):
        scorer = Scorer(sent.value)
        for part in regrouped(batches, _BATCH_BYTES, "_row"):
            row = part.column("_row").combine_chunks()
            texts = pc.fill_null(pc.struct_field(row, "text"), "").to_pylist()
            clean = pa.array([s < threshold for s, *_ in scorer(texts)], pa.bool_())
            yield from part.select(["_row"]).filter(clean).to_batches()
        del scorer
        release()

    return packed.mapInArrow(run, packed.schema).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "expected_toxic", "spans")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
