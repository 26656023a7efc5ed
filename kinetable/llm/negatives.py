"""Operator 12: hard negatives by anchor spanning-tree bounds.

Vectors are integers, a score is an inner product. The anchors (every hundredth id) are the stated queries. They are taken in
passes of ``PASS_BYTES`` at most, which go to every task; a task reads its share of all rows once a pass. In a pass, anchors are cut
into groups of ``TREE``, and each group is joined by a minimum spanning tree of Euclidean distances. The root is scored
exactly. From there on, a candidate's score at a child lies within edge length x candidate norm of its score (or of its
interval) at the parent. Only candidates whose interval overlaps the child's window are scored again; all others pass their widened
interval on. The window starts at what is already found: the fifth best positive so far, or for negatives the range that any
of the anchor's positives allows, less what ten better ones have closed. A task keeps its best few an anchor, Spark merges them.
So the first scan of a pass finds the positives, the second, with their scores as windows, the negatives.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; of rows that share an id the one
with the least (label, vector) does; shorter vectors count as padded with zeros; scores have to fit in a long; an anchor without
positives, or a positive without negatives, gives no rows; ties go to the smaller id; an empty table gives no rows. Other columns
aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, prepare, stored, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of its positive's.
LOW, HIGH = 30, 90
EVERY = 100
#: Bytes of anchors in a pass, and anchors of a spanning tree.
PASS_BYTES, TREE = 2 << 20, 256
#: Candidates that are bounded together, and rows of a task at most.
CHUNK, TASK_ROWS = 4096, 1 << 20
_NONE = -np.iinfo(np.int64).max


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, components as floor(256 x)."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    one = fit.select("vec_id", F.col("label").cast("long").alias("label"), q.alias("q")).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    return one.select("vec_id", "r.label", "r.q")


def spanning_tree(a: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(order, parent, edge): a minimum spanning tree of the rows of ``a``, parents before children; the root's parent is -1."""
    n = len(a)
    parent, edge, open_ = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    order, at = [], 0
    for _ in range(n):
        order.append(at)
        open_[at] = False
        far = np.sqrt(((a - a[at]) ** 2).sum(1))
        closer = open_ & (far < edge)
        edge[closer], parent[closer] = far[closer], at
        if open_.any():
            at = int(np.flatnonzero(open_)[np.argmin(edge[open_])])
    return order, parent, edge


def bounded_scores(x: np.ndarray, norm: np.ndarray, a: np.ndarray, tree: tuple, window):
    """(anchor, candidates, scores) down a tree for all candidates ``x`` that can be in the anchor's window; ``window`` gives (low, high,
    allowed candidates) when the anchor's turn comes."""
    order, parent, edge = tree
    middle, radius = np.empty((len(a), len(x))), np.empty((len(a), len(x)))
    for i in order:
        low, high, allowed = window(i)
        if parent[i] < 0:
            score = x @ a[i]
            middle[i], radius[i] = score, 0
            hit = np.flatnonzero(allowed & (score >= low) & (score <= high))
            yield i, hit, score[hit].astype(np.int64)
            continue
        m, r = middle[parent[i]], radius[parent[i]] + edge[i] * norm
        r = r + 1e-9 * (r + np.abs(m)) + 1e-3  # above any rounding
        hit = np.flatnonzero(allowed & (m + r >= low) & (m - r <= high))
        score = x[hit] @ a[i] if 4 * len(hit) < len(x) else (x @ a[i])[hit]
        middle[i], radius[i] = m, r
        middle[i, hit], radius[i, hit] = score, 0
        if len(hit):
            yield i, hit, score.astype(np.int64)


def _chunks(batches, dim: int, exact: bool):
    """(ids, labels, vectors, norms) of ``CHUNK`` candidates each, padded to ``dim``."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            q = part.column("q")
            size = np.diff(q.offsets.to_numpy())
            x = np.zeros((len(size), dim), np.float64 if exact else np.int64)
            x[np.arange(dim) < size[:, None]] = q.flatten().to_numpy()
            yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x, np.sqrt((x.astype(float) ** 2).sum(1))


def _merge(scores: np.ndarray, ids: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
    """Keep the first of ``scores``, ``ids`` (in place) and further ones: higher scores first, then smaller ids."""
    s, i = np.r_[scores, s], np.r_[ids, i]
    best = np.lexsort((i, -s))[: len(scores)]
    scores[:], ids[:] = s[best], i[best]


class _Pass:
    """The anchors of one pass: ids, labels, vectors and their trees."""

    def __init__(self, rows: list, dim: int, exact: bool):
        rows = sorted(rows, key=lambda r: (r.label, r.vec_id))
        self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("vec_id", "label"))
        self.a = np.array([list(r.q) + [0] * (dim - len(r.q)) for r in rows], np.float64 if exact else np.int64).reshape(len(rows), dim)
        self.dim, self.exact = dim, exact
        self.trees = [(start, spanning_tree(self.a[start : start + TREE].astype(float))) for start in range(0, len(rows), TREE)]

    def scored(self, x, norm, window):
        for start, tree in self.trees:
            for i, hit, score in bounded_scores(x, norm, self.a[start : start + TREE], tree, lambda i, start=start: window(start + i)):
                yield start + i, hit, score


def _positives(rows: DataFrame, anchors: _Pass) -> DataFrame:
    def run(batches):
        n = len(anchors.ids)
        best, who = np.full((n, POSITIVES), _NONE), np.full((n, POSITIVES), np.iinfo(np.int64).max)
        for ids, labels, x, norm in _chunks(batches, anchors.dim, anchors.exact):
            window = lambda i: (best[i, -1] if best[i, -1] > _NONE else -np.inf, np.inf, (labels == anchors.labels[i]) & (ids != anchors.ids[i]))  # noqa: B023, E731
            for i, hit, score in anchors.scored(x, norm, window):
                _merge(best[i], who[i], score, ids[hit])
        i, j = np.nonzero(best > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[i]), pa.array(who[i, j]), pa.array(best[i, j])], ["anchor_id", "positive_id", "positive_score"])

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= POSITIVES)


def _negatives(rows: DataFrame, anchors: _Pass, positives: list) -> DataFrame:
    place = {int(v): i for i, v in enumerate(anchors.ids)}
    wanted = [[] for _ in place]
    for r in sorted(positives, key=lambda r: r.r):
        wanted[place[r.anchor_id]].append((r.positive_id, r.positive_score, -(-LOW * r.positive_score // 100), HIGH * r.positive_score // 100))

    def run(batches):
        n = len(wanted)
        best, who = np.full((n, POSITIVES, NEGATIVES), _NONE), np.full((n, POSITIVES, NEGATIVES), np.iinfo(np.int64).max)

        def window(i, labels):
            low = min((max(w[2], int(best[i, j, -1])) for j, w in enumerate(wanted[i]) if w[2] <= w[3]), default=np.inf)
            return low, max((w[3] for w in wanted[i]), default=-np.inf), labels != anchors.labels[i]

        for ids, labels, x, norm in _chunks(batches, anchors.dim, anchors.exact):
            for i, hit, score in anchors.scored(x, norm, lambda i: window(i, labels)):  # noqa: B023
                for j, (_, _, low, high) in enumerate(wanted[i]):
                    fits = (score >= max(low, best[i, j, -1])) & (score <= high)
                    if fits.any():
                        _merge(best[i, j], who[i, j], score[fits], ids[hit[fits]])
        out = []
        for i, j, k in zip(*np.nonzero(best > _NONE), strict=True):
            out.append((int(anchors.ids[i]), *wanted[i][j][:2], int(who[i, j, k]), int(best[i, j, k])))
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names)

    found = rows.mapInArrow(run, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES)


def hard_negatives(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``vectors`` rows and those of them that are anchors."""
    spark = rows.sparkSession
    prepare(spark)
    rows = stored(rows, "negatives-vectors")
    peak = F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))).cast("double")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dim"), F.coalesce(F.max(peak), F.lit(0.0)).alias("peak")).first()
    exact = size.dim * size.peak**2 < 2**53  # whole numbers as doubles
    anchors = stored(anchors, "negatives-anchors")
    passes = max(1, -(-anchors.count() * max(1, size.dim) * 8 // PASS_BYTES))
    shares = rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-size.n // TASK_ROWS)))
    paths = []
    for p in range(passes):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).select("vec_id", "label", "q").collect()
        one = _Pass(mine, size.dim, exact)
        paths.append(stored(_negatives(shares, one, _positives(shares, one).collect()), "negatives-found"))
    out = spark.read.schema(paths[0].schema).parquet(*(t._stored_at for t in paths))
    discard(spark, rows, anchors)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op12_hard_negatives": op12_hard_negatives}
ORACLES = {
    "op12_hard_negatives": f"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % {EVERY} = 0
), p as (
  select anchor_id, other_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {POSITIVES}
)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank,
  other_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and {LOW} * positive_score <= 100 * score and 100 * score <= {HIGH} * positive_score
qualify rank <= {NEGATIVES}
"""
}
