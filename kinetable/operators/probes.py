"""Probes: how well one of many features predicts a target, with the choice made anew inside every training part, and its null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled
from .resample import uniform
from .stats import spearman

FOLDS = 5
PENALTIES = (1e0, 1e1, 1e2, 1e3, 1e4, 1e5)
PERMUTATIONS = 200
#: A probe holds if its correlation is this high and above the null's 99th percentile; it needs motion if still frames cost this much.
HOLDS, MOTION = 0.30, 0.30


def dealt(groups: np.ndarray, folds: int, seed: int) -> np.ndarray:
    """Fold of each row: the distinct groups in hashed order, dealt in turn."""
    _, at = np.unique(groups, return_inverse=True)
    n = int(at.max()) + 1 if len(at) else 0
    turn = np.empty(n, int)
    turn[np.argsort(uniform(np.full(n, seed), np.arange(1, n + 1)), kind="stable")] = np.arange(n) % folds
    return turn[at]


def shuffled(y: np.ndarray, clip: np.ndarray, times: int) -> np.ndarray:
    """(rows, times + 1): the target, then ``times`` permutations of it within each clip."""
    out = np.repeat(y[:, None], times + 1, 1)
    for c in np.unique(clip):
        rows = np.flatnonzero(clip == c)
        order = np.argsort(uniform(np.arange(1, times + 1)[:, None], np.arange(1, len(rows) + 1)[None]), 1, kind="stable")
        out[rows, 1:] = y[rows[order]].T
    return out


class RidgePath:
    """Ridge predictions of all penalties and targets from one eigendecomposition, of the products of columns or of rows, whichever are fewer."""

    def __init__(self, x: np.ndarray, targets: np.ndarray):
        wide = x.shape[1] > x.shape[0]
        self.values, vectors = np.linalg.eigh(x @ x.T if wide else x.T @ x)
        self.mean = targets.mean(0)
        self.vectors = x.T @ vectors if wide else vectors
        self.turned = vectors.T @ (targets - self.mean if wide else x.T @ (targets - self.mean))

    def predict(self, rows: np.ndarray, penalty: float) -> np.ndarray:
        """(rows, targets)"""
        return (rows @ self.vectors) @ (self.turned / (np.maximum(self.values, 0) + penalty)[:, None]) + self.mean


def best_penalties(x: np.ndarray, targets: np.ndarray, groups: np.ndarray, penalties: tuple, folds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the penalty, R squared) for each target by grouped folds of these rows; the first of equals. No R squared, -inf, for a constant target."""
    fold = dealt(groups, folds, seed)
    guess = np.zeros((len(penalties), *targets.shape))
    for f in np.unique(fold):
        out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        if not len(rest):
            guess[:, out] = targets[out].mean(0)
            continue
        path = RidgePath(x[rest], targets[rest])
        for i, penalty in enumerate(penalties):
            guess[i, out] = path.predict(x[out], penalty)
    total = ((targets - targets.mean(0)) ** 2).sum(0)
    r2 = np.where(total > 0, 1 - ((guess - targets) ** 2).sum(1) / np.where(total > 0, total, 1), -np.inf)
    return r2.argmax(0), r2.max(0)


def nested_ridge(features: DataFrame, cell: list[str], permutations: int = PERMUTATIONS, folds: int = FOLDS, penalties: tuple = PENALTIES) -> tuple[DataFrame, DataFrame]:
    """(predictions (cell, rep, fold, feature, penalty, item, still, guess, y), summary (cell, n, rho, p99, holds, rho_full, rho_still, needs_motion)).

    ``features`` has (cell, feature, item, clip, grp, still, vec, y): a row for each item and feature. For each outer fold of groups, feature and
    penalty are chosen by grouped folds of the training part; the held-out items are predicted with them. Replicates 1 to
    ``permutations`` go through the whole of it with the target permuted within its clip; ``p99`` is the 99th percentile of their rank
    correlations. Rows with ``still`` mirror the item of that id: never trained on, predicted where it is held out.

    One task has one feature of a cell and one outer fold; it holds the items of one probe, hundreds to thousands, whatever the number
    of cells. The choice between features is an aggregation over the tasks' scores."""
    keys = [*cell, "feature", "fold"]
    rows = features.select(*cell, "feature", "item", "clip", "grp", "still", "vec", F.col("y").cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        fold, part = int(part["fold"].iloc[0]), part.sort_values("item")
        own, still = part[~part["still"]], part[part["still"]]
        x = np.stack(own["vec"].to_numpy()).astype(float)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        x = (x - mean) / scale
        groups, item = own["grp"].to_numpy(), own["item"].to_numpy()
        y = shuffled(own["y"].to_numpy(float), own["clip"].to_numpy(), permutations)
        held = dealt(groups, folds, 1) == fold
        if not held.any() or held.all():
            return pd.DataFrame(columns=names)
        train = np.flatnonzero(~held)
        which, r2 = best_penalties(x[train], y[train], groups[train], penalties, folds, 2 + fold)
        path = RidgePath(x[train], y[train])
        guess = np.empty((int(held.sum()), permutations + 1))
        for i in np.unique(which):
            guess[:, which == i] = path.predict(x[held], penalties[i])[:, which == i]
        mirrors = still[still["item"].isin(item[held])]
        frozen = np.empty(0)
        if len(mirrors):
            z = (np.stack(mirrors["vec"].to_numpy()).astype(float) - mean) / scale
            frozen = path.predict(z, penalties[which[0]])[:, 0]
        first = {c: part[c].iloc[0] for c in keys}
        out = [
            {**first, "rep": t, "penalty": penalties[which[t]], "r2": r2[t], "items": item[held], "guesses": guess[:, t], "ys": y[held, t], "still_items": mirrors["item"].to_numpy() if t == 0 else [], "still_guesses": frozen if t == 0 else [], "still_ys": mirrors["y"].to_numpy(float) if t == 0 else []}
            for t in range(permutations + 1)
        ]
        return pd.DataFrame(out)[names]

    names = [*keys, "rep", "penalty", "r2", "items", "guesses", "ys", "still_items", "still_guesses", "still_ys"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    item = rows.schema["item"].dataType.simpleString()
    lists = ", ".join(f"{p}items array<{item}>, {p}guesses array<double>, {p}ys array<double>" for p in ("", "still_"))
    tried = rows.groupBy(*keys).applyInPandas(run, f"{kinds}, rep int, penalty double, r2 double, {lists}")
    # the highest score, the first feature by name of equals
    best = tried.groupBy(*cell, "fold", "rep").agg(F.max("r2").alias("best"), F.collect_list(F.struct("r2", "feature", F.struct("penalty", "items", "guesses", "ys", "still_items", "still_guesses", "still_ys").alias("of"))).alias("all"))
    # written once: predictions, mirrors and their keys are all read from it, and each reading would fit everything again
    chosen = settled(best.select(*cell, "fold", "rep", F.array_min(F.filter("all", lambda a: a["r2"] == F.col("best"))).alias("c")))

    def told(prefix: str) -> DataFrame:
        zipped = F.arrays_zip(*(F.col(f"c.of.{prefix}{n}").alias(n) for n in ("items", "guesses", "ys")))
        flat = chosen.select(*cell, "fold", "rep", "c.feature", "c.of.penalty", F.explode(zipped).alias("z"))
        return flat.select(*cell, "rep", "fold", "feature", "penalty", F.col("z.items").alias("item"), F.lit(prefix != "").alias("still"), F.col("z.guesses").alias("guess"), F.col("z.ys").alias("y"))

    predictions = told("").unionByName(told("still_"))
    return predictions, probe_summary(predictions, cell)


def probe_summary(predictions: DataFrame, cell: list[str]) -> DataFrame:
    """Correlations out of fold, those on items that have a still mirror, and on the mirrors, beside the null."""
    mirrored = predictions.where("still").select(*cell, "item").distinct()
    both = predictions.where("rep = 0 and not still").join(mirrored, [*cell, "item"], "left_semi").withColumn("side", F.lit("full"))
    sides = predictions.withColumn("side", F.when(F.col("still"), "still").otherwise("all")).unionByName(both)
    r = spearman(sides, [*cell, "side", "rep"], "guess", "y")
    pick = lambda side: F.max(F.when((F.col("side") == side) & (F.col("rep") == 0), F.col("rho")))
    null = F.percentile(F.when((F.col("side") == "all") & (F.col("rep") > 0), F.coalesce("rho", F.lit(0.0))), F.lit(0.99))  # of the replicates, whose number is fixed
    g = r.groupBy(*cell).agg(F.max(F.when((F.col("side") == "all") & (F.col("rep") == 0), F.col("n"))).alias("n"), pick("all").alias("rho"), null.alias("p99"), pick("full").alias("rho_full"), pick("still").alias("rho_still"))
    holds = (F.col("rho") >= HOLDS) & (F.col("p99").isNull() | (F.col("rho") > F.col("p99")))
    return g.withColumn("holds", F.coalesce(holds, F.lit(False))).withColumn("needs_motion", F.col("rho_still") <= F.col("rho_full") - MOTION)
