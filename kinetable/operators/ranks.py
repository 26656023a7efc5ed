"""Order statistics of cells of any size.

Values are counted, then range-partitioned by (cell, value) and sorted, so that a cell with all rows is spread over all partitions.
What lies before a value is what lies before it in its own partition and the totals of the cell's earlier partitions; only
these totals, one row a partition and cell, meet in a window by cell. Equal values are one row and never straddle two partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import settled


def running(rows: DataFrame, cell: list[str], v: str, weight: str, next_value: bool = False) -> DataFrame:
    """``rows`` (one a cell and ``v``) with _before and _t: the sums of ``weight`` over the cell's smaller values and over all of them; and
    with _next, the cell's next value, if asked for. Nulls in cell columns are a cell of their own."""
    keys = [F.struct(*cell).alias("_cell")] if cell else [F.struct(F.lit(0).alias("_all")).alias("_cell")]
    placed = rows.select("*", *keys).repartitionByRange("_cell", v).sortWithinPartitions("_cell", v)
    placed = settled(placed.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    inside = Window.partitionBy("_cell", "_part").orderBy("_at")
    parts = placed.groupBy("_cell", "_part").agg(F.sum(weight).alias("_sum"), F.min(v).alias("_first"))
    of_cell = Window.partitionBy("_cell")
    earlier = F.coalesce(F.sum("_sum").over(of_cell.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    follows = F.lead("_first").over(of_cell.orderBy("_part"))
    parts = parts.select("_cell", "_part", earlier.alias("_earlier"), F.sum("_sum").over(of_cell).alias("_t"), follows.alias("_follows"))
    own = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = placed.withColumn("_own", own)
    if next_value:
        here = here.withColumn("_lead", F.lead(v).over(inside))
    here, parts = (d.withColumn("_key", F.to_json("_cell", {"ignoreNullFields": "false"})).drop("_cell") for d in (here, parts))
    out = here.join(parts, ["_key", "_part"])
    more = {"_before": F.col("_own") + F.col("_earlier")} | ({"_next": F.coalesce("_lead", "_follows")} if next_value else {})
    return out.withColumns(more).select(*rows.columns, *more, "_t")


def _sides(rows: DataFrame, cell: list[str], columns: dict[str, Column | str], weight: Column) -> DataFrame:
    """(cell, _side, _v, _n): counts of the distinct values of several columns, nulls left out."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("_side"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("_v")) for s, c in columns.items())))
    flat = rows.select(*cell, weight.alias("_w"), each.alias("_e")).select(*cell, "_w", "_e.*").where("_v is not null")
    return flat.groupBy(*cell, "_side", "_v").agg(F.sum("_w").alias("_n"))


def average_ranks(counts: DataFrame, cell: list[str], columns: list[str], n: str) -> DataFrame:
    """(cell, _side, _v, _rank): average ranks of the values of each column, a row standing for ``n`` items. One exchange for all columns."""
    c = running(_sides(counts, cell, {k: k for k in columns}, F.col(n)), [*cell, "_side"], "_v", "_n")
    return c.select(*cell, "_side", "_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias("_rank"))


#: Places (from 0, with weights) of a quantile among ``_t`` ordered values.
def middle(first: Column | int = 0, n: Column | None = None) -> list[tuple[Column, Column]]:
    """The median of ``n`` values from place ``first`` on."""
    n = F.col("_t") if n is None else n
    return [(first + F.floor((n - 1) / 2), F.lit(0.5)), (first + F.floor(n / 2), F.lit(0.5))]


def linear(p: float) -> list[tuple[Column, Column]]:
    """A quantile by linear interpolation."""
    at = (F.col("_t") - 1) * F.lit(p)
    low = F.floor(at)
    return [(low, 1 - (at - low)), (F.ceil(at), at - low)]


def index(k: Column) -> list[tuple[Column, Column]]:
    """The value at one place."""
    return [(k, F.lit(1.0))]


def quantiles(rows: DataFrame, cell: list[str], wanted: dict[str, tuple[Column | str, list]], weight: str | None = None) -> DataFrame:
    """(cell, names): each name is a weighted sum of the values at places of a column's ordered values, nulls left out; null without
    values. ``weight``: how often a row counts."""
    named = {str(c): c for c, _ in wanted.values()}
    c = running(_sides(rows, cell, named, F.lit(1) if weight is None else F.col(weight)), [*cell, "_side"], "_v", "_n")
    def at(side: str, place: Column) -> Column:
        return F.max(F.when((F.col("_side") == side) & (place >= F.col("_before")) & (place < F.col("_before") + F.col("_n")), F.col("_v")))

    picks, sums = [], []
    for name, (column, places) in wanted.items():
        terms = []
        for i, (place, share) in enumerate(places):
            picks += [at(str(column), place).alias(f"_{name}_{i}"), F.max(F.when(F.col("_side") == str(column), share)).alias(f"_{name}_{i}_w")]
            terms.append(F.when(F.col(f"_{name}_{i}_w") == 0, F.lit(0.0)).otherwise(F.col(f"_{name}_{i}") * F.col(f"_{name}_{i}_w")))
        sums.append(sum(terms[1:], terms[0]).alias(name))
    return c.groupBy(*cell).agg(*picks).select(*cell, *sums)
