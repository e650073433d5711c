"""Places in an order, of groups of any size: by range partitions and sums of their counts, so no group is ordered in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


#: Rows of a task in spread().
TASK_ROWS = 1 << 17


def spread(rows: DataFrame, on: list[str], per: int = TASK_ROWS) -> DataFrame:
    """rows dealt by `on` over as many partitions as leave a task about `per` of them, whatever number is set for shuffles: what a task sorts or holds then
    does not grow with the input, but for a key of more rows than that, whose sort spills."""
    return rows.repartition(max(1, -(-rows.count() // per)), *on)


def placed(rows: DataFrame, group: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """rows with _i, the place in the order within the group (from 0, nulls first), and _n, the rows of the group. Rows alike in the order follow one
    another in any way, and are dealt over partitions too. Only the numbers of rows of a (group, partition) meet in a window. weight: a column that says for
    how many rows a row stands; _i and _n count those."""
    rows = written(rows, "rows").withColumn("_tie", F.monotonically_increasing_id())  # of a written table, numbers are the same at every reading
    by = [F.col(c).asc_nulls_first() for c in [*group, *order, "_tie"]]
    cut = rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    cut = written(cut, "placed").withColumn("_part", F.shiftright("_at", 33))
    parts = cut.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), (F.sum(weight) if weight else F.count("*")).alias("_rows"))
    w = Window.partitionBy(*group)
    before = F.sum("_rows").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    own = [F.col(c).alias(f"_g{k}") for k, c in enumerate(group)]
    parts = parts.select(*own, F.col("_part").alias("_p"), "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(w).alias("_n"))
    same: list[Column] = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)]
    out = cut.join(parts, reduce(Column.__and__, same, F.col("_part") == F.col("_p")))
    # Within a partition a row's place follows from its number; weights are summed up over the partition's rows of the group.
    own_place = F.col("_at") - F.col("_first")
    if weight:
        run = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        own_place = F.coalesce(F.sum(weight).over(run), F.lit(0))
    return out.withColumn("_i", own_place + F.col("_before")).select(*[c for c in rows.columns if c != "_tie"], "_i", "_n")
