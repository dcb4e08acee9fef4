"""Global and per-group positions without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.sources.workspace import Workspace


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    group: Sequence[str] = (),
    weight: Column | None = None,
    out: str = "position",
) -> DataFrame:
    """Add the sum of ``weight`` (default: the number of rows) over all earlier rows of the group.

    ``order`` must be total. Rows are range-partitioned by group and order, so a group holding a
    third of all rows spreads over as many tasks as it needs; each partition knows its own running
    sum and only one offset per (partition, group) is exchanged. The partitioned rows are written
    once, because a second evaluation could sample other range bounds.
    """
    group = list(group)
    keys = [F.col(c).asc() for c in group] + list(order)
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    if weight is not None:
        placed = placed.withColumn("_weight", weight.cast("bigint"))
    placed = Workspace(df.sparkSession).write(placed, "placed")

    in_part = [*group, "_part"]
    if weight is None:
        totals = placed.groupBy(*in_part).agg(F.count("*").alias("_sum"), F.min("_row").alias("_first"))
        inside = F.col("_row") - F.col("_first")
    else:
        totals = placed.groupBy(*in_part).agg(F.sum("_weight").alias("_sum"))
        earlier = Window.partitionBy(*in_part).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_inside", F.coalesce(F.sum("_weight").over(earlier), F.lit(0)))
        inside = F.col("_inside")

    # One row per partition and group: bounded by partitions + groups, whatever the row count.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    for c in in_part:
        offsets = offsets.withColumnRenamed(c, f"_o_{c}")
    same = [placed[c].eqNullSafe(offsets[f"_o_{c}"]) for c in in_part]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return (
        placed.join(offsets, condition)
        .withColumn(out, (F.col("_offset") + inside).cast("bigint"))
        .select(*df.columns, out)
    )


def global_dense_id(df: DataFrame, order: Sequence[Column], out: str = "id") -> DataFrame:
    """Ids 0..n-1 in the given total order."""
    return running_total(df, order, out=out)


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row holding the exact median per column: the middle value, or the mean of the middle two.

    Equal values are counted first, so a frequent value costs one row; the counts of all columns
    are then placed in one pass.
    """
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("_axis"), F.col(c).alias("_v")) for i, c in enumerate(columns)]))
    counts = (
        df.select(values.alias("_e"))
        .select("_e._axis", "_e._v")
        .where(F.col("_v").isNotNull())
        .groupBy("_axis", "_v")
        .agg(F.count("*").alias("_n"))
    )
    placed = running_total(counts, [F.col("_v").asc()], ["_axis"], weight=F.col("_n"), out="_before")
    totals = placed.groupBy("_axis").agg(F.sum("_n").alias("_total"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)

    def at(position: Column) -> Column:
        holds = (F.col("_before") <= position) & (position < F.col("_before") + F.col("_n"))
        return F.when(holds, F.col("_v"))

    joined = placed.join(totals, "_axis").withColumns({"_low": at(low), "_high": at(high)})
    return joined.agg(
        *[
            (
                (
                    F.max(F.when(F.col("_axis") == i, F.col("_low")))
                    + F.max(F.when(F.col("_axis") == i, F.col("_high")))
                )
                / 2
            ).alias(c)
            for i, c in enumerate(columns)
        ]
    )
