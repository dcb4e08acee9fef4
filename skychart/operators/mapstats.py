"""Summaries of the map: per cluster, over all points, and the columns scaled by them.

Every whole-table figure is a one-row aggregate used as a scalar subquery, so it is computed once
with partial aggregation and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychart.functions import scaling
from skychart.operators.clean import fill_null_downloads
from skychart.operators.ranking import exact_medians

NOISE = -1


def cluster_metadata(points: DataFrame) -> DataFrame:
    """Centroid, usage total and bounding box per cluster, the noise row included."""
    return points.groupBy("cluster_id").agg(
        F.avg("x").alias("centroid_x"),
        F.avg("y").alias("centroid_y"),
        F.coalesce(F.sum("weekly_downloads"), F.lit(0)).cast("bigint").alias("total_weekly_downloads"),
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def distinct_clusters(points: DataFrame) -> DataFrame:
    return points.select("cluster_id").distinct().orderBy("cluster_id")


def exclude_noise(points: DataFrame) -> DataFrame:
    return points.where(F.col("cluster_id") != NOISE)


def data_bounds(points: DataFrame) -> DataFrame:
    """One row with the bounding box, its size and centre; no row without points."""
    box = points.agg(
        F.min("x").alias("min_x"),
        F.max("x").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    ).where(F.col("min_x").isNotNull())
    width, height = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return box.select(
        "*",
        width.alias("width"),
        height.alias("height"),
        (F.col("min_x") + width / 2).alias("center_x"),
        (F.col("min_y") + height / 2).alias("center_y"),
    )


def download_range(points: DataFrame, column: str = "weekly_downloads") -> DataFrame:
    return points.agg(F.min(column).alias("min_downloads"), F.max(column).alias("max_downloads"))


def run_stats(points: DataFrame) -> DataFrame:
    """Row count, extreme downloads, number of clusters and of noise points, in one pass."""
    cluster = F.col("cluster_id")
    return points.agg(
        F.count("*").alias("n_rows"),
        F.max("weekly_downloads").alias("max_downloads"),
        F.min("weekly_downloads").alias("min_downloads"),
        F.countDistinct(F.when(cluster != NOISE, cluster)).alias("n_clusters"),
        F.count_if(cluster == NOISE).alias("n_noise"),
    )


def median_center(points: DataFrame) -> DataFrame:
    """One row with the exact median of each axis."""
    return exact_medians(points, ["x", "y"])


def log_radius_scale(points: DataFrame) -> DataFrame:
    """Pull points towards the median centre: a radius r becomes ``log(1 + r)``."""
    center = median_center(points).select(F.struct("x", "y")).scalar()
    dx, dy = F.col("x") - F.col("_cx"), F.col("y") - F.col("_cy")
    radius = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    factor = F.log1p(F.col("_r")) / F.when(F.col("_r") == 0, F.lit(1e-8)).otherwise(F.col("_r"))
    return (
        points.withColumn("_c", center)
        .withColumns({"_cx": F.col("_c.x"), "_cy": F.col("_c.y")})
        .withColumns({"_dx": dx, "_dy": dy})
        .withColumn("_r", radius)
        .withColumn("_f", factor)
        .withColumns(
            {
                "x": F.col("_dx") * F.col("_f") + F.col("_cx"),
                "y": F.col("_dy") * F.col("_f") + F.col("_cy"),
            }
        )
        .select(*points.columns)
    )


def with_size(
    points: DataFrame,
    min_size: float,
    max_size: float,
    gamma: float = 1.0,
    column: str = "weekly_downloads",
    out: str = "size",
) -> DataFrame:
    """Add the log-scaled size of every point, relative to the range over all points."""
    bounds = points.agg(F.struct(F.min(column).alias("low"), F.max(column).alias("high"))).scalar()
    return (
        points.withColumn("_range", bounds)
        .withColumn(
            out,
            scaling.log_size(
                F.col(column), F.col("_range.low"), F.col("_range.high"), min_size, max_size, gamma
            ),
        )
        .drop("_range")
    )


def point_sizes(points: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Sizes of the drawn points, 12 to 80."""
    return with_size(points, 12, 80, gamma)


def unlabeled_plot_table(points: DataFrame) -> DataFrame:
    """Plot rows: null downloads as 0, sizes 16 to 128."""
    return with_size(fill_null_downloads(points), 16, 128)


def labeled_plot_table(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Plot rows with the label of their cluster, ``Unclustered`` where there is none."""
    named = points.join(labels.select("cluster_id", "cluster_label"), "cluster_id", "left")
    return unlabeled_plot_table(named.withColumn("cluster_label", default_label(F.col("cluster_label"))))


def default_label(label: Column) -> Column:
    return F.coalesce(label, F.lit("Unclustered"))
