"""Recent usage counts joined with the latest description of each item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def date_window(ts: Column, anchor: Column, days: int) -> Column:
    """Calendar dates from ``anchor - days`` to ``anchor``, inclusive on both ends."""
    return F.to_date(ts).between(F.date_sub(anchor, days), anchor)


def recent_counts(
    facts: DataFrame,
    anchor: Column | None = None,
    days: int = 7,
    min_count: int = 100,
    key: str = "project",
    ts: str = "timestamp",
) -> DataFrame:
    """Rows per spelling of the key inside the date window, kept at ``min_count`` and above.

    The window is stated on the timestamp itself, so it reaches the scan as a pushed filter.
    ``anchor`` defaults to the latest date in the facts.
    """
    if anchor is None:
        anchor = facts.agg(F.to_date(F.max(ts))).scalar()
    kind = facts.schema[ts].dataType.simpleString()
    first = F.date_sub(anchor, days).cast(kind)
    end = F.date_add(anchor, 1).cast(kind)
    return (
        facts.where((F.col(ts) >= first) & (F.col(ts) < end))
        .groupBy(F.lower(key).alias(f"{key}_lower"), key)
        .agg(F.count("*").alias("download_count"))
        .where(F.col("download_count") >= min_count)
    )


def latest_per_key(
    metadata: DataFrame,
    key: str = "name",
    ts: str = "upload_time",
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """The most recent row per lower-cased key.

    Row number 1 lets Spark drop all but one row per key before the shuffle, so a key with very
    many versions does not gather in one task.
    """
    rest = [c for c in metadata.columns if c != ts] if tie_break is None else tie_break
    newest_first = Window.partitionBy(f"{key}_lower").orderBy(
        F.col(ts).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in rest]
    )
    return (
        metadata.withColumn(f"{key}_lower", F.lower(key))
        .withColumn("_rn", F.row_number().over(newest_first))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def popular_items(
    facts: DataFrame,
    metadata: DataFrame,
    anchor: Column | None = None,
    days: int = 7,
    min_count: int = 100,
) -> DataFrame:
    """The raw dataset: one row per counted spelling with the latest metadata, most used first."""
    counts = recent_counts(facts, anchor, days, min_count)
    latest = latest_per_key(metadata)
    return (
        counts.join(latest, counts["project_lower"] == latest["name_lower"])
        .select(
            "name",
            "description",
            "description_content_type",
            "summary",
            F.col("version").alias("latest_version"),
            F.col("download_count").alias("number_of_downloads"),
        )
        .orderBy(F.col("number_of_downloads").desc(), "name")
    )
