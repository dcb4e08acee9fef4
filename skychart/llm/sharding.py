"""Contiguous shards of near-equal bytes, cut on a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skychart.sources.workspace import Workspace

# Bytes counted for a row besides its text.
ROW_BYTES = 16


def sized(docs: DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """(doc_id, size, text_crc32) of every row; a null text counts as no bytes and has the checksum of none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(row_bytes)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def contiguous_shards(rows: DataFrame, n_shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to (doc_id, size, text_crc32) rows.

    Rows stand in the order of doc_id (null first), then text_crc32 and size; rows equal in all three
    are interchangeable. A row goes to the shard in which the middle of its bytes falls when the whole
    order is cut into ``n_shards`` equal byte ranges, so every shard misses its target by at most one
    row at each end. ``slot`` counts the rows of a shard from 0 in the same order.

    Only one row per partition (its bytes and rows) and one per shard are brought together; the row
    table is range-partitioned once, without the texts, and written once, since a second evaluation could
    draw other range bounds. Other columns are carried along. An empty table gives an empty result; with fewer rows than shards some
    shards stay empty; a row larger than a whole target leaves the shards it covers empty.
    """
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    space = Workspace(rows.sparkSession)
    placed = space.write(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
        "placed",
    )
    inside = Window.partitionBy("_part").orderBy("_row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns(
        {
            "_bytes": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "_rows": F.row_number().over(inside) - 1,
        }
    )
    # One row per partition: its totals, summed over the partitions before it.
    parts = placed.groupBy("_part").agg(F.sum("size").alias("_part_bytes"), F.count("*").alias("_part_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = parts.select(
        "_part",
        F.coalesce(F.sum("_part_bytes").over(earlier), F.lit(0)).alias("_bytes_offset"),
        F.coalesce(F.sum("_part_rows").over(earlier), F.lit(0)).alias("_rows_offset"),
        F.sum("_part_bytes").over(whole).alias("_total"),
    )
    # Integers up to 100 TB times some thousand shards stay within 64 bits.
    cut = F.expr(f"(2 * (_bytes_offset + _bytes) + size) * {n_shards} div (2 * _total)")
    located = placed.join(F.broadcast(offsets), "_part").withColumns(
        {
            "shard": F.least(cut, F.lit(n_shards - 1)).cast("int"),
            "_position": F.col("_rows_offset") + F.col("_rows"),
        }
    )
    starts = located.groupBy("shard").agg(F.min("_position").alias("_start"))
    return located.join(F.broadcast(starts), "shard").select(
        *rows.columns, "shard", (F.col("_position") - F.col("_start")).cast("bigint").alias("slot")
    )
