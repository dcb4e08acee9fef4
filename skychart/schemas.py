"""Declared schemas of every stage table; nothing is inferred from the files."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def schema(columns: str) -> T.StructType:
    """A schema from ``name TYPE, ...``; unlike a parsed DDL text it needs no running session."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DOWNLOAD_FACTS = schema("timestamp TIMESTAMP, project STRING")

DISTRIBUTION_METADATA = schema(
    "name STRING, description STRING, description_content_type STRING, summary STRING, "
    "version STRING, upload_time TIMESTAMP"
)

RAW_DATASET = schema(
    "name STRING, description STRING, description_content_type STRING, summary STRING, "
    "latest_version STRING, number_of_downloads STRING"
)

PROCESSED_DATASET = schema(
    "name STRING, description STRING, description_content_type STRING, summary STRING, "
    "latest_version STRING, weekly_downloads BIGINT, description_cleaned STRING"
)

EMBEDDINGS = schema("name STRING, embeddings ARRAY<FLOAT>")

CLUSTERED_DATASET = schema(
    "name STRING, weekly_downloads BIGINT, summary STRING, cluster_id INT, x DOUBLE, y DOUBLE"
)

CLUSTER_LABELS = schema("cluster_id INT, cluster_label STRING")

CLUSTER_METADATA = schema(
    "cluster_id INT, centroid_x DOUBLE, centroid_y DOUBLE, total_weekly_downloads BIGINT, "
    "min_x DOUBLE, max_x DOUBLE, min_y DOUBLE, max_y DOUBLE"
)

CONSTELLATIONS = schema(
    "cluster_id INT, from_package STRING, to_package STRING, "
    "from_x DOUBLE, from_y DOUBLE, to_x DOUBLE, to_y DOUBLE"
)

PACKAGES_JSON = schema(
    "id BIGINT, name STRING, summary STRING, downloads BIGINT, x DOUBLE, y DOUBLE, clusterId INT"
)

CLUSTERS_JSON = schema(
    "clusterId INT, label STRING, centroidX DOUBLE, centroidY DOUBLE, downloads BIGINT, "
    "minX DOUBLE, maxX DOUBLE, minY DOUBLE, maxY DOUBLE"
)

CONSTELLATIONS_JSON = schema(
    "clusterId INT, fromId BIGINT, toId BIGINT, fromX DOUBLE, fromY DOUBLE, toX DOUBLE, toY DOUBLE"
)
