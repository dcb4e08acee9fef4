"""The whole pipeline: from raw rows to the record sets the map is served from."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skychart.functions.markup import content_type
from skychart.functions.text import extract_text
from skychart.operators import clean, density, labels, layout, mapstats, outputs
from skychart.operators.constellations import constellations
from skychart.operators.embed import Encoder, embed_text
from skychart.operators.ranking import global_dense_id
from skychart.operators.spread import spread
from skychart.sources import files
from skychart.sources.workspace import Workspace, scope

MAP_NEIGHBORS = 12


@dataclass(frozen=True)
class MapSettings:
    """What a run can be told; the defaults are the documented ones."""

    top_packages: int | None = 10_000
    batch_size: int = 128
    # None: the shipped encoder, fitted on the texts.
    encoder_factory: Callable[[], Encoder] | None = None
    neighbors: str = "descent"
    tree: str = "graph"
    reduced_dimensions: int = 16
    epochs: int = layout.EPOCHS
    min_cluster_size: int = 8
    min_samples: int = 2
    eps: float = 0.0085
    persistence: float = 0.1
    labeler: Callable[[DataFrame], DataFrame] = field(default=labels.top_terms)
    overwrite: bool = True


def process(raw: DataFrame, settings: MapSettings) -> DataFrame:
    """Clean rows, keep the most used ones, then extract their texts: the costly step runs last."""
    kept = spread(clean.top_n(clean.read_raw(raw), settings.top_packages))
    kind = content_type(F.col("description"), F.col("description_content_type"))
    return kept.withColumn("description_cleaned", extract_text(F.col("description"), kind))


def embed(processed: DataFrame, settings: MapSettings) -> DataFrame:
    text = clean.combine_text(processed).select("name", "summary_and_description_cleaned")
    vectors = embed_text(
        text, "summary_and_description_cleaned", settings.encoder_factory, batch_size=settings.batch_size
    )
    return vectors.select("name", "embeddings")


def cluster(processed: DataFrame, embeddings: DataFrame, settings: MapSettings) -> DataFrame:
    """Cluster ids and map coordinates; wide vectors stay out of the join with the texts."""
    numbered = global_dense_id(embeddings, [F.col("name").asc()]).withColumnRenamed("embeddings", "vec")
    space = Workspace(processed.sparkSession)
    numbered = space.write(numbered, "numbered")
    vectors = numbered.select("id", "vec")
    # Both reductions look at the same neighbours; the second at two more of them.
    knn = space.write(layout.neighbors(layout.unit_vectors(vectors), MAP_NEIGHBORS - 1, settings.neighbors), "knn")
    reduced = layout.reduce_dims(vectors, settings.reduced_dimensions, epochs=settings.epochs, knn=knn)
    reduced = space.write(reduced, "reduced")
    found = density.density_clusters(
        reduced, settings.min_cluster_size, settings.min_samples, settings.eps, settings.persistence, settings.tree
    )
    found = space.write(found, "found")
    coordinates = layout.map_coordinates(
        vectors, found.withColumnRenamed("cluster_id", "label"), MAP_NEIGHBORS, epochs=settings.epochs, knn=knn
    )
    placed = mapstats.log_radius_scale(coordinates).join(found, "id")
    return clustered_dataset(numbered.select("id", "name").join(placed, "id").drop("id"), processed)


def clustered_dataset(placed: DataFrame, processed: DataFrame) -> DataFrame:
    """Placed points with the metadata of their item, most used first."""
    meta = processed.select("name", "weekly_downloads", "summary")
    joined = placed.join(meta, "name", "left")
    return clean.sort_by_downloads(
        joined.select("name", "weekly_downloads", "summary", "cluster_id", "x", "y")
    )


# What each stage is built from: settings it looks at, and earlier stages.
STAGES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "processed_dataset": (("top_packages",), ("raw",)),
    "embeddings": (("encoder_factory", "batch_size"), ("processed_dataset",)),
    "clustered_dataset": (
        ("neighbors", "tree", "reduced_dimensions", "epochs", "min_cluster_size", "min_samples", "eps", "persistence"),
        ("processed_dataset", "embeddings"),
    ),
    "cluster_labels": (("labeler",), ("clustered_dataset",)),
    "cluster_metadata": ((), ("clustered_dataset",)),
    "constellations": ((), ("clustered_dataset",)),
    "numbered": ((), ("clustered_dataset",)),
    "packages": ((), ("numbered",)),
    "clusters": ((), ("cluster_labels", "cluster_metadata")),
    "links": ((), ("constellations", "numbered")),
}


class Manifests:
    """Which stages of a folder are complete, and what they were built from.

    A stage's manifest names the settings it looked at, the versions of its inputs, its columns and its own version. It is removed
    before the stage is built and written after it, so a stage that was broken off has none. A stage is only skipped
    while its manifest says what a new one would say; a changed setting or input rebuilds it and all that follows from it.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: MapSettings):
        self.spark, self.folder, self.settings = spark, folder, settings
        self.versions: dict[str, str] = {}

    def wanted(self, stage: str) -> dict[str, object]:
        names, inputs = STAGES[stage]
        return {"settings": {n: _told(getattr(self.settings, n)) for n in names}, "inputs": {i: self.versions[i] for i in inputs}}

    def _path(self, stage: str) -> str:
        return f"{self.folder}/_manifests/{stage}"

    def complete(self, stage: str) -> bool:
        if not _exists(self.spark, self._path(stage)):
            return False
        said = json.loads(self.spark.read.text(self._path(stage)).first()[0])
        if {k: said[k] for k in ("settings", "inputs")} != self.wanted(stage):
            return False
        self.versions[stage] = said["version"]
        return True

    def begin(self, stage: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(stage))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def finish(self, stage: str, columns: list[str]) -> None:
        self.versions[stage] = uuid.uuid4().hex
        said = {**self.wanted(stage), "columns": columns, "version": self.versions[stage]}
        row = self.spark.createDataFrame([(json.dumps(said, sort_keys=True),)], "value string")
        row.coalesce(1).write.mode("overwrite").text(self._path(stage))


def _told(value: object) -> object:
    """A setting as text that changes when the setting does; functions go by their names."""
    if callable(value):
        return f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', repr(value))}"
    return value


def input_version(raw: DataFrame) -> str:
    """A number for the rows of a table, whatever their order: its row count and the sum of the rows' hashes."""
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in raw.columns]).cast("decimal(38, 0)")
    n, total = raw.agg(F.count("*"), F.sum(digest)).first()
    return f"{','.join(raw.columns)}:{n}:{total}"


def run_pipeline(
    raw: DataFrame, folder: str, settings: MapSettings | None = None, version: str | None = None
) -> dict[str, DataFrame]:
    """All stages in order; every stage table is written and the next stage reads it back.

    With ``overwrite=False`` a stage is skipped where its manifest shows that the same settings and inputs built it. ``version`` names
    the state of ``raw``; without one its rows are hashed, in one pass.
    """
    settings = settings or MapSettings()
    spark = raw.sparkSession
    manifests = Manifests(spark, folder, settings)
    manifests.versions["raw"] = version or input_version(raw)

    def done(name: str, build: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> None:
        if not settings.overwrite and manifests.complete(name):
            return
        manifests.begin(name)
        # The stage's table is complete when the scope deletes what its operators wrote on the way.
        with scope():
            built = build()
            write(built)
        manifests.finish(name, built.columns)

    def stage(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{folder}/{name}"
        done(name, build, lambda df: files.write_parquet(df, path, True))
        return files.scan_parquet(spark, path)

    processed = stage("processed_dataset", lambda: process(raw, settings))
    embeddings = stage("embeddings", lambda: embed(processed, settings))
    clustered = stage("clustered_dataset", lambda: cluster(processed, embeddings, settings))
    named = stage("cluster_labels", lambda: labels.cluster_labels(clustered, settings.labeler))
    metadata = stage("cluster_metadata", lambda: mapstats.cluster_metadata(clustered))
    edges = stage("constellations", lambda: constellations(clustered))
    numbered = stage("numbered", lambda: outputs.with_ids(clustered))
    records = {
        "packages": outputs.packages_output(numbered),
        "clusters": outputs.clusters_output(named, metadata),
        "constellations": outputs.constellations_output(edges, numbered),
    }
    for name, df in records.items():
        # The links of the map share their name with the stage that finds them.
        own = "links" if name == "constellations" else name
        done(own, lambda df=df: df, lambda df, name=name: files.write_json(df, f"{folder}/{name}.json", True))
    return {
        "processed_dataset": processed,
        "embeddings": embeddings,
        "clustered_dataset": clustered,
        "cluster_labels": named,
        "cluster_metadata": metadata,
        "constellation_edges": edges,
        **records,
    }


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
