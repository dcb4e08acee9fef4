"""Connected components and minimum spanning forests of weighted edge tables.

An edge table has ``src, dst, weight`` with bigint ends. Both work by rounds of joins and grouped minima, each
round written to the shared folder, until no edge joins two components; the number of edges decides nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychart.sources.workspace import Workspace

EDGE_COLUMNS = "src bigint, dst bigint, weight double"


def _roots(parents: DataFrame, space: Workspace) -> DataFrame:
    """Follow parent pointers (node, parent) to their roots by pointer jumping."""
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_up"))
        jumped = parents.join(up, parents["parent"] == up["_n"], "left").select(
            "node",
            F.coalesce("_up", "parent").alias("parent"),
            (F.col("_up") != F.col("parent")).alias("_moved"),
        )
        jumped = space.replace(jumped, "parents")
        parents = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return parents


def _relabel(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """Replace component labels by their roots; labels without a pointer stay."""
    new = roots.select(F.col("node").alias("_node"), F.col("parent").alias("_root"))
    return (
        df.join(new, df[column] == new["_node"], "left")
        .withColumn(column, F.coalesce("_root", column))
        .drop("_node", "_root")
    )


def _both_ways(edges: DataFrame, a: str, b: str, *rest: str) -> DataFrame:
    forward = edges.select(F.col(a).alias("node"), F.col(b).alias("other"), *rest)
    return forward.unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"), *rest))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that has an edge; a component is named by its lowest id.

    Each round hooks every component onto its lowest neighbour and follows the pointers to their
    ends, until no edge joins two components. Grouped minima combine before the shuffle, so a node with very
    many edges is harmless.
    """
    space = Workspace(edges.sparkSession)
    rest = space.write(edges.select("src", "dst").distinct(), "edges")
    labels = None
    while True:
        lowest = (
            _both_ways(rest, "src", "dst")
            .groupBy("node")
            .agg(F.least("node", F.min("other")).alias("parent"))
        )
        roots = _roots(space.replace(lowest, "lowest"), space)
        if labels is None:
            labels = roots.select(F.col("node").alias("id"), F.col("parent").alias("component"))
        else:
            labels = _relabel(labels, "component", roots)
        hooked = _relabel(_relabel(rest, "src", roots), "dst", roots)
        rest = space.replace(hooked.where("src != dst").distinct(), "edges")
        if rest.isEmpty():
            return labels
        labels = space.replace(labels, "labels")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest, unique under the order (weight, lower end, higher end).

    In each round every component picks its least outgoing edge (Borůvka); the components are hooked together
    and contracted, which at least halves those that still have an edge.
    """
    space = Workspace(edges.sparkSession)
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    rest = edges.select(
        low.alias("a"), high.alias("b"), "weight", low.alias("low"), high.alias("high")
    ).where("low != high")
    forest = []
    while True:
        rest = space.replace(rest, "rest")
        if rest.isEmpty():
            break
        choice = space.replace(
            _both_ways(rest, "a", "b", "weight", "low", "high")
            .groupBy("node")
            .agg(F.min(F.struct("weight", "low", "high", "other")).alias("e"))
            .select("node", "e.*"),
            "choice",
        )
        chosen = choice.select(
            F.col("low").alias("src"), F.col("high").alias("dst"), "weight"
        ).distinct()
        forest.append(space.write(chosen, "chosen"))
        # Two components that choose each other: the lower one becomes the root.
        back = choice.select(F.col("node").alias("_n"), F.col("other").alias("_back"))
        root = (F.col("_back") == F.col("node")) & (F.col("node") < F.col("other"))
        parents = choice.join(back, choice["other"] == back["_n"], "left").select(
            "node", F.when(root, F.col("node")).otherwise(F.col("other")).alias("parent")
        )
        roots = _roots(space.replace(parents, "hooks"), space)
        contracted = _relabel(_relabel(rest, "a", roots), "b", roots).where("a != b")
        # Of parallel edges between two components only the least can be chosen later.
        lesser, larger = F.least("a", "b"), F.greatest("a", "b")
        rest = (
            contracted.groupBy(lesser.alias("a"), larger.alias("b"))
            .agg(F.min(F.struct("weight", "low", "high")).alias("e"))
            .select("a", "b", "e.*")
        )
    if not forest:
        return edges.sparkSession.createDataFrame([], EDGE_COLUMNS)
    result = forest[0]
    for part in forest[1:]:
        result = result.unionByName(part)
    return result

