"""Manifold reduction: fuzzy neighbour graph, supervision by labels, force layout."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychart.functions.vectors import l2_normalize
from skychart.operators.descent import knn_descent
from skychart.operators.knn import knn_approximate, knn_exact
from skychart.operators.ranking import global_dense_id
from skychart.operators.spectral import spectral_start
from skychart.sources.workspace import Workspace

# Fixed values of the method: bisection steps and tolerance, least bandwidth as a share of the mean
# distance, and the distances that stand for different and for unknown labels.
BISECTIONS = 64
TOLERANCE = 1e-5
MIN_SCALE = 1e-3
FAR = 2.5
UNKNOWN = 1.0

NEGATIVES = 5
EPOCHS = 100
# Positions handed to every task take at most this much; points of a block of edges.
SHARED_BYTES, POINTS_PER_BLOCK = 1 << 26, 2048


def neighbors(vectors: DataFrame, k: int, method: str) -> DataFrame:
    """k nearest neighbours: ``exact`` (quadratic where nothing can be ruled out), or near-linear by ``descent`` from list to
    list, or in one pass over the leaves of random trees (``approximate``)."""
    methods = {"exact": knn_exact, "descent": knn_descent, "approximate": knn_approximate}
    if method not in methods:
        raise ValueError(f"no such method: {method}")
    return methods[method](vectors, k)


def _bandwidth(distances: Column, rho: Column, target: float) -> Column:
    """The scale at which the memberships of the neighbours sum to ``target``, by bisection."""

    def total(scale: Column) -> Column:
        return F.aggregate(
            distances,
            F.lit(0.0),
            lambda s, d: s + F.when(d - rho > 0, F.exp(-(d - rho) / scale)).otherwise(F.lit(1.0)),
        )

    inf = F.lit(float("inf"))

    def step(state: Column, _: Column) -> Column:
        low, high, mid = state["low"], state["high"], state["mid"]

        def moved(excess: Column) -> Column:
            above = excess > 0
            new_low = F.when(above, low).otherwise(mid)
            new_high = F.when(above, mid).otherwise(high)
            new_mid = F.when(above, (low + mid) / 2).otherwise(
                F.when(high == inf, mid * 2).otherwise((mid + high) / 2)
            )
            fresh = F.struct(new_low.alias("low"), new_high.alias("high"), new_mid.alias("mid"))
            return F.when(F.abs(excess) < TOLERANCE, state).otherwise(fresh)

        return F.transform(F.array(total(mid) - target), moved)[0]

    start = F.struct(F.lit(0.0).alias("low"), inf.alias("high"), F.lit(1.0).alias("mid"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), start, step, lambda s: s["mid"])


def membership(knn: DataFrame, n_neighbors: int) -> DataFrame:
    """Directed memberships (id, neighbor, weight) from (id, neighbor, distance).

    ``n_neighbors`` counts the point itself, so a full list has one entry less.
    """
    lists = knn.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("list"),
        F.array_sort(F.collect_list("distance")).alias("distances"),
    )
    overall = knn.agg(F.sum("distance") / (F.countDistinct("id") * n_neighbors)).scalar()
    rho = F.coalesce(F.get(F.filter("distances", lambda d: d > 0), F.lit(0)), F.lit(0.0))
    own_mean = F.aggregate("distances", F.lit(0.0), lambda s, d: s + d) / n_neighbors
    least = F.when(F.col("rho") > 0, own_mean).otherwise(overall) * MIN_SCALE
    scaled = (
        lists.withColumn("rho", rho)
        .withColumn("sigma", _bandwidth(F.col("distances"), F.col("rho"), math.log2(n_neighbors)))
        .withColumn("sigma", F.greatest("sigma", least))
    )
    excess = F.col("_e.distance") - F.col("rho")
    weight = F.when((excess <= 0) | (F.col("sigma") == 0), F.lit(1.0)).otherwise(
        F.exp(-excess / F.col("sigma"))
    )
    return scaled.select("id", "rho", "sigma", F.explode("list").alias("_e")).select(
        "id", F.col("_e.neighbor").alias("neighbor"), weight.alias("weight")
    )


def _symmetric(directed: DataFrame) -> DataFrame:
    """Undirected edges src < dst with weight a + b - ab of both directions."""
    forward = F.col("id") < F.col("neighbor")
    a = F.coalesce(F.max(F.when(forward, F.col("weight"))), F.lit(0.0))
    b = F.coalesce(F.max(F.when(~forward, F.col("weight"))), F.lit(0.0))
    return directed.groupBy(
        F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst")
    ).agg((a + b - a * b).alias("weight"))


def fuzzy_graph(knn: DataFrame, n_neighbors: int) -> DataFrame:
    """Undirected membership graph (src, dst, weight) of a neighbour table."""
    return _symmetric(membership(knn, n_neighbors))


def supervise_graph(graph: DataFrame, labels: DataFrame, target_weight: float = 0.5) -> DataFrame:
    """Weaken edges between different labels (id, label), then make each point's best edge 1 again.

    Label -1 is unknown.
    """
    far = FAR / (1 - target_weight) if target_weight < 1 else 1e12
    a, b = F.col("label_a"), F.col("label_b")
    factor = (
        F.when((a == -1) | (b == -1), math.exp(-UNKNOWN)).when(a != b, math.exp(-far)).otherwise(1.0)
    )
    weakened = (
        graph.join(labels.select(F.col("id").alias("src"), F.col("label").alias("label_a")), "src")
        .join(labels.select(F.col("id").alias("dst"), F.col("label").alias("label_b")), "dst")
        .select("src", "dst", (F.col("weight") * factor).alias("weight"))
    )
    directed = both_directions(weakened)
    best = directed.groupBy("id").agg(F.max("weight").alias("best"))
    return _symmetric(
        directed.join(best, "id").select("id", "neighbor", (F.col("weight") / F.col("best")).alias("weight"))
    )


def both_directions(graph: DataFrame) -> DataFrame:
    there = graph.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"), "weight")
    return there.unionByName(
        graph.select(F.col("dst").alias("id"), F.col("src").alias("neighbor"), "weight")
    )


def curve_parameters(min_dist: float, spread: float) -> tuple[float, float]:
    """a, b for which ``1 / (1 + a x^2b)`` is closest to 1 up to min_dist and then exp decay."""
    x = np.linspace(0, spread * 3, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b, damping = 1.0, 1.0, 1e-3

    def curve(a: float, b: float) -> np.ndarray:
        return 1.0 / (1.0 + a * x ** (2 * b))

    error = ((curve(a, b) - y) ** 2).sum()
    for _ in range(500):
        f = curve(a, b)
        slope = np.stack([-(x ** (2 * b)) * f * f, -2 * a * np.log(x) * x ** (2 * b) * f * f], axis=1)
        square = slope.T @ slope
        move = np.linalg.solve(square + damping * np.diag(np.diag(square)), slope.T @ (y - f))
        new_error = ((curve(a + move[0], b + move[1]) - y) ** 2).sum() if a + move[0] > 0 else np.inf
        if new_error < error:
            a, b, error, damping = a + move[0], b + move[1], new_error, damping / 3
        else:
            damping *= 3
    return float(a), float(b)


def pca(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(id, vec) projected on the first principal components."""
    featured = vectors.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    model = PCA(k=dimensions, inputCol="v", outputCol="p").fit(featured)
    return model.transform(featured).select("id", vector_to_array("p").alias("vec"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Schedule:
    """What every epoch needs to know: the force curve and which edges act when."""

    a: float
    b: float
    repulsion: float
    epochs: int
    seed: int
    points: int

    def acting(self, weights: np.ndarray, epoch: int) -> np.ndarray:
        """An edge of weight w (the strongest has 1) acts in the epochs in which w times the epochs so far gains a whole."""
        return np.floor(weights * (epoch + 1) + 1e-9) > np.floor(weights * epoch + 1e-9)

    def partners(self, rows: np.ndarray, others: np.ndarray, epoch: int) -> np.ndarray:
        """The points that an edge pushes its own away from: a hash of the edge, the epoch and the seed."""
        key = _mixed(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + others.astype(np.uint64))
        key = _mixed(key + np.uint64(epoch * 1_000_003 + self.seed))
        drawn = [_mixed(key + np.uint64(s)) % np.uint64(self.points) for s in range(NEGATIVES)]
        return np.stack(drawn, axis=1).astype(np.int64)

    def moved(self, own: np.ndarray, counts: np.ndarray, others: np.ndarray, pushed: np.ndarray, epoch: int) -> np.ndarray:
        """New positions of points with ``counts`` acting edges each, one edge after another, all points at once.

        ``others`` are the far ends of the edges, ``pushed`` their partners, both as they stood when the epoch began.
        """
        own, rate = own.copy(), 1.0 - epoch / self.epochs
        first = np.cumsum(counts) - counts
        for turn in range(int(counts.max(initial=0))):
            at = np.flatnonzero(counts > turn)
            edge = first[at] + turn
            gap = own[at] - others[edge]
            square = (gap * gap).sum(axis=1, keepdims=True)
            near = np.maximum(square, 1e-300)
            pull = np.where(square > 0, -2.0 * self.a * self.b * near ** (self.b - 1.0) / (1.0 + self.a * near**self.b), 0.0)
            place = own[at] + rate * np.clip(pull * gap, -4.0, 4.0)
            for s in range(NEGATIVES):
                gap = place - pushed[edge, s]
                square = (gap * gap).sum(axis=1, keepdims=True)
                push = np.where(square > 0, 2.0 * self.repulsion * self.b / ((0.001 + square) * (1.0 + self.a * square**self.b)), 0.0)
                place += rate * np.clip(push * gap, -4.0, 4.0)
            own[at] = place
        # Rounding hides differences in the last digit between platforms.
        return np.round(own, 6)


_LINKS = "row bigint, others array<bigint>, weights array<double>"


def _dealt(batch: pa.RecordBatch, plan: Schedule, epoch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, acting edges per point, the point of each of these edges, its far end) of (row, others, weights) rows."""
    rows = batch.column(0).to_numpy()
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    owner = np.repeat(np.arange(len(rows)), sizes)
    acts = plan.acting(batch.column(2).flatten().to_numpy(), epoch)
    counts = np.bincount(owner[acts], minlength=len(rows))
    return rows, counts, rows[owner[acts]], batch.column(1).flatten().to_numpy()[acts]


def _epochs_by_broadcast(links: DataFrame, positions: np.ndarray, plan: Schedule) -> np.ndarray:
    """All epochs where the positions of all points fit into every task: the only thing exchanged."""
    context = links.sparkSession.sparkContext
    for epoch in range(plan.epochs):
        shared = context.broadcast(positions)

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = shared.value
            for batch in batches:
                rows, counts, owner, others = _dealt(batch, plan, epoch)
                new = plan.moved(known[rows], counts, known[others], known[plan.partners(owner, others, epoch)], epoch)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * new.shape[1]), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(rows), vec], names=["row", "vec"])

        found = links.mapInArrow(run, "row bigint, vec array<double>").toArrow()
        fresh = np.empty_like(positions)
        fresh[found.column("row").to_numpy()] = found.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, positions.shape[1])
        positions = fresh
        shared.destroy()
    return positions


def _epochs_by_join(links: DataFrame, placed: DataFrame, plan: Schedule, space: Workspace) -> DataFrame:
    """All epochs for any number of points: the positions that an epoch looks at are joined to its acting edges."""
    for epoch in range(plan.epochs):

        def deal(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, counts, owner, others = _dealt(batch, plan, epoch)
                turn = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                seen = np.concatenate([others[:, None], plan.partners(owner, others, epoch)], axis=1)
                width = seen.shape[1]
                slot = np.repeat(turn * width, width) + np.tile(np.arange(width), len(turn))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(owner, width)), pa.array(slot), pa.array(seen.ravel())], names=["row", "slot", "seen"]
                )

        def move(batches: Iterator[pa.RecordBatch], epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(0)
                own = batch.column(1).flatten().to_numpy().reshape(len(rows), -1)
                sizes = np.diff(batch.column(2).offsets.to_numpy())
                slot, vec = batch.column(2).flatten().flatten()
                order = np.lexsort((slot.to_numpy(), np.repeat(np.arange(len(rows)), sizes)))
                seen = vec.flatten().to_numpy().reshape(len(slot), -1)[order].reshape(-1, NEGATIVES + 1, own.shape[1])
                new = plan.moved(own, sizes // (NEGATIVES + 1), seen[:, 0], seen[:, 1:], epoch)
                out = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * new.shape[1]), pa.array(new.ravel()))
                yield pa.RecordBatch.from_arrays([rows, out], names=["row", "vec"])

        looked_at = (
            links.mapInArrow(deal, "row bigint, slot bigint, seen bigint")
            .join(placed.select(F.col("row").alias("seen"), "vec"), "seen")
            .groupBy("row")
            .agg(F.collect_list(F.struct("slot", "vec")).alias("seen"))
        )
        nothing = F.array().cast("array<struct<slot: bigint, vec: array<double>>>")
        ready = placed.join(looked_at, "row", "left").select("row", "vec", F.coalesce("seen", nothing).alias("seen"))
        placed = space.replace(ready.mapInArrow(move, "row bigint, vec array<double>"), "placed")
    return placed


def layout(
    graph: DataFrame,
    start: DataFrame,
    min_dist: float,
    spread: float = 1.0,
    repulsion: float = 1.0,
    epochs: int = EPOCHS,
    seed: int = 0,
    shared_bytes: int = SHARED_BYTES,
) -> DataFrame:
    """Positions (id, vec) that pull graph neighbours together and push random others apart.

    Over the epochs an edge acts in proportion to its weight. When it acts, it pulls its point towards the far end and pushes it
    from a few random others; the edges of a point act one after another and see where all others stood
    when the epoch began, so a run repeats under any partitioning. The edges are dealt once, by blocks of points, and never
    move again. While all positions take at most ``shared_bytes`` (they are counted), an epoch hands
    them to every task and needs no shuffle; beyond that they are joined to the acting edges and written once per epoch.
    Both ways give the same positions.
    """
    spark = graph.sparkSession
    space = Workspace(spark)
    first = start.first()
    if first is None:
        return start.select("id", F.col("vec").cast("array<double>").alias("vec"))
    dims = len(first["vec"])
    largest = start.agg(
        F.greatest(*[F.max(F.abs(F.col("vec")[d])) for d in range(dims)], F.lit(1e-12))
    ).scalar()

    def jitter(d: int) -> Column:
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(d)), F.lit(1_000_003)) / 1_000_003 - 0.5) * 1e-3

    scaled = start.select(
        "id", F.array(*[F.round(F.col("vec")[d] / largest * 10 + jitter(d), 6) for d in range(dims)]).alias("vec")
    )
    numbered = space.write(global_dense_id(scaled, [F.col("id").asc()], out="row"), "numbered")
    n = numbered.count()
    strongest = graph.agg(F.max("weight")).scalar()
    # What would not act once in all epochs is left out.
    kept = both_directions(graph).select("id", "neighbor", (F.col("weight") / strongest).alias("weight"))
    kept = kept.where(F.col("weight") * epochs >= 1)
    rows = numbered.select("id", "row")
    edges = kept.join(rows, "id").join(rows.select(F.col("id").alias("neighbor"), F.col("row").alias("other")), "neighbor")
    gathered = edges.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("other", "weight"))).alias("e"))
    links = rows.join(gathered, "row", "left").select(
        "row",
        F.coalesce(F.transform("e", lambda e: e["other"]), F.array().cast("array<bigint>")).alias("others"),
        F.coalesce(F.transform("e", lambda e: e["weight"]), F.array().cast("array<double>")).alias("weights"),
    )
    links = space.write(links.repartition(max(1, -(-n // POINTS_PER_BLOCK)), "row"), "links")
    a, b = curve_parameters(min_dist, spread)
    plan = Schedule(a, b, repulsion, epochs, seed, n)
    if n * dims * 8 <= shared_bytes:
        table = numbered.select("row", "vec").toArrow()
        positions = np.empty((n, dims))
        positions[table.column("row").to_numpy()] = table.column("vec").combine_chunks().flatten().to_numpy().reshape(n, dims)
        positions = _epochs_by_broadcast(links, positions, plan)
        placed = spark.createDataFrame(
            pa.table(
                {
                    "row": pa.array(np.arange(n)),
                    "vec": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(positions.ravel())),
                }
            )
        )
    else:
        placed = _epochs_by_join(links, numbered.select("row", "vec"), plan, space)
    return space.write(placed.join(rows, "row").select("id", "vec"), "laid")


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", l2_normalize(F.col("vec")).alias("vec"))


def _graph(unit: DataFrame, knn: DataFrame | None, n_neighbors: int) -> DataFrame:
    if knn is None:
        knn = Workspace(unit.sparkSession).write(neighbors(unit, n_neighbors - 1, "descent"), "knn")
    return fuzzy_graph(knn.where(F.col("rank") < n_neighbors - 1), n_neighbors)


def reduce_dims(
    vectors: DataFrame,
    dimensions: int = 16,
    n_neighbors: int = 10,
    min_dist: float = 0.03,
    epochs: int = EPOCHS,
    method: str = "graph",
    knn: DataFrame | None = None,
) -> DataFrame:
    """(id, vec) in fewer dimensions and of unit length, ready for density clustering.

    ``knn`` may hand in a neighbour table of the unit vectors that is at least long enough.
    """
    unit = unit_vectors(vectors)
    if method == "pca":
        reduced = pca(unit, dimensions)
    else:
        graph = Workspace(unit.sparkSession).write(_graph(unit, knn, n_neighbors), "graph")
        reduced = layout(graph, spectral_start(graph, pca(unit, dimensions)), min_dist, epochs=epochs)
    return unit_vectors(reduced)


def map_coordinates(
    vectors: DataFrame,
    labels: DataFrame,
    n_neighbors: int = 12,
    min_dist: float = 0.6,
    spread: float = 0.7,
    repulsion: float = 0.3,
    target_weight: float = 0.5,
    epochs: int = EPOCHS,
    knn: DataFrame | None = None,
) -> DataFrame:
    """(id, x, y): a two-dimensional layout in which points of one cluster attract each other more."""
    unit = unit_vectors(vectors)
    graph = supervise_graph(_graph(unit, knn, n_neighbors), labels, target_weight)
    graph = Workspace(unit.sparkSession).write(graph, "graph")
    placed = layout(graph, spectral_start(graph, pca(unit, 2)), min_dist, spread, repulsion, epochs)
    return placed.select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def kept_neighbors(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, kept): the share of a point's neighbours in ``before`` that are still neighbours in ``after``."""
    same = after.select("id", "neighbor", F.lit(1).alias("_same"))
    return before.join(same, ["id", "neighbor"], "left").groupBy("id").agg(
        (F.count("_same") / F.count("*")).alias("kept")
    )
