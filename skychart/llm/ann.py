"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.sources.workspace import Workspace

NEIGHBOURS = 20
# Vectors that the tree is fitted on, and queries that the number of visits is calibrated on.
SAMPLE, CALIBRATION = 20_000, 200
BRANCHES, KMEANS_ROUNDS = 8, 12
# Rows wanted in a leaf, fewest sample vectors of a leaf, and rows of a leaf that one task holds.
LEAF_ROWS, LEAF_SAMPLE, PART_ROWS = 512, 16, 8192
# Mean share of the true neighbours that the visits must reach on the calibration queries.
RECALL = 0.97


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


@dataclass
class Tree:
    """Nodes of a hierarchical k-means tree; ``children`` is empty for leaves, which are numbered by ``leaf``."""

    centre: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, leaf_sample: int, seed: int = 5) -> Tree:
        tree = cls()
        tree._grow(sample, leaf_sample, np.random.default_rng(seed))
        return tree

    def _grow(self, points: np.ndarray, leaf_sample: int, random: np.random.Generator) -> int:
        node = len(self.centre)
        self.centre.append(points.mean(axis=0))
        self.children.append([])
        self.leaf.append(-1)
        groups = _kmeans(points, random) if len(points) > leaf_sample else []
        if len(groups) > 1:
            self.children[node] = [self._grow(g, leaf_sample, random) for g in groups]
        else:
            self.leaf[node] = self.leaves
            self.leaves += 1
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf reached by descending to the nearest child centre."""
        out = np.zeros(len(points), np.int64)
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            centres = np.array([self.centre[c] for c in self.children[node]])
            nearest = _nearest(points[rows], centres)
            stack += [(c, rows[nearest == i]) for i, c in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int, rows: np.ndarray, least: int) -> list[int]:
        """The first ``most`` leaves, best bin first, or as many more as hold ``least`` of the ``rows`` per leaf.

        A priority queue holds the nodes that were seen but not opened, by the inner product of query and centre.
        """
        found: list[int] = []
        held = 0
        queue = [(0.0, 0)]
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                products = self._centres(node) @ query
                for p, child in zip(products.tolist(), self.children[node], strict=True):
                    heapq.heappush(queue, (-p, child))
            else:
                found.append(self.leaf[node])
                held += rows[self.leaf[node]]
        return found

    def _centres(self, node: int) -> np.ndarray:
        kept = self.__dict__.setdefault("_kept", {})
        if node not in kept:
            kept[node] = np.array([self.centre[c] for c in self.children[node]])
        return kept[node]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def _kmeans(points: np.ndarray, random: np.random.Generator) -> list[np.ndarray]:
    distinct = np.unique(points, axis=0)
    if len(distinct) < 2:
        return []
    centres = distinct[random.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
    for _ in range(KMEANS_ROUNDS):
        nearest = _nearest(points, centres)
        centres = np.array([points[nearest == i].mean(axis=0) for i in range(len(centres)) if (nearest == i).any()])
    nearest = _nearest(points, centres)
    return [points[nearest == i] for i in range(len(centres)) if (nearest == i).any()]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def exact_scores(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order, so that equal vectors score alike."""
    return (points * query).sum(axis=1)


def _best(points: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids and scores, none below ``floor``, ties to the smaller id."""
    rough = points @ query
    rough[ids == own] = -np.inf
    # The margin covers rounding: the matrix product adds up in another order.
    margin = 1e-9 * (1.0 + abs(floor) if np.isfinite(floor) else 1.0) + 1e-12 * np.abs(rough[np.isfinite(rough)]).max(initial=0.0)
    if len(rough) > k:
        floor = max(floor, np.partition(rough, len(rough) - k)[len(rough) - k])
    near = np.flatnonzero((rough >= floor - margin) & np.isfinite(rough))
    scores = exact_scores(points[near], query)
    order = np.lexsort((ids[near], -scores))[:k]
    return ids[near][order], scores[order]


def _found(queries: DataFrame, targets: DataFrame, by: list[str], k: int, width: int) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` best of each block for each query that visits it.

    Rows of both tables meet in a task, the ``PART_ROWS`` targets of a block at most first, then its queries one after another.
    """
    rows = targets.select(*by, F.lit(0).alias("kind"), "vec_id", "vector", F.lit(None).cast("double").alias("floor")).unionByName(
        queries.select(*by, F.lit(1).alias("kind"), "vec_id", "vector", "floor")
    )
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(c).to_numpy() for c in (*by, "kind")])
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            ids, vectors = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"), width)
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(marks[low, :-1])
                if here != key:
                    key, parts, block = here, [], None
                if marks[low, -1] == 0:
                    parts.append((ids[low:high], vectors[low:high]))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                out = [[], [], []]
                for i in range(low, high):
                    near, scores = _best(block[1], block[0], vectors[i], ids[i], k, floors[i])
                    out[0].append(np.full(len(near), ids[i]))
                    out[1].append(near)
                    out[2].append(scores)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in out], names=["query_id", "vec_id", "score"]
                )

    return dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")


def exact(queries: DataFrame, targets: DataFrame, k: int, width: int) -> DataFrame:
    """The ``k`` best of all targets for a bounded set of queries: each task keeps its own best, then theirs are merged."""
    rows = [(r["vec_id"], r["vector"]) for r in queries.select("vec_id", "vector").collect()]
    asked = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, points = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for own, query in zip(*asked, strict=True):
                near, scores = _best(points, ids, query, own, k, -np.inf)
                if own in kept:
                    near, scores = np.concatenate([kept[own][0], near]), np.concatenate([kept[own][1], scores])
                    order = np.lexsort((near, -scores))[:k]
                    near, scores = near[order], scores[order]
                kept[own] = near, scores
        for own, (near, scores) in kept.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(near), own)), pa.array(near), pa.array(scores)], names=["query_id", "vec_id", "score"]
            )

    return ranked(targets.select("vec_id", "vector").mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _sampled(rows: DataFrame, n: int, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(n)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = NEIGHBOURS,
    recall: float = RECALL,
    sample: int = SAMPLE,
    calibration: int = CALIBRATION,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for the rows of (vec_id, vector) that ``is_query`` selects.

    Nearness is the inner product in double precision; ties go to the smaller id; rows with the query's own
    id are not its candidates, and ids that repeat are asked once. Unusable vectors (see ``usable``), null ids,
    and vectors of another length than the most frequent one take no part. Fewer candidates give fewer rows.

    The tree is fitted on ``sample`` vectors by hash of the id; every row is then indexed in the leaf it descends to. The number of
    leaves that a query visits is widened until the true neighbours of ``calibration`` queries, found by an
    exact pass over all rows, are reached at the rate ``recall``. A query's scores with the sample vectors
    in those leaves give a value that its k-th neighbour there cannot be below, so few rows leave a leaf. Leaves of many rows are cut into parts, so the copies
    of one vector do not meet in one task.
    """
    space = Workspace(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("vector").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "width").first()
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, n = most["width"], most["n"]
    rows = rows.where(F.size("vector") == width)
    chosen = _sampled(rows, sample, 1).toArrow()
    points, point_ids = _matrix(chosen.column("vector").combine_chunks(), width), chosen.column("vec_id").to_numpy()
    tree = Tree.fit(points, max(LEAF_SAMPLE, -(-len(points) * LEAF_ROWS // n)))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((tree, points, point_ids))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value[0]
        for batch in batches:
            leaves = tree.leaf_of(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], names=["vec_id", "vector", "leaf"])

    indexed = space.write(rows.mapInArrow(index, "vec_id bigint, vector array<double>, leaf bigint"), "indexed")
    # One row per leaf, of which there are at most as many as sample vectors.
    per_leaf = indexed.groupBy("leaf").agg(F.count("*").alias("n"))
    parts = F.broadcast(per_leaf.select("leaf", F.ceil(F.col("n") / PART_ROWS).cast("bigint").alias("parts")))
    held = np.zeros(tree.leaves, np.int64)
    for r in per_leaf.collect():
        held[r["leaf"]] = r["n"]
    sample_leaf = tree.leaf_of(points)
    queries = indexed.where(is_query).dropDuplicates(["vec_id"])

    asked = _sampled(queries, calibration, 2)
    visits = _calibrated(exact(asked, indexed, k, width), asked, indexed, tree, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, points, ids = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                query, own = _matrix(one.column("vector"), width)[0], one.column("vec_id")[0].as_py()
                leaves = tree.visits(query, visits, held, k + 1)
                # The sample vectors in these leaves are among the candidates: the k-th best of all is no worse than theirs.
                inside = np.isin(sample_leaf, leaves)
                _, known = _best(points[inside], ids[inside], query, own, k, -np.inf)
                floor = float(known[-1]) if len(known) == k else -np.inf
                take = pa.array(np.zeros(len(leaves), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [one.column("vec_id").take(take), one.column("vector").take(take), pa.array(leaves), pa.array(np.full(len(leaves), floor))],
                    names=["vec_id", "vector", "leaf", "floor"],
                )

    visiting = queries.select("vec_id", "vector").mapInArrow(ask, "vec_id bigint, vector array<double>, leaf bigint, floor double")
    everywhere = visiting.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    dealt = indexed.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return ranked(_found(everywhere, dealt, ["leaf", "part"], k, width).distinct(), k)


def _calibrated(truth: DataFrame, asked: DataFrame, indexed: DataFrame, tree: Tree, recall: float) -> int:
    """The fewest leaves that reach the wanted mean recall on the calibration queries."""
    rows = truth.join(indexed.select("vec_id", "leaf").distinct(), "vec_id").select("query_id", "leaf").collect()
    orders = {
        r["vec_id"]: {leaf: i for i, leaf in enumerate(tree.visits(np.array(r["vector"]), tree.leaves, np.zeros(tree.leaves), 0))}
        for r in asked.collect()
    }
    if not rows:
        return tree.leaves
    ranks = np.sort([orders[r["query_id"]][r["leaf"]] for r in rows])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1
