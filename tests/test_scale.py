"""What travels and who works when tables grow; results are compared with plain versions."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skychart.llm import hmm
from skychart.operators import descent, knn, pointforest, spatial
from skychart.operators.spread import spread

VEC = "id bigint, vec array<double>"


def frame(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], VEC)


def test_exact_neighbours_send_a_vector_to_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(knn, "POINTS_PER_PIVOT", 20)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "CANDIDATE_BLOCK", 30)
    sent, made = [], SparkSession.createDataFrame

    def spy(self, data, *rest, **more):
        if "least_gap" in getattr(data, "columns", []):
            sent.append(data)
        return made(self, data, *rest, **more)

    data = np.random.default_rng(3).standard_normal((800, 24))
    monkeypatch.setattr(SparkSession, "createDataFrame", spy)
    found = knn.knn_exact(frame(spark, data), 3).collect()
    monkeypatch.undo()
    # Nothing can be ruled out here: every vector goes to every group of queries.
    assert sent[0].groupby("other")["query_blocks"].sum().max() <= 24
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    assert {(r["id"], r["rank"]): r["neighbor"] for r in found} == {
        (i, k): int(j) for i in range(800) for k, j in enumerate(np.argsort(gaps[i])[:3])
    }


def test_pairs_of_one_crowded_cell_are_dealt_over_tasks(spark):
    points = spark.range(3000).select("id", (F.col("id") % 7 / 1000.0).alias("x"), F.lit(0.5).alias("y"))
    boxes = spark.range(40).select(F.col("id").alias("box"), *[F.lit(v).alias(c) for c, v in zip("abcd", (-0.5, 0.5, 0.0, 0.9), strict=True)])
    found = spatial.overlap_join(points, boxes, ["x", "x", "y", "y"], ["a", "b", "c", "d"])
    counted = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("id", "box").alias("m")).collect()
    assert sum(r["n"] for r in counted) == sum(r["m"] for r in counted) == 120_000
    assert max(r["n"] for r in counted) < 70_000


def test_every_round_of_the_markov_model_learns_from_all_texts(spark, monkeypatch):
    seen, counted = [], hmm.expected_counts

    def spy(docs, model):
        seen.append(docs.count())
        return counted(docs, model)

    monkeypatch.setattr(hmm, "expected_counts", spy)
    hmm.train(spark.range(4300).select(F.col("id").alias("doc_id"), F.lit("so it goes").alias("text")))
    assert seen and set(seen) == {4300}


def test_forest_in_a_block_measures_few_pairs(monkeypatch):
    measured = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def sqrt(self, x, *rest, **more):
            measured.append(x.size if x.ndim == 1 else 0)
            return np.sqrt(x, *rest, **more)

    rng = np.random.default_rng(4)
    data = np.concatenate([rng.standard_normal((300, 40)), np.repeat(rng.standard_normal((1, 40)), 30, axis=0)])
    points = pd.DataFrame({"id": rng.permutation(330), "vec": list(data), "core": np.zeros(330)})
    monkeypatch.setattr(pointforest, "np", Counting())
    found = pointforest._prim(points, False, None)
    assert sum(measured) < 330 * 330 / 4
    by_id = {i: v for i, v in zip(points["id"], data, strict=True)}
    pairs = [(np.sqrt((((by_id[a] - by_id[b]) ** 2).cumsum())[-1]), a, b) for a in range(330) for b in range(a + 1, 330)]
    root, kept = list(range(330)), set()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b in sorted(pairs):
        if top(a) != top(b):
            root[top(a)] = top(b)
            kept.add((a, b))
    assert set(zip(found["src"], found["dst"], strict=True)) == kept


def test_a_large_table_is_dealt_over_all_cores(spark):
    large = spark.range(100_000_000).coalesce(1)
    assert spread(large).rdd.getNumPartitions() >= 8


def test_gatherings_without_fresh_members_send_nothing(spark):
    met = "array<struct<distance: double, neighbor: bigint, fresh: boolean>>"
    rows = [(0, [0.0], 9.0, [(1.0, 1, False)]), (1, [1.0], 9.0, [(1.0, 0, False), (4.0, 2, True)]), (2, [5.0], 9.0, [(4.0, 1, False)])]
    lists = spark.createDataFrame(rows, f"rep bigint, vec array<double>, bound double, met {met}")
    found = {r["at"]: sorted((m["member"], m["fresh"]) for m in r["members"]) for r in descent._gatherings(lists, 5, 0).collect()}
    # Vector 1 has the fresh member 2, and 2 is listed afresh by 1; at 0 there is nothing fresh.
    assert found == {1: [(0, False), (2, True)], 2: [(1, True)]}
