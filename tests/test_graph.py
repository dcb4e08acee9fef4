"""Forests, components and constellations against direct versions."""

import itertools
import math
import os
import random

import pytest

import registered
from skychart.operators import constellations, graph
from skychart.operators.mapstats import exclude_noise

EDGE = "src bigint, dst bigint, weight double"


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    kept = set()
    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            kept.add((a, b, w))
    return kept, find


def random_edges(seed, nodes, count):
    random.seed(seed)
    edges = {}
    while len(edges) < count:
        a, b = random.sample(range(nodes), 2)
        edges.setdefault((a, b), float(random.randrange(12)))
    return [(a, b, w) for (a, b), w in edges.items()]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_and_components(spark, seed):
    edges = random_edges(seed, 60, 70)
    df = spark.createDataFrame(edges, EDGE)
    want, find = kruskal(edges)
    got = {tuple(r) for r in graph.minimum_spanning_forest(df).collect()}
    assert got == want
    components = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    nodes = {n for e in edges for n in e[:2]}
    lowest = {}
    for n in sorted(nodes):
        lowest.setdefault(find(n), n)
    assert components == {n: lowest[find(n)] for n in nodes}


def test_long_path_and_star(spark):
    path = [(i, i + 1, float(i % 7)) for i in range(60)]
    star = [(1000, 1001 + i, 1.0) for i in range(60)]
    df = spark.createDataFrame(path + star, EDGE)
    got = {r["id"]: r["component"] for r in graph.connected_components(df).collect()}
    assert set(got.values()) == {0, 1000}
    assert graph.minimum_spanning_forest(df).count() == 120


POINT = "name string, x double, y double, cluster_id int, weekly_downloads bigint"
# Two right triangles with sides 3, 4, 5 and 6, 8, 10: the tree of each are its two short sides.
TRIANGLES = [
    ("north", 10.0, 14.0, 4, 31), ("corner", 10.0, 10.0, 4, 12), ("east", 13.0, 10.0, 4, 57),
    ("up", -20.0, 8.0, 7, 44), ("origin", -20.0, 0.0, 7, 90), ("right", -14.0, 0.0, 7, 23),
]


def test_two_clusters(spark):
    df = spark.createDataFrame(TRIANGLES, POINT)
    got = constellations.constellations(df, fraction=0.5, min_points=3, cutoff=10.0)
    assert got.columns == ["cluster_id", "from_package", "to_package", "from_x", "from_y", "to_x", "to_y"]
    edges = {(r[0], *sorted(r[1:3])) for r in got.collect()}
    assert edges == {(4, "corner", "north"), (4, "corner", "east"), (7, "origin", "up"), (7, "origin", "right")}


def test_noise_has_no_edges(spark):
    rows = [(n, x, y, -1 if c == 4 else 1, w) for n, x, y, c, w in TRIANGLES]
    got = constellations.constellations(spark.createDataFrame(rows, POINT), 0.5, 3, 10.0).collect()
    assert {r["cluster_id"] for r in got} == {1}
    assert len(got) == 2
    assert exclude_noise(spark.createDataFrame(rows, POINT)).count() == 3


def test_too_few_points_keep_the_columns(spark):
    got = constellations.constellations(spark.createDataFrame(TRIANGLES[:2], POINT))
    assert (got.count(), len(got.columns)) == (0, 7)


def test_coincident_points(spark):
    rows = [("a", 0.0, 0.0, 1, 9), ("b", 0.0, 0.0, 1, 8), ("c", 1.0, 0.0, 1, 7), ("d", 1.0, 0.0, 1, 6)]
    got = constellations.spanning_edges(spark.createDataFrame(rows, POINT), 1.0)
    assert {(r[1], r[2]) for r in got.collect()} == {("a", "c"), ("a", "d"), ("b", "c")}
    same = [(n, 0.0, 0.0, 1, 1) for n in "abc"]
    assert constellations.constellations(spark.createDataFrame(same, POINT), 1.0).count() == 0


def test_zero_range_axis(spark):
    rows = [(n, 3.0, float(y), 1, 1) for n, y in zip("abcd", [0, 1, 2, 100], strict=True)]
    got = constellations.constellations(spark.createDataFrame(rows, POINT), 1.0)
    assert {(r[1], r[2]) for r in got.collect()} == {("a", "b"), ("b", "c")}


@pytest.mark.parametrize("block", [1024, 8])
def test_blocks_and_cutoff_equal_the_direct_tree(spark, block):
    random.seed(4)
    rows = []
    for c, n in ((0, 50), (1, 5), (2, 2)):
        rows += [(f"p{c}-{i}", random.randrange(40) / 40, random.randrange(40) / 20, c, random.randrange(30)) for i in range(n)]
    df = spark.createDataFrame(rows, POINT)
    got = {tuple(r)[:3] for r in constellations.constellations(df, 0.8, 3, 0.1, block).collect()}
    width, height = (max(r[i] for r in rows) - min(r[i] for r in rows) for i in (1, 2))
    want = set()
    for c in range(3):
        mine = sorted((r for r in rows if r[3] == c), key=lambda r: (-r[4], r[0]))
        top = mine[: max(3, int(len(mine) * 0.8))] if len(mine) >= 3 else []
        edges = [
            (i, j, math.dist(top[i][1:3], top[j][1:3]))
            for i, j in itertools.combinations(range(len(top)), 2)
            if top[i][1:3] != top[j][1:3]
        ]
        for i, j, _ in kruskal(edges)[0]:
            if math.hypot((top[i][1] - top[j][1]) / width, (top[i][2] - top[j][2]) / height) <= 0.1:
                want.add((c, top[i][0], top[j][0]))
    assert got == want


def test_forest_of_parts_equals_a_plain_one(spark):
    """The registered query against one edge at a time in ascending order, on the smallest tables."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("tables not present")
    least = {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_extendedprice").collect():
        ends = tuple(sorted((-1 - r[0], r[1])))
        least[ends] = min(r[2], least.get(ends, r[2]))
    want, _ = kruskal([(a, b, w) for (a, b), w in least.items()])
    got = {tuple(r) for r in registered.spanning_forest_parts(spark, folder).collect()}
    assert len(want) > 100 and got == want
