"""Viewports, boxes, nearest points and label ranks against brute force and edge cases."""

import random

from pyspark.sql import functions as F

from skychart.operators import spatial

POINT = "id bigint, x double, y double, cluster_id int, weekly_downloads bigint"
VIEW = "view_id int, min_x double, max_x double, min_y double, max_y double, zoom double, mobile boolean"


def pairs(df, a, b):
    return sorted((r[a], r[b]) for r in df.collect())


def test_overlap_join_equals_brute_force(spark):
    random.seed(5)

    def box(i):
        x, y, size = random.uniform(-9, 9), random.uniform(-9, 9), random.choice([0, 0.01, 0.5, 3, 20])
        return (i, x, x + size * random.random(), y, y + size)

    left, right = [box(i) for i in range(80)], [box(i) for i in range(80)]
    a = spark.createDataFrame(left, "i int, ax double, bx double, ay double, by double")
    b = spark.createDataFrame(right, "j int, cx double, dx double, cy double, dy double")
    got = pairs(spatial.overlap_join(a, b, ["ax", "bx", "ay", "by"], ["cx", "dx", "cy", "dy"]), "i", "j")
    want = sorted(
        (p[0], q[0]) for p in left for q in right if p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]
    )
    assert got == want


def test_viewport_edges(spark):
    points = spark.createDataFrame([(0, 1.2, 1.0, 0, 5), (1, 1.21, 1.0, 0, 5), (2, 1.0, 1.0, 1, 5)], POINT)
    views = spark.createDataFrame([(7, -1.0, 1.0, -1.0, 1.0, 5.0, False)], VIEW)
    assert pairs(spatial.viewport_points(points, views), "view_id", "id") == [(7, 0), (7, 2)]
    chosen = spark.createDataFrame([(0,), (0,)], "cluster_id int")
    assert pairs(spatial.viewport_points(points, views, chosen), "view_id", "id") == [(7, 0)]
    assert [r["id"] for r in spatial.viewport_filter(points, -1.0, 1.0, -1.0, 1.0, [0]).collect()] == [0]


def test_touching_boxes_and_cluster_padding(spark):
    clusters = spark.createDataFrame(
        [(0, 1.1, 2.0, 0.0, 1.0), (1, 1.2, 2.0, 0.0, 1.0), (2, -5.0, 5.0, -5.0, 5.0)],
        "cluster_id int, min_x double, max_x double, min_y double, max_y double",
    )
    views = spark.createDataFrame([(1, 0.5, 1.0, 0.0, 0.5, 1.0, False)], VIEW)
    assert pairs(spatial.viewport_clusters(clusters, views), "view_id", "cluster_id") == [(1, 0), (1, 2)]


def test_nearest(spark):
    points = spark.createDataFrame(
        [(0, 1.0, 0.0, 0, 1), (1, -1.0, 0.0, 0, 1), (2, -3.3, -3.3, 0, 1), (3, -3.4, -3.3, 1, 1)], POINT
    )
    queries = spark.createDataFrame(
        [(0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.5), (2, -3.45, -3.3, 0.5), (3, 50.0, 50.0, 3.0)],
        "query_id int, x double, y double, radius double",
    )
    got = {r["query_id"]: r["nearest_id"] for r in spatial.nearest_within(points, queries).collect()}
    assert got == {0: None, 1: 0, 2: 3, 3: None}
    shown = spark.createDataFrame([(0,)], "cluster_id int")
    got = {r["query_id"]: r["nearest_id"] for r in spatial.nearest_within(points, queries, shown).collect()}
    assert got[2] == 2


def test_nearest_equals_brute_force(spark):
    random.seed(2)
    points = [(i, random.uniform(-2, 2), random.uniform(-2, 2), 0, 1) for i in range(300)]
    queries = [(i, random.uniform(-3, 3), random.uniform(-3, 3), random.choice([0.01, 0.2, 4.0])) for i in range(60)]
    df = spatial.nearest_within(
        spark.createDataFrame(points, POINT),
        spark.createDataFrame(queries, "query_id int, x double, y double, radius double"),
    )
    got = {r["query_id"]: r["nearest_id"] for r in df.collect()}
    for q, x, y, radius in queries:
        near = [((px - x) ** 2 + (py - y) ** 2, i) for i, px, py, *_ in points if (px - x) ** 2 + (py - y) ** 2 < radius**2]
        assert got[q] == (min(near)[1] if near else None)


def test_grid_cells(spark):
    points = spark.createDataFrame([(0, -0.1, 0.1, 0, 1), (1, -1.1, 0.1, 0, 1), (2, 2.1, 0.9, 0, 1)], POINT)
    queries = spark.createDataFrame([(0, 0.5, 0.5, 0.3)], "query_id int, x double, y double, radius double")
    assert pairs(spatial.grid_range_join(points, queries, 1.0), "query_id", "id") == [(0, 0)]


def test_label_limits(spark):
    rows = [(z, m) for z in (3.9, 4.0, 6.9, 7.0, 19.9, 20.0) for m in (False, True)]
    df = spark.createDataFrame(rows, "zoom double, mobile boolean")
    got = [r[0] for r in df.select(spatial.label_limit(F.col("zoom"), F.col("mobile"))).collect()]
    assert got == [0, 0, 20, 25, 20, 25, 30, 25, 30, 25, 50, 25]


def test_labels_of_views(spark):
    points = spark.createDataFrame([(i, 0.0, 0.0, 0, i % 30) for i in range(60)], POINT)
    views = spark.createDataFrame([(1, -1.0, 1.0, -1.0, 1.0, 5.0, False), (2, -1.0, 1.0, -1.0, 1.0, 3.0, False)], VIEW)
    got = spatial.label_top_k(points, views).orderBy("label_rank").collect()
    assert [r["id"] for r in got] == [i for n in range(29, 19, -1) for i in (n, n + 30)]
    assert {r["view_id"] for r in got} == {1}


def test_cluster_labels_of_views(spark):
    clusters = spark.createDataFrame([(i, i) for i in range(100)], "cluster_id int, total_weekly_downloads bigint")
    views = spark.createDataFrame([(1, 1.9, True), (2, 2.0, True), (3, 3.0, True), (4, 1.0, False)], "view_id int, zoom double, mobile boolean")
    got = spatial.cluster_label_top_k(clusters, views).collect()
    counts = {v: sum(r["view_id"] == v for r in got) for v in (1, 2, 3, 4)}
    assert counts == {1: 30, 2: 80, 3: 100, 4: 100}
    assert min(r["cluster_id"] for r in got if r["view_id"] == 1) == 70


def test_detail_and_list(spark):
    points = spark.createDataFrame([(1, "a", "", 0, 5), (2, "b", "x", 9, 6)], "id bigint, name string, summary string, cluster_id int, weekly_downloads bigint")
    clusters = spark.createDataFrame([(0, "éclair"), (1, "Zebra"), (2, "apple"), (3, "fig")], "cluster_id int, label string")
    assert tuple(spatial.detail_lookup(points, clusters, 1).first()) == (1, "a", "éclair", 5, "No description available")
    assert spatial.detail_lookup(points, clusters, 2).first()["cluster_label"] is None
    assert [r["label"] for r in spatial.cluster_list(clusters).collect()] == ["apple", "éclair", "fig", "Zebra"]




def test_labels_come_from_the_most_used_points_first(spark, monkeypatch):
    """Viewports with all their labels meet no further points; those with few points meet all."""
    rng = random.Random(5)
    rows = [(i if i % 40 else None, rng.random() * 10, rng.random() * 10, rng.choice([None, 1, 2, 3, 900]), i % 3) for i in range(1500)]
    points = spark.createDataFrame(rows, "id long, x double, y double, weekly_downloads long, cluster_id int").where("id IS NOT NULL")
    boxes = [(i, x, x + w, x, x + w, 25.0 if i % 4 else 5.0, i % 3 == 0) for i in range(60) for x, w in [(rng.random() * 8, rng.choice([0.1, 1.0, 4.0]))]]
    boxes += [(None, 0.0, 9.0, 0.0, 9.0, 21.0, False), (61, 2.0, 7.0, 2.0, 7.0, 3.0, False)]
    views = spark.createDataFrame(boxes, "view_id long, min_x double, max_x double, min_y double, max_y double, zoom double, mobile boolean")
    selected = spark.createDataFrame([(0,), (2,), (2,)], "cluster_id int")
    met = []
    plain = spatial.viewport_points
    monkeypatch.setattr(spatial, "viewport_points", lambda p, v, s=None: met.append((p.count(), v.count())) or plain(p, v, s))
    monkeypatch.setattr(spatial, "TIER", 100)
    monkeypatch.setattr(spatial, "TIER_GROWTH", 3)
    got = {(r["view_id"], r["label_rank"]): r["id"] for r in spatial.label_top_k(points, views, selected).collect()}
    expected = {}
    for view, x0, x1, y0, y1, zoom, mobile in boxes:
        pad = 0.1 * min(x1 - x0, y1 - y0)
        seen = [r for r in rows if r[0] is not None and r[4] != 1 and x0 - pad <= r[1] <= x1 + pad and y0 - pad <= r[2] <= y1 + pad]
        seen.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        limit = 0 if zoom < 4 else 25 if mobile else 20 if zoom < 7 else 30 if zoom < 20 else 50
        expected |= {(view, k + 1): r[0] for k, r in enumerate(seen[:limit])}
    assert got == expected
    assert len(met) == 4 and met[0] == (100, 61) and met[1][0] == 200
    assert met[1][1] < 61 and met[3][1] < met[1][1]
