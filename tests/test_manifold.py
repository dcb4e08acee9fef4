"""Neighbour descent, spectral start and edge schedule against plain versions."""

import numpy as np
import pytest


from skychart.operators import density, descent, layout, spectral
from skychart.sources.workspace import Workspace


def frame(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id bigint, vec array<double>")


def true_distances(data):
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    return gaps


def ring(rng, base, n, chords):
    """A ring with random chords of random weight: one connected part without equal eigenvalues."""
    weights = {(i, (i + 1) % n): 1.0 for i in range(n)}
    for a, b in rng.integers(0, n, (chords, 2)).tolist():
        if a != b:
            weights[min(a, b), max(a, b)] = float(rng.random() + 0.1)
    return [(base + a, base + b, w) for (a, b), w in weights.items()]


def test_descent_finds_nearly_all_neighbours_from_small_leaves(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((600, 16))
    data[:12] = data[0]
    got = descent.knn_descent(frame(spark, data), 6, leaf=24, trees=1)
    rows = got.collect()
    gaps = true_distances(data)
    limit = np.sort(gaps, axis=1)[:, 5]
    assert [r["distance"] for r in rows if r["id"] < 12] == [0.0] * 72
    assert len(rows) == 600 * 6
    assert all(r["id"] != r["neighbor"] for r in rows)
    assert all(r["distance"] == pytest.approx(gaps[r["id"], r["neighbor"]], abs=1e-9) for r in rows)
    assert np.mean([r["distance"] <= limit[r["id"]] + 1e-9 for r in rows]) > 0.97
    # The leaves alone miss many: the rounds find them.
    alone = descent.knn_descent(frame(spark, data), 6, leaf=24, trees=1, rounds=0).collect()
    assert np.mean([r["distance"] <= limit[r["id"]] + 1e-9 for r in alone]) < 0.7


def test_descent_repeats_and_handles_few_vectors(spark):
    data = np.random.default_rng(3).standard_normal((90, 5))
    results = []
    for partitions in (1, 4):
        rows = descent.knn_descent(frame(spark, data).repartition(partitions), 4, leaf=16).collect()
        results.append(sorted((r["id"], r["rank"], r["neighbor"], r["distance"]) for r in rows))
    assert results[0] == results[1]
    assert descent.knn_descent(frame(spark, data[:1]), 4).count() == 0
    assert descent.knn_descent(frame(spark, data[:3]), 4).count() == 6
    assert descent.knn_descent(frame(spark, data).limit(0), 4).count() == 0


@pytest.mark.parametrize("dense", [2048, 0])
def test_spectral_vectors_equal_a_dense_solution(spark, dense):
    rng = np.random.default_rng(1)
    edges = [*ring(rng, 0, 150, 60), *ring(rng, 1000, 90, 20), (5000, 5001, 2.0), (7, 7, 5.0), (3, 9, 0.0)]
    graph = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    got = spectral.spectral_vectors(graph, 2, dense=dense).toPandas()
    assert len(got) == 242
    for base, n in ((0, 150), (1000, 90)):
        weights = np.zeros((n, n))
        for a, b, w in edges:
            if base <= a < base + n and a != b:
                weights[a - base, b - base] += w
                weights[b - base, a - base] += w
        degrees = weights.sum(axis=1)
        values, vectors = np.linalg.eigh(np.eye(n) - weights / np.sqrt(np.outer(degrees, degrees)))
        own = got[got.component == base].sort_values("id")
        assert np.allclose(np.stack(own["eigenvalues"])[0], values[1:3], atol=1e-5)
        found = np.stack(own["vec"])
        assert [abs(found[:, j] @ vectors[:, j + 1]) for j in range(2)] == pytest.approx([1, 1], abs=1e-4)
    pair = got[got.component == 5000].sort_values("id")
    assert np.abs(np.stack(pair["vec"])[:, 0]) == pytest.approx([0.5**0.5] * 2)
    assert np.allclose(np.stack(pair["vec"])[:, 1], 0)


def test_spectral_start_keeps_parts_at_their_centers(spark):
    rng = np.random.default_rng(4)
    graph = spark.createDataFrame(ring(rng, 0, 60, 9) + ring(rng, 60, 30, 5), "src bigint, dst bigint, weight double")
    centers = [[0.0, 0.0] if i < 60 else [40.0, 0.0] if i < 90 else [0.0, 90.0] for i in range(91)]
    got = {r["id"]: r["vec"] for r in spectral.spectral_start(graph, frame(spark, centers)).collect()}
    assert len(got) == 91 and got[90] == [0.0, 90.0]
    spots = np.array([got[i] for i in range(90)])
    # Neighbours on the ring lie closer together than points of the same part do.
    steps = np.linalg.norm(spots[:60] - np.roll(spots[:60], 1, axis=0), axis=1).mean()
    assert steps < 0.5 * true_distances(spots[:60])[np.triu_indices(60, 1)].mean()


def test_edges_act_in_proportion_to_their_weights():
    plan = layout.Schedule(1.0, 1.0, 1.0, 40, 0, 10)
    weights = np.array([1.0, 0.5, 0.25, 0.1, 0.03])
    acts = np.stack([plan.acting(weights, e) for e in range(40)])
    assert acts.sum(axis=0).tolist() == [40, 20, 10, 4, 1]
    # Evenly spread, not all at once.
    assert np.diff(np.flatnonzero(acts[:, 2])).tolist() == [4] * 9
    partners = plan.partners(np.arange(1000), np.arange(1000), 3)
    assert partners.min() == 0 and partners.max() == 9
    assert np.abs(np.bincount(partners.ravel()) - 500).max() < 120


def plain_epochs(start, edges, plan):
    """One point and one edge at a time."""
    spots = start.copy()
    for epoch in range(plan.epochs):
        old, rate = spots.copy(), 1 - epoch / plan.epochs
        for i, links in enumerate(edges):
            for j, w in links:
                if not plan.acting(np.array([w]), epoch)[0]:
                    continue
                gap = spots[i] - old[j]
                d2 = (gap**2).sum()
                pull = -2 * plan.a * plan.b * d2 ** (plan.b - 1) / (1 + plan.a * d2**plan.b) if d2 > 0 else 0.0
                spots[i] = spots[i] + rate * np.clip(pull * gap, -4, 4)
                for k in plan.partners(np.array([i]), np.array([j]), epoch)[0]:
                    gap = spots[i] - old[k]
                    d2 = (gap**2).sum()
                    push = 2 * plan.repulsion * plan.b / ((0.001 + d2) * (1 + plan.a * d2**plan.b)) if d2 > 0 else 0.0
                    spots[i] = spots[i] + rate * np.clip(push * gap, -4, 4)
        spots = np.round(spots, 6)
    return spots


def test_both_ways_of_running_epochs_equal_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    edges = ring(rng, 0, 40, 30)
    graph = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    start = frame(spark, rng.standard_normal((42, 2)))
    runs = []
    for shared in (1 << 20, 0):
        placed = layout.layout(graph, start, 0.1, epochs=5, shared_bytes=shared)
        rows = {r["id"]: r["vec"] for r in placed.collect()}
        assert len(rows) == 42
        runs.append(np.array([rows[i] for i in range(42)]))
    assert np.abs(runs[0] - runs[1]).max() < 1e-4

    first = layout.layout(graph, start, 0.1, epochs=0).collect()
    begun = np.array([r["vec"] for r in sorted(first, key=lambda r: r["id"])])
    a, b = layout.curve_parameters(0.1, 1.0)
    plan = layout.Schedule(a, b, 1.0, 5, 0, 42)
    strongest, links = max(w for *_, w in edges), [[] for _ in range(42)]
    for i, j, w in edges:
        if w / strongest * 5 >= 1:
            links[i].append((j, w / strongest))
            links[j].append((i, w / strongest))
    assert np.abs(plain_epochs(begun, [sorted(x) for x in links], plan) - runs[0]).max() < 1e-3


def trustworthiness(high, low, k):
    n = len(high)
    ranks = np.argsort(np.argsort(true_distances(high), axis=1), axis=1)
    near = np.argsort(true_distances(low), axis=1)[:, :k]
    lost = sum(max(0, ranks[i, j] + 1 - k) for i in range(n) for j in near[i])
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * lost


def test_a_curved_sheet_stays_a_sheet(spark):
    """Points without groups, on a rolled sheet: the map must keep neighbourhoods that a projection folds together."""
    rng = np.random.default_rng(7)
    turn, across = 1.5 * np.pi * (1 + 2 * rng.random(400)), 20 * rng.random(400)
    data = np.stack([turn * np.cos(turn), across, turn * np.sin(turn)], axis=1)
    df = frame(spark, data)
    near = Workspace(spark).write(layout.neighbors(df, 11, "exact"), "knn")
    graph = Workspace(spark).write(layout.fuzzy_graph(near, 12), "graph")
    flat = layout.pca(df, 2)
    placed = layout.layout(graph, spectral.spectral_start(graph, flat), 0.1, epochs=60)
    low = np.array([r["vec"] for r in placed.orderBy("id").collect()])
    folded = np.array([r["vec"] for r in flat.orderBy("id").collect()])
    assert trustworthiness(data, low, 10) > 0.97 > trustworthiness(data, folded, 10)


def test_kept_neighbours(spark):
    near = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3)], "id bigint, neighbor bigint")
    other = spark.createDataFrame([(1, 2), (1, 9), (2, 7), (2, 8)], "id bigint, neighbor bigint")
    got = {r["id"]: r["kept"] for r in layout.kept_neighbors(near, other).collect()}
    assert got == {1: 0.5, 2: 0.0}


def test_parts_join_by_their_least_edges_without_opening_all_blocks(spark, monkeypatch):
    """Six groups of equal size: only blocks that may hold a least edge are compared, and the tree is that over all pairs."""
    rng = np.random.default_rng(8)
    middle = rng.standard_normal((6, 6)) * 30
    data = middle[np.arange(240) % 6] + rng.standard_normal((240, 6))
    opened = []
    compare = density._least_edges

    def counted(placed, largest, pairs):
        opened.append(pairs.count())
        return compare(placed, largest, pairs)

    monkeypatch.setattr(density, "_least_edges", counted)
    monkeypatch.setattr(density, "BLOCKS_AT_ONCE", 8)
    df = frame(spark, data)
    trees = [
        {(r["src"], r["dst"]): r["weight"] for r in density.reachability_tree(df, 2, method, block=12).collect()}
        for method in ("graph", "exact")
    ]
    assert len(trees[0]) == len(trees[1]) == 239
    between = [{e: w for e, w in t.items() if e[0] % 6 != e[1] % 6} for t in trees]
    assert len(between[0]) == 5 and between[0].keys() == between[1].keys()
    assert sum(trees[0].values()) == pytest.approx(sum(trees[1].values()), rel=1e-6)
    # Two searches a round; opening everything would be all pairs of 20 blocks each round.
    assert 0 < sum(opened) < 0.7 * len(opened) / 2 * 20 * 20


def test_joining_single_vectors(spark):
    """A forest without edges: every vector is a part, and all of them may be equal."""
    data = np.random.default_rng(9).standard_normal((30, 3))
    data[5:9] = data[5]
    points = density._with_core(frame(spark, data), spark.createDataFrame([], "id bigint, core double"))
    space = Workspace(spark)
    points = space.write(points, "points")
    nothing = spark.createDataFrame([], "src bigint, dst bigint, weight double")
    tree = density._joined_parts(points, nothing, 7, space).collect()
    gaps = true_distances(data)
    inside, total = {0}, 0.0
    while len(inside) < 30:
        weight, j = min((gaps[i, j], j) for i in inside for j in range(30) if j not in inside)
        inside.add(j)
        total += weight
    assert len(tree) == 29 and sum(r["weight"] for r in tree) == pytest.approx(total)
