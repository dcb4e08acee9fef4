"""Neighbours, fuzzy graph, layout, density clusters, embedding and the whole pipeline."""

import hashlib
import json
import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from skychart import schemas
from skychart.functions import vectors
from skychart.operators import density, embed, knn, labels, layout
from skychart.plans import pipeline
from skychart.sources.workspace import Workspace

VEC = "id bigint, vec array<double>"


def frame(spark, data):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], VEC)


def blobs(seed=42, n=100, dims=32, centers=3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centers, dims)) * 5
    of = np.arange(n) % centers
    return middle[of] + rng.standard_normal((n, dims)) * 0.5, of


def brute(data, k):
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(gaps, np.inf)
    return {i: [(j, gaps[i, j]) for j in np.lexsort((np.arange(len(data)), gaps[i]))[:k] if gaps[i, j] < np.inf] for i in range(len(data))}


def lists(df):
    found = {}
    for r in df.orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["neighbor"], r["distance"]))
    return found


@pytest.mark.parametrize("small", [False, True])
def test_knn_with_copies(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(knn, "POINTS_PER_PIVOT", 20)
        monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
        monkeypatch.setattr(knn, "CANDIDATE_BLOCK", 30)
    data, _ = blobs(n=120, dims=3)
    data[80:] = data[0]
    got = lists(knn.knn_exact(frame(spark, data), 4))
    for i, want in brute(data, 4).items():
        assert [j for j, _ in got[i]] == [j for j, _ in want]
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want], abs=1e-12)


def test_knn_of_few_vectors(spark):
    assert knn.knn_exact(frame(spark, [[1.0, 2.0]]), 3).count() == 0
    assert lists(knn.knn_exact(frame(spark, [[0.0], [3.0]]), 3)) == {0: [(1, 3.0)], 1: [(0, 3.0)]}


def test_approximate_neighbours_are_mostly_true(spark):
    data, _ = blobs(n=400, dims=8)
    data[:60] = data[0]
    got = lists(knn.knn_approximate(frame(spark, data), 5, trees=4, leaf=64))
    want = brute(data, 5)
    hits = sum(d <= want[i][-1][1] + 1e-9 for i in got for _, d in got[i])
    assert all(len(got[i]) == 5 for i in range(400))
    assert hits >= 0.95 * 400 * 5


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [r[0] for r in df.select(vectors.l2_normalize(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_memberships_sum_to_the_target(spark):
    data, _ = blobs(n=60, dims=4)
    near = knn.knn_exact(frame(spark, data), 9)
    sums = layout.membership(near, 10).groupBy("id").agg(F.sum("weight").alias("s"), F.max("weight").alias("m")).collect()
    assert len(sums) == 60
    for r in sums:
        assert r["s"] == pytest.approx(math.log2(10), abs=1e-4)
        assert r["m"] == 1.0


def test_curve_parameters():
    assert layout.curve_parameters(0.1, 1.0) == pytest.approx((1.577, 0.895), abs=2e-3)


def test_layout_repeats_and_keeps_groups_apart(spark):
    data, of = blobs(n=60, dims=16)
    df = frame(spark, data)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "id bigint, label int")
    near = Workspace(spark).write(layout.neighbors(layout.unit_vectors(df), 11, "exact"), "knn")
    runs = []
    for partitions in (1, 5):
        placed = layout.map_coordinates(df.repartition(partitions), labels, epochs=8, knn=near)
        runs.append({r["id"]: (r["x"], r["y"]) for r in placed.collect()})
    assert runs[0] == runs[1]
    spots = np.array([runs[0][i] for i in range(60)])
    middle = np.stack([spots[of == c].mean(axis=0) for c in range(3)])
    nearest = ((spots[:, None] - middle[None]) ** 2).sum(-1).argmin(axis=1)
    assert (nearest == of).mean() > 0.95


# --- density clusters against a direct reading of the definition -----------------------------


def direct_clusters(data, size, eps, min_samples=2):
    """Single linkage, condensed tree, leaves, and the climb of leaves born within eps."""
    n = len(data)
    gaps = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1))
    core = np.sort(gaps, axis=1)[:, min_samples]
    reach = np.maximum(np.maximum(gaps, core[:, None]), core[None])
    order = sorted((reach[i, j], i, j) for i in range(n) for j in range(i))
    node = {i: (frozenset([i]), None, None, 0.0) for i in range(n)}
    for w, i, j in order:
        if node[i] is not node[j]:
            merged = (node[i][0] | node[j][0], node[i], node[j], w)
            for m in merged[0]:
                node[m] = merged
    # Clusters of the condensed tree: (members, birth distance, parent, children).
    clusters = []

    def condense(tree, parent, birth):
        me = {"members": tree[0], "birth": birth, "parent": parent, "children": []}
        clusters.append(me)
        if parent:
            parent["children"].append(me)
        while tree[1] is not None:
            a, b = tree[1], tree[2]
            if len(a[0]) >= size and len(b[0]) >= size:
                condense(a, me, tree[3])
                condense(b, me, tree[3])
                return
            tree = a if len(a[0]) >= len(b[0]) else b
            if len(tree[0]) < size:
                return

    condense(node[0], None, math.inf)
    root = clusters[0]
    chosen = []
    for leaf in (c for c in clusters if not c["children"] and c is not root):
        if any(leaf["members"] <= c["members"] for c in chosen):
            continue
        while leaf["birth"] <= eps and leaf["parent"] is not root:
            leaf = leaf["parent"]
        chosen.append(leaf)
    labels = [-1] * n
    for number, c in enumerate(sorted(chosen, key=lambda c: min(c["members"]))):
        for m in c["members"]:
            labels[m] = number
    return labels


def cluster_ids(df):
    return [r["cluster_id"] for r in df.orderBy("id").collect()]


def scattered(seed):
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((rng.integers(4, 16), 2)) * rng.uniform(0.2, 1.0) + rng.uniform(-6, 6, 2) for _ in range(4)]
    return np.concatenate([*parts, rng.uniform(-8, 8, (8, 2))])


@pytest.mark.parametrize("seed", range(3))
def test_density_equals_the_definition(spark, seed):
    data = scattered(seed)
    tree = Workspace(spark).write(density.reachability_tree(frame(spark, data), 2, "exact"), "tree")
    for size, eps in ((4, 0.0), (4, 0.7), (3, 50.0)):
        want = direct_clusters(data, size, eps)
        got = density.clusters_of_tree(tree, size, eps, persistence=0.0)
        assert cluster_ids(got) == want, (size, eps)


@pytest.mark.parametrize(("seed", "persistence"), [(1, 0.0), (2, 0.5)])
def test_density_rounds_equal_one_task(spark, seed, persistence):
    tree = Workspace(spark).write(density.reachability_tree(frame(spark, scattered(seed)), 2, "exact"), "tree")
    once = cluster_ids(density.clusters_of_tree(tree, 4, 0.3, persistence))
    rounds = cluster_ids(density.clusters_of_tree(tree, 4, 0.3, persistence, local_edges=12))
    assert rounds == once


def test_density_blobs(spark):
    data, of = blobs()
    unit = layout.unit_vectors(frame(spark, data))
    reduced = layout.reduce_dims(unit, 8, epochs=8)
    got = cluster_ids(density.density_clusters(reduced, persistence=0.0, eps=0.3))
    shares = [np.bincount(np.array(got)[of == c] + 1, minlength=4)[1:].max() / (of == c).sum() for c in range(3)]
    assert len({g for g in got if g >= 0}) == 3
    assert min(shares) > 0.9


def test_density_by_neighbour_graph(spark):
    data, of = blobs(n=90, dims=4)
    got = cluster_ids(density.density_clusters(frame(spark, data), eps=1.2, method="graph"))
    # The first and the last group overlap.
    assert got == [int(c == 1) for c in of]


def test_density_of_one_vector(spark):
    assert cluster_ids(density.density_clusters(frame(spark, [[1.0, 2.0]]))) == [-1]


def test_embedding(spark):
    texts = ["fast maps for data", "FAST maps, for data!", "something else", "", None, "data, data for data"] + ["for"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    got = {r["id"]: np.array(r["embeddings"]) for r in embed.embed_text(df, "text", batch_size=2).collect()}
    assert np.allclose(got[0], got[1])
    assert not got[3].any()
    assert not got[4].any()

    # Every value from the definition: signs of digests, roots of counts, inverse document frequencies of all texts.
    words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    frequency = Counter(w for ws in words for w in set(ws))
    for i, ws in enumerate(words):
        want = np.zeros(128)
        for w, n in Counter(ws).items():
            bits = f"{int(hashlib.md5(f'0:{w}'.encode()).hexdigest(), 16):0128b}"
            weight = math.sqrt(n) * (math.log((1 + len(texts)) / (1 + frequency[w])) + 1)
            want += weight * np.array([1 if b == "1" else -1 for b in bits])
        assert np.allclose(got[i], want / (np.linalg.norm(want) or 1), atol=1e-6)
    # A word that all texts share says less than a rare one.
    plain = embed.hashing_encoder()(texts)
    assert got[2] @ got[2] == pytest.approx(1) and plain[5] @ plain[6] > got[5] @ got[6]
    wide = embed.hashing_encoder(200)(["one two", ""])
    assert wide.shape == (2, 200) and np.linalg.norm(wide[0]) == pytest.approx(1)
    assert embed.fit_frequencies(df, "text").texts == len(texts)
    # Embedding some rows with what was learned from all gives the same vectors.
    some = embed.embed_text(df.where("id < 3"), "text", embed.fitted_encoder(df, "text")).collect()
    assert all(np.array_equal(np.array(r["embeddings"]), got[r["id"]]) for r in some)

    def lengths():
        return lambda batch: np.array([[len(t)] for t in batch], dtype="float32")

    got = {r["id"]: r["v"] for r in embed.embed_text(df, "text", lengths, "v").collect()}
    assert {i: got[i] for i in range(5)} == {0: [18.0], 1: [20.0], 2: [14.0], 3: [0.0], 4: [0.0]}


def test_pipeline(spark):
    random.seed(3)
    topics = ["plot chart figure axis", "http server socket request", "matrix tensor linear solve"]
    rows = []
    for i in range(90):
        words = random.choices(topics[i % 3].split(), k=30)
        rows.append((f"n{i}", "# About\n\n" + " ".join(words), None, " ".join(words[:4]), "1", str(1000 - i)))
    rows += [rows[0], ("empty", None, None, None, "1", "5")]
    raw = spark.createDataFrame(rows, schemas.RAW_DATASET)
    folder = Workspace(spark).folder + "/map"
    settings = pipeline.MapSettings(top_packages=80, reduced_dimensions=4, epochs=4, eps=0.3)
    out = pipeline.run_pipeline(raw, folder, settings)
    packages = out["packages"].collect()
    assert sorted(r["id"] for r in packages) == list(range(80))
    assert {r["name"]: r["id"] for r in packages}["n0"] == 0
    assert out["clusters"].where("label IS NULL OR downloads IS NULL").isEmpty()
    written = spark.read.schema(schemas.PACKAGES_JSON).json(f"{folder}/packages.json")
    assert written.count() == 80


def test_stages_are_skipped_only_while_nothing_changed(spark):
    words = ["plot chart figure axis", "http server socket request"]
    rows = [(f"n{i}", f"# T\n\n{words[i % 2]} x{i % 5}", None, words[i % 2], "1", str(100 - i)) for i in range(40)]
    raw = spark.createDataFrame(rows, schemas.RAW_DATASET)
    folder = Workspace(spark).folder + "/map"
    base = pipeline.MapSettings(top_packages=30, reduced_dimensions=2, epochs=2, overwrite=False)

    def versions():
        read = {n: spark.read.text(f"{folder}/_manifests/{n}").first()[0] for n in pipeline.STAGES}
        return {n: json.loads(said) for n, said in read.items()}

    pipeline.run_pipeline(raw, folder, base)
    first = versions()
    assert first["processed_dataset"]["columns"] and first["embeddings"]["settings"]["batch_size"] == 128

    def rebuilt(df, settings):
        before = versions()
        pipeline.run_pipeline(df, folder, settings)
        return {n for n, said in versions().items() if said["version"] != before[n]["version"]}

    # The same rows in another order change nothing.
    assert rebuilt(raw.orderBy("summary"), base) == set()
    late = {"cluster_labels", "clusters"}
    assert rebuilt(raw, replace(base, labeler=other_terms)) == late
    assert rebuilt(raw, replace(base, labeler=other_terms, top_packages=20)) == set(pipeline.STAGES)
    assert spark.read.schema(schemas.PACKAGES_JSON).json(f"{folder}/packages.json").count() == 20
    # A stage that was broken off has no manifest and is built again, with all that follows.
    again = replace(base, labeler=other_terms, top_packages=20)
    pipeline.Manifests(spark, folder, again).begin("constellations")
    before = spark.read.text(f"{folder}/_manifests/numbered").first()[0]
    pipeline.run_pipeline(raw, folder, again)
    assert versions()["constellations"]["inputs"] == {"clustered_dataset": versions()["clustered_dataset"]["version"]}
    assert versions()["links"]["inputs"]["constellations"] == versions()["constellations"]["version"]
    assert spark.read.text(f"{folder}/_manifests/numbered").first()[0] == before
    assert rebuilt(raw.limit(10), again) == set(pipeline.STAGES)


def other_terms(points):
    return labels.top_terms(points)
