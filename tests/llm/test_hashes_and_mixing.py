"""Multiset fingerprints, near copies and source mixing against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skychart.llm import fingerprints, jaccard, mixing

EXTRA = ", _text string, rep string, comp string, run string, n string, _range string, kind string"


def frame(spark, texts):
    rows = [(i, t, "a", "b", "c", "d", "e", "f", "g") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string" + EXTRA)


def test_edits_and_likeness(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [(i, "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(10))) for i in range(30)]
    lines = texts[3][1].split("\n")
    texts += [(30, "\n".join(reversed(lines))), (31, None), (32, ""), (33, "é"), (34, "x" * 100_000), (34, "x" * 100_000), (None, "no id")]
    order = sorted(texts, key=lambda r: -1 if r[0] is None else r[0])
    got = {r["doc_id"]: r for r in fingerprints.compared_with_edits(frame(spark, texts)).collect()}
    assert len(got) == 36
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i]["n_chars"] == len(t)
        if i != 34:  # the two equal rows stand in either order
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    wide = 8 * fingerprints.WIDE_LANES
    assert got[3]["fingerprint"] == got[30]["fingerprint"]
    assert got[31]["fingerprint"] == got[32]["fingerprint"] and got[31]["near_next"] == 1.0
    assert len({got[i]["fingerprint"][:wide] for i in range(30)}) == 30
    near = np.mean([got[i]["near_edited"] for i in range(30)])
    assert 0.35 < near < 0.75 and np.mean([got[i]["near_next"] for i in range(29)]) < 0.2
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("near_edited", "near_next"))
    assert fingerprints.compared_with_edits(frame(spark, texts).limit(0)).count() == 0
    one = fingerprints.compared_with_edits(frame(spark, texts[:1])).first()
    assert one["near_next"] == 1.0


def test_vectors_add_and_subtract(spark):
    rows = spark.createDataFrame([(0, "a b c\nd e"), (1, "a b c"), (2, "d e"), (3, "d e\na b c")], "k int, _text string")
    got = {r["k"]: r for r in fingerprints.vectors(rows, ["k"]).collect()}
    assert got[0]["wide"] == got[3]["wide"] and got[0]["like"] == got[3]["like"]
    both = spark.createDataFrame([(got[1]["wide"], got[2]["wide"], got[0]["wide"])], "a array<bigint>, b array<bigint>, c array<bigint>")
    row = both.select(fingerprints.combined(F.col("a"), F.col("b")).alias("sum"), fingerprints.combined(F.col("c"), F.col("b"), -1).alias("rest")).first()
    assert row["sum"] == got[0]["wide"] and row["rest"] == got[1]["wide"]


def plain_components(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n ", "one", "One", "one two three", "ONE two  three", "z " * 4000]
    passage = " ".join(rng.choices(vocabulary, k=60))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 20, 80, 150]))
        for _ in range(rng.choice([1, 2, 9, 30])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
            texts.append(passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice([3, 30]))))
    texts += [texts[20]] * 3
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "percent", "block", "first"), [(4, 85, 4096, 4), (5, 80, 3, 1)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, block, first):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PROPOSALS", first)
    monkeypatch.setattr(jaccard, "FACTOR", 2)
    texts = near_copies()
    docs = frame(spark, [*texts, (9, texts[9][1])]).repartition(3)
    got = jaccard.components(docs, words, percent).collect()
    assert len(got) == len(texts) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(texts, words, percent)


def test_components_of_odd_tables(spark):
    assert jaccard.components(frame(spark, [(1, "a")]).limit(0)).count() == 0
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.components(frame(spark, [(None, "a b"), (4, "a b"), (None, "c")])).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


def test_tree_finds_what_a_scan_finds(monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF", 4)
    rng = np.random.default_rng(3)
    points = rng.poisson(rng.choice([0.2, 1.0, 3.0], (200, 1)), (200, 16))
    points[100:150] = points[:50]
    sizes = points.sum(axis=1)
    tree = jaccard.PointTree(points, sizes)
    for i in range(0, 200, 7):
        found = set(tree.order[tree.candidates(points[i], int(sizes[i]), 80)].tolist())
        bound = np.minimum(points, points[i]).sum(axis=1)
        need = 180 * bound >= 80 * (sizes + sizes[i])
        near = need & (100 * np.minimum(sizes, sizes[i]) >= 80 * np.maximum(sizes, sizes[i]))
        assert set(np.flatnonzero(near).tolist()) <= found


def mix_docs(spark):
    rng = random.Random(6)
    rows = [
        (i, " ".join(["word"] * rng.randrange(1, 60)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b"]), i, "t", 0.5)
        for i in range(300)
    ]
    rows += [(300, None, "en", "a", 0, "t", 0.0), (301, "", None, None, 0, "u", 0.0), (None, "one two", "de", "b", 0, "t", 0.0), rows[0]]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, topic string, weight double")


def test_raked_weights_meet_the_targets(spark):
    docs = mix_docs(spark)
    targets = {
        "lang": spark.createDataFrame([("en", 2.0), ("de", 1.0), ("", 1.0), ("fr", 5.0)], "lang string, target double"),
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "source string, target double"),
    }
    got = mixing.mixed(docs, targets=targets).collect()
    assert len(got) == 304
    shares = collections.Counter()
    for r in got:
        shares["lang", r["_lang"]] += r["_tokens"] * (r["_ratio"] or 0)
        shares["source", r["_source"]] += r["_tokens"] * (r["_ratio"] or 0)
    total = sum(r["_tokens"] for r in got)
    for key, share in {("lang", "en"): 0.5, ("lang", "de"): 0.25, ("lang", ""): 0.25, ("source", "a"): 0.5, ("source", "b"): 0.5}.items():
        assert shares[key] / total == pytest.approx(share, abs=1e-5)
    assert max(r["_probability"] for r in got) == 1.0
    kept = mixing.sample(docs, targets=targets)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["_sampled"])


def test_mixing_odd_tables(spark):
    docs = mix_docs(spark)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.sample(docs.where("doc_id >= 300")).count() >= 2
    assert [tuple(r) for r in docs.select(mixing.n_tokens(F.col("text"))).where("doc_id >= 300").collect()] == [(0,), (0,)]


def test_a_rare_cell_does_not_thin_the_rest(spark):
    """One document of five words from a new source repeats; the others keep their copies."""
    rows = [(i, "word " * 60, "en", "ab"[i % 2], "t") for i in range(400)] + [(400, "a b c d e", "en", "new", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, topic string")
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    assert sum(got[i]["_sampled"] for i in range(400)) > 380
    assert got[400]["_copies"] > 1 and got[400]["_probability"] == 1.0
    tokens = sum(r["_tokens"] for r in got.values())
    assert sum(r["_tokens"] * r["_copies"] for r in got.values()) == pytest.approx(tokens, rel=0.05)
    kept = collections.Counter(r["doc_id"] for r in mixing.sample(docs, repeats=True).collect())
    assert kept == {i: r["_copies"] for i, r in got.items() if r["_copies"]}


def test_rows_without_id_have_their_own_draws(spark):
    """A third of the rows without id, most of these alike: the targets are met as closely as with ids."""
    rows = [(None if i % 3 == 0 else i, "one two three four" + (f" {i}" if i % 2 else ""), "en", "ab"[i % 10 == 0]) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = {"source": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "source string, target double")}
    drawn = mixing.mixed(docs, targets=targets)
    assert "_nameless" not in drawn.columns
    got = drawn.groupBy("_source").agg(F.sum(F.col("_tokens") * F.col("_copies")).alias("n")).collect()
    total = sum(r["n"] for r in got)
    assert {r["_source"]: r["n"] / total for r in got} == pytest.approx({"a": 0.7, "b": 0.3}, abs=0.01)
    copies = drawn.where("doc_id IS NULL AND _source = 'b'").select("_copies").distinct().count()
    assert copies == 2


def test_lanes_are_seeded_before_the_digests(spark):
    """Each wide lane is a hash of its own: its number is hashed before the paragraph's digests."""
    docs = spark.createDataFrame([(0, "a paragraph")], "k int, _text string")
    wide = fingerprints.vectors(docs, ["k"]).first()["wide"]
    digests = docs.select(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit("second"), "_text").alias("b"))
    lanes = [F.shiftrightunsigned(F.xxhash64(F.lit(j), "a", "b"), 32) for j in range(fingerprints.WIDE_LANES)]
    assert list(wide) == list(digests.select(*lanes).first())


def test_rows_without_id_hide_and_bridge_nothing(spark):
    """A null-id copy ahead of a near-copy pair; a null-id text between two that are not alike themselves."""
    w = [f"w{i}" for i in range(120)]
    pair = [(None, " ".join(w)), (7, " ".join(w)), (3, " ".join([*w[:-1], "other"]))]
    chain = [f"v{i}" for i in range(120)]
    bridge = [(20, " ".join(chain[:100])), (None, " ".join(chain[:110])), (21, " ".join(chain))]
    lone = [(None, "p q r s t u v"), (None, "p q r s t u v"), (None, ""), (None, None), (None, None)]
    docs = frame(spark, [*pair, *bridge, *lone]).coalesce(1)
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in jaccard.components(docs, 5, 90).collect())
    assert got == {(None, 3): 1, (7, 3): 1, (3, 3): 1, (20, 20): 1, (None, 20): 1, (21, 20): 1, (None, None): 5}
    kept = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_copy(spark, docs, "").collect())
    assert sorted(i for i, _ in kept if i is not None) == [3, 20]
    assert {t: n for (i, t), n in kept.items() if i is None} == {"p q r s t u v": 1, "": 1, None: 2}


def test_points_travel_in_few_bytes(spark):
    """A text with a few hundred runs has a point of 64 bytes; larger counts take more, and all come back as they were."""
    rng = np.random.default_rng(3)
    for largest in (1, 15, 16, 255, 256, 70_000):
        points = rng.integers(0, largest + 1, (5, jaccard.AXES))
        points[:, 0] = largest
        found = jaccard.unpacked(pa.array([jaccard.packed(p) for p in points], pa.binary()))
        assert (found == points).all()
    mixed = [np.full(jaccard.AXES, n) for n in (3, 300, 30, 0)]
    assert (jaccard.unpacked(pa.array([jaccard.packed(p) for p in mixed], pa.binary())) == np.array(mixed)).all()
    assert jaccard.unpacked(pa.array([], pa.binary())).shape == (0, jaccard.AXES)
    rows = [(i, " ".join(f"w{j}" for j in range(i, i + 100 * i))) for i in (1, 2, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in jaccard.points_of(docs, 4, docs.select("doc_id")).collect()}
    assert [len(got[i]["point"]) for i in (1, 2, 200)] == [64, 64, 128]
    for i in got:
        assert jaccard.unpacked(pa.array([bytes(got[i]["point"])], pa.binary())).sum() == got[i]["n"] == 100 * i - 3


def test_a_text_travels_once_to_the_pairs_of_a_small_group(spark, monkeypatch):
    """All pairs of a small group meet in one part; those of one document with very many others are spread over several."""
    groups = [(10 * g + i, 10 * g + j) for g in range(20) for i in range(5) for j in range(i + 1, 5)]
    hub = [(min(x, 1000), max(x, 1000)) for x in (*range(700, 800), *range(1001, 1101))]
    pairs = spark.createDataFrame(groups + hub, "a bigint, b bigint")
    monkeypatch.setattr(jaccard, "PAIRS", 20)
    rows = jaccard.dealt_pairs(pairs).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(groups + hub)
    places, load = collections.defaultdict(set), collections.Counter()
    for r in rows:
        load[r["key"], r["part"]] += 1
        for end in (r["a"], r["b"]):
            places[end].add((r["key"], r["part"]))
    assert all(len(places[10 * g + i]) == 1 for g in range(20) for i in range(5))
    assert max(load.values()) <= 60 and len(places[1000]) >= 8
    assert all(len(places[b if a == 1000 else a]) == 1 for a, b in hub)


def test_pairs_are_compared_run_by_run(spark):
    texts = [(1, "a b c d e f g h"), (2, "A b c d e f g h i"), (3, "x y z"), (3, "x y z"), (4, "x y z v w"), (5, "p q r")]
    docs = frame(spark, [*texts, (None, "x y z")]).repartition(3)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (2, 4)], "a bigint, b bigint")
    for percent, linked in ((80, {(1, 2)}), (90, set())):
        got = jaccard.compared_pairs(docs.select("doc_id", "text"), 2, percent, jaccard.dealt_pairs(pairs)).collect()
        assert sorted((r["a"], r["b"]) for r in got) == [(1, 2), (1, 3), (2, 4), (3, 4)]
        assert {(r["a"], r["b"]) for r in got if r["linked"]} == linked
