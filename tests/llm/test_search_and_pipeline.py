"""Neighbour search against brute force; the pipeline and the registered queries on the smallest tables."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from skychart.llm import ann, jaccard

FOLDER = "/root/testdata/sf0.001"


def plain_nearest(ids, vectors, query, k):
    scores = (vectors * vectors[query]).sum(axis=1)
    rows = [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True) if i != ids[query]]
    return [(i, -s) for s, i in sorted(rows)[:k]]


def test_search_reaches_its_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    monkeypatch.setattr(ann, "PART_ROWS", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32).astype(float)
    vectors[300:500] = vectors[7]
    rows = [(i, v, 1.0, "x") for i, v in enumerate(vectors.tolist())]
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [float("inf")] + [0.0] * 15), (1080, [1.0, None] + [0.0] * 14), (1100, [1.0]), (None, [1.0] * 16)]
    rows += [(i, v, 0.0, "y") for i, v in odd] + [rows[20]]
    table = spark.createDataFrame(rows, "vec_id bigint, vector array<double>, score double, leaf string").repartition(4)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, sample=400, calibration=30).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        expected = plain_nearest(np.arange(900), vectors, q, 20)
        hits += len({f[1] for f in found} & {e[0] for e in expected})
        assert all(f[2] == pytest.approx(float((vectors[q] * vectors[f[1]]).sum()), abs=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
    assert hits >= 0.9 * 20 * len(got)


def test_search_of_small_tables(spark):
    schema = "vec_id bigint, vector array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 2.0])], schema)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0
    assert ann.search(few.limit(1), F.lit(True)).count() == 0


def test_names():
    names = set(entry_module.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secret_scan", "source_mix", "packing"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not present")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = docs.withColumn("kind", F.lit("x")).withColumn("_score", F.lit(1.0)).withColumn("_tokens", F.lit(1))
    extra = extra.unionByName(extra.limit(3)).unionByName(
        extra.limit(1).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    )
    tables = [extra]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], FOLDER).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "packing":
            assert tables[-1].columns == extra.columns
        assert stage(spark, tables[-2].limit(0), FOLDER).count() == 0
    civil, single, hidden, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables[1:])
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 0").collect()}
    before = {r["doc_id"] for r in docs.collect()}
    assert toxic & before <= {r["doc_id"] for r in civil}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.components(tables[1]).collect() if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in single if r["doc_id"] is not None) == sorted(set(groups.values()))
    old = {r["doc_id"]: r["text"] for r in single}
    assert len(hidden) == len(single)
    for r in hidden:
        assert r["text"] is None or r["text"] == re.sub(r'(?<=token = ")[0-9a-f]{40}', "[secret]", old[r["doc_id"]])
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in hidden}
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}
