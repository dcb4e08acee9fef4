"""Recent usage, cleaning, ranking, map statistics, labels, outputs and files."""

import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from skychart import schemas
from skychart.operators import clean, labels, mapstats, outputs, ranking, recent
from skychart.sources import files
from skychart.sources.workspace import Workspace


def day(d, hour=0, minute=0):
    return datetime.datetime(2024, 1, d, hour, minute)


def test_date_window_is_inclusive_on_both_ends(spark):
    rows = [(day(10, 23, 59), "a"), (day(3), "a"), (day(2, 23, 59), "a"), (day(10), "A"), (day(9), "b")]
    facts = spark.createDataFrame(rows, schemas.DOWNLOAD_FACTS)
    got = {(r["project_lower"], r["project"]): r["download_count"] for r in recent.recent_counts(facts, min_count=1).collect()}
    assert got == {("a", "a"): 2, ("a", "A"): 1, ("b", "b"): 1}
    assert recent.recent_counts(facts, min_count=2).count() == 1
    anchored = recent.recent_counts(facts, F.to_date(F.lit("2024-01-09")), min_count=1)
    assert {r["project"]: r["download_count"] for r in anchored.collect()} == {"a": 2, "b": 1}


def test_counts_per_spelling_join_the_latest_row(spark):
    facts = spark.createDataFrame(
        [(day(10), "Foo")] * 100 + [(day(10), "foo")] * 99 + [(day(10), "FOO")] * 101, schemas.DOWNLOAD_FACTS
    )
    meta = spark.createDataFrame(
        [
            ("foo", "old", None, "s", "1", day(1)),
            ("Foo", "new", "text/plain", "s", "2", day(2)),
            ("fOO", "new", "text/plain", "r", "1", day(2)),
        ],
        schemas.DISTRIBUTION_METADATA,
    )
    got = recent.popular_items(facts, meta).collect()
    assert [(r["name"], r["latest_version"], r["number_of_downloads"]) for r in got] == [("fOO", "1", 101), ("fOO", "1", 100)]


def test_clean_rows(spark):
    raw = spark.createDataFrame(
        [
            ("a", "d1", None, "s1", "1", "5"),
            ("a", "d2", None, "s2", "1", "7"),
            ("b", None, None, "only summary", "1", "7"),
            ("c", "only\n\"text\"", None, None, "1", "9"),
            ("d", None, None, None, "1", "99"),
        ],
        schemas.RAW_DATASET,
    )
    rows = clean.top_n(clean.read_raw(raw), 0).orderBy("name").collect()
    assert [(r["name"], r["description"], r["summary"], r["weekly_downloads"]) for r in rows] == [
        ("a", "d2", "s2", 7), ("b", "", "only summary", 7), ("c", "only\n\"text\"", "", 9),
    ]
    assert [r["name"] for r in clean.top_n(clean.read_raw(raw), 2).collect()] == ["c", "a"]
    bad = spark.createDataFrame([("a", "d", None, "s", "1", "x")], schemas.RAW_DATASET)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        clean.cast_rename(bad).collect()


def test_running_total_per_group(spark):
    random.seed(1)
    rows = [(random.choice("aab"), random.randrange(50), i, random.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, v int, id int, w int").repartition(7)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = {r["id"]: (r["position"], r["t"]) for r in ranking.running_total(
        ranking.running_total(df, order, ["g"]), order, ["g"], F.col("w"), "t").collect()}
    for g in "ab":
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            assert got[r[2]] == (n, total)
            total += r[3]


def test_running_total_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "g int, v int")
    assert sorted(r["position"] for r in ranking.running_total(df, [F.col("v").asc()], ["g"]).collect()) == [0, 0, 1]


@pytest.mark.parametrize("values", [[1.0, 2.0, 4.0, 10.0], [5.0], [1.0, 1.0, 1.0, 7.0, 9.0], [2.0, 2.0, 3.0, 3.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v, -v) for v in values], "x double, y double")
    got = mapstats.median_center(df).first()
    assert (got["x"], got["y"]) == (statistics.median(values), -statistics.median(values))


POINT = "id bigint, name string, weekly_downloads bigint, summary string, cluster_id int, x double, y double"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def test_map_statistics(spark):
    df = points(
        spark,
        [(0, "a", 5, "", 0, 0.0, 0.0), (1, "b", None, "", 0, 2.0, 4.0), (2, "c", 9, "", 1, 1.0, 1.0), (3, "n", None, "", -1, 9.0, -1.0)],
    )
    meta = {r["cluster_id"]: tuple(r)[1:] for r in mapstats.cluster_metadata(df).collect()}
    assert meta[0] == (1.0, 2.0, 5, 0.0, 2.0, 0.0, 4.0)
    assert meta[-1] == (9.0, -1.0, 0, 9.0, 9.0, -1.0, -1.0)
    assert tuple(mapstats.run_stats(df).first()) == (4, 9, 5, 2, 1)
    assert tuple(mapstats.data_bounds(df).first()) == (0.0, 9.0, -1.0, 4.0, 9.0, 5.0, 4.5, 1.5)
    assert mapstats.data_bounds(df.limit(0)).count() == 0
    plot = mapstats.labeled_plot_table(df, spark.createDataFrame([(0, "L")], "cluster_id int, cluster_label string"))
    got = {r["name"]: (r["cluster_label"], r["weekly_downloads"], r["size"]) for r in plot.collect()}
    assert got["b"] == ("L", 0, 16.0)
    assert got["c"] == ("Unclustered", 9, 128.0)


def test_log_radius(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 3.0, 4.0), (2, -3.0, -4.0)], "id int, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in mapstats.log_radius_scale(df).collect()}
    assert got[0] == (0.0, 0.0)
    assert got[1] == pytest.approx((3 / 5 * math.log(6), 4 / 5 * math.log(6)))


@pytest.mark.parametrize("length", [0, 1, 2, 3, 4, 5, 6, 7, 40])
def test_prompt_budget(spark, length):
    rows = [(i, f"n{i}", 100 - i, "s" * (i % 3) if i % 4 else None, 0, 0.0, 0.0) for i in range(7)]
    text = "\n".join(f"- n{i}: {('s' * (i % 3) if i % 4 else '')[:1]}" for i in range(7))
    budget = length * 2 + 1
    want = text if len(text) <= budget else text[:budget] + "..."
    got = labels.cluster_prompts(points(spark, rows), max_summary=1, max_total=budget).first()["prompt"]
    assert got == labels.INSTRUCTION + want


def test_long_summary_is_cut(spark):
    got = labels.cluster_prompts(points(spark, [(0, "n", 1, "é" * 257, 3, 0.0, 0.0)])).first()["prompt"]
    assert got.endswith("- n: " + "é" * 256)


def test_label_fallbacks(spark):
    df = points(spark, [(i, "", 1, s, c, 0.0, 0.0) for i, (s, c) in enumerate([("fast maps", 0), ("", 1), ("x", -1), ("big data", 2)])])

    def labeler(d):
        return d.select("cluster_id").distinct().withColumn("answer", F.when(F.col("cluster_id") == 0, " Maps ").when(F.col("cluster_id") == 2, " "))

    got = {r[0]: r[1] for r in labels.cluster_labels(df, labeler).collect()}
    assert got == {0: "Maps", 1: "Cluster 1", 2: "Cluster 2", -1: "Not clustered"}
    assert {r[0]: r[1] for r in labels.cluster_labels(df).collect()}[0] == "fast maps"


def test_outputs(spark):
    df = points(spark, [(0, "a", 5, "s", 0, 0.0, 0.0), (0, "b", 9, "s", 0, 1.0, 1.0), (0, "c", None, "s", 1, 2.0, 2.0)]).drop("id")
    numbered = outputs.with_ids(df)
    assert {r["name"]: r["id"] for r in numbered.collect()} == {"b": 0, "a": 1, "c": 2}
    edges = spark.createDataFrame(
        [(0, "a", "b", 0.0, 0.0, 1.0, 1.0), (0, "a", "gone", 0.0, 0.0, 1.0, 1.0)], schemas.CONSTELLATIONS
    )
    assert [tuple(r)[:3] for r in outputs.constellations_output(edges, numbered).collect()] == [(0, 1, 0)]
    named = spark.createDataFrame([(0, "zero"), (7, "seven")], schemas.CLUSTER_LABELS)
    out = {r["clusterId"]: (r["label"], r["downloads"]) for r in outputs.clusters_output(named, mapstats.cluster_metadata(df)).collect()}
    assert out == {0: ("zero", 14), 7: ("seven", None), 1: (None, 0)}


def test_files(spark):
    folder = Workspace(spark).folder
    rows = [("a", 'x\n"y", z', None, "s", "1", "5"), ("b", None, "t", "s", "2", "6")]
    raw = spark.createDataFrame(rows, schemas.RAW_DATASET)
    files.write_csv(raw, f"{folder}/csv")
    back = files.scan_csv(spark, f"{folder}/csv", schemas.RAW_DATASET)
    assert sorted(map(tuple, back.collect())) == rows
    assert files.scan_csv(spark, f"{folder}/csv", schemas.RAW_DATASET, ["name"]).columns == ["name"]
    files.write_csv(raw.limit(0), f"{folder}/csv", overwrite=False)
    assert files.scan_csv(spark, f"{folder}/csv", schemas.RAW_DATASET).count() == 2
    files.write_json(raw, f"{folder}/json")
    assert sorted(map(tuple, files.scan_json(spark, f"{folder}/json", schemas.RAW_DATASET).collect())) == rows
    files.write_parquet(raw, f"{folder}/parquet")
    files.write_parquet(raw.limit(1), f"{folder}/parquet")
    assert files.scan_parquet(spark, f"{folder}/parquet", ["name"]).count() == 1
