"""Fuzzy search against brute force over all substrings."""

import random

import pytest

from skychart.operators import search

POINT = "id bigint, name string, summary string, weekly_downloads bigint"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def matches(text, query):
    query, text = query.lower(), (text or "").lower()
    if len(query) < 2:
        return False
    n = len(query)
    k = int(0.2 * n + 1e-9)
    return any(
        distance(text[i : i + m], query) <= k for i in range(len(text) + 1) for m in range(n - k, n + k + 1)
    )


def hits(spark, rows, queries, **options):
    points = spark.createDataFrame(rows, POINT)
    return {tuple(r) for r in search.fuzzy_hits(points, spark.createDataFrame(queries, "query_id int, query string"), **options).collect()}


@pytest.mark.parametrize(("seed", "characters", "waiting"), [(1, 1 << 20, 1 << 15), (2, 60, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, characters, waiting):
    monkeypatch.setattr(search, "WAITING", waiting)
    random.seed(seed)

    def word(n):
        return "".join(random.choice("abé") for _ in range(n))

    rows = [(i, word(random.randrange(12)), None if i % 9 == 0 else word(random.randrange(90)), i) for i in range(40)]
    queries = [(i, word(n)) for i, n in enumerate([1, 2, 4, 5, 7, 9, 10, 12, 15, 16, 33, 40])]
    want = {(q, r[0]) for q, text in queries for r in rows if matches(r[1], text) or matches(r[2], text)}
    assert hits(spark, rows, queries, set_characters=characters) == want


def test_many_queries_against_brute_force(spark):
    random.seed(3)
    words = ["".join(random.choice("abcdé") for _ in range(random.randrange(3, 9))) for _ in range(40)]
    rows = [(i, random.choice(words), " ".join(random.choices(words, k=6)), i) for i in range(25)]
    queries = [(i, " ".join(random.choices(words, k=random.randrange(1, 3)))) for i in range(150)]
    queries += [(3, queries[3][1]), (3, "other")]
    want = {(q, r[0]) for q, text in queries for r in rows if matches(r[1], text) or matches(r[2], text)}
    assert hits(spark, rows, queries) == want
    assert hits(spark, rows, queries[:0]) == set() and hits(spark, rows[:0] + [(1, None, None, 1)], queries) == set()


def test_regular_expression_characters_are_plain(spark):
    rows = [(1, "a\\Eb.*c(d", "", 1), (2, "axEbyyc(d", "", 1), (3, "", "x.*c(dd", 1)]
    queries = [(1, "\\Eb.*c(d"), (2, ".*c(d")]
    want = {(q, r[0]) for q, text in queries for r in rows if matches(r[1], text) or matches(r[2], text)}
    assert hits(spark, rows, queries) == want


def test_long_text_is_searched_to_its_end(spark):
    rows = [(1, "", "z" * 30_000 + " needel in", 1), (2, "", "z" * 30_000, 1)]
    assert hits(spark, rows, [(1, "needle in")]) == set()
    assert hits(spark, rows, [(1, "needel on")]) == {(1, 1)}


def test_results_are_the_most_used_hits(spark):
    rows = [(i, "Red BOLT", "", i % 40) for i in range(60)] + [(99, "other", "", 1000)]
    points = spark.createDataFrame(rows, POINT)
    queries = spark.createDataFrame([(1, "bolt"), (2, "b"), (3, "none")], "query_id int, query string")
    got = search.fuzzy_search(points, queries).orderBy("result_rank").collect()
    want = sorted(rows[:-1], key=lambda r: (-r[3], r[0]))[:25]
    assert [(r["query_id"], r["id"]) for r in got] == [(1, r[0]) for r in want]
