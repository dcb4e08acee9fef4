"""Runs of repeated words against a direct reading of their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skychart.llm import periodic, queries
from skychart.llm.words import split_words

SCHEMA = "doc_id bigint, text string, runs int, _words string, lang string"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_runs(words, min_length=12):
    """All maximal stretches per period; of equal stretches the one with the smallest period stays."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i >= q and j + q - i >= min_length:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def sequences():
    rng = random.Random(5)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, list("ab") * 6, list("ab") * 40 + ["a"], list("abc") * 4]
    out += [list("abcd") * 3, list("abcde") * 2 + ["a", "b"], list("abcdef") * 2, list("abcdef") * 2 + ["a"]]
    for size in (1, 2, 2, 3, 5):
        out += [[rng.choice("abcdefgh"[:size]) for _ in range(rng.randrange(200))] for _ in range(40)]
    for _ in range(60):
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
        piece = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        body = piece + block * rng.randrange(2, 7) + block[: rng.randrange(len(block))] + piece[::-1]
        out.append(body * rng.randrange(1, 4))
    a, b = ["a"], ["a", "b"]  # Fibonacci words are rich in runs of all sizes.
    for _ in range(10):
        a, b = b, b + a
    return [*out, b]


@pytest.mark.parametrize("min_length", [2, 3, 5, 12, 13, 20])
def test_runs_equal_the_definition(min_length):
    rows = sequences()
    codes = np.array([ord(w) for row in rows for w in row], np.int64)
    counts = np.array([len(r) for r in rows])
    start, length, period = periodic.find_runs(codes, counts, min_length)
    found = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    first = np.cumsum(counts) - counts
    expected = [(int(f) + a, n, q) for f, row in zip(first, rows, strict=True) for a, n, q in plain_runs(row, min_length)]
    assert len(expected) > 100
    assert found == expected


def test_split_words_keeps_case_and_skips_empty_parts():
    texts = [None, "", " ", "A a", "\tx\x0by\x0cz \n", "é   q", "x\x1cy"]
    words, counts = split_words(pa.array(["skipped", *texts])[1:])
    assert counts.tolist() == [len(plain_words(t)) for t in texts]
    assert words.dictionary_decode().to_pylist() == [w for t in texts for w in plain_words(t)]


def test_rows_of_every_kind(spark):
    long = "w x y " * 40_000 + "end"
    texts = [None, "", " \n ", "one", "a b c " * 6, "a b c " * 6, long, "é " * 12 + "B b " * 6]
    rows = [(i if i != 5 else None, t, 7, "clash", None) for i, t in enumerate(texts)]
    rows.append(rows[4])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        words = plain_words(row["text"])
        expected = plain_runs(words) if len(words) < 1000 else [(0, 120_000, 3)]
        assert [tuple(r) for r in row["runs"]] == expected
        assert row["collapsed"] == (plain_collapsed(words, expected) if len(words) < 1000 else "w x y end")
        assert row["_words"] == "clash"
    empty = periodic.periodic_runs(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "_words", "lang", "runs", "collapsed"]


def test_query_equals_the_contract(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words = plain_words(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, row = plain_runs(words), got[doc_id]
        with_runs += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(runs), *best, milli)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert with_runs > 5
