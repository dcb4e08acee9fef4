"""Benchmark passages in documents against a plain scan."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skychart.llm import contamination

SCHEMA = "doc_id bigint, text string, n_words string, items int, item_id string, hash string"


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain_scan(text, items, window=10):
    words, hit, names = plain_words(text), set(), set()
    for item, passage in items:
        own = plain_words(passage)
        n = min(window, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wanted:
                hit |= set(range(i, i + n))
                names.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(names)


def tables(spark, size=120):
    rng = random.Random(3)
    passage = lambda n, k: " ".join(rng.choice(["a", "b", "É", "d1", "zz"][:k]) for _ in range(n))
    items = [(i, passage(rng.choice([0, 1, 3, 9, 10, 11, 25]), 5)) for i in range(20)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(90, "zz-zz 9 q"), (90, "other words, than: BEFORE"), (None, "no id HERE")]
    items += [(91, None), (92, " ;; "), (93, items[-1][1])]
    texts = [None, "", "...", "No id; here", "no id", "x " * 12_000 + items[2][1] + " no id here"]
    for _ in range(size):
        parts = [passage(rng.randrange(30), 5)]
        if rng.random() < 0.6:
            parts += [rng.choice(items)[1] or "", passage(rng.randrange(5), 3)] * rng.randrange(1, 3)
        texts.append(rng.choice([" ", "\n", "; "]).join(parts).replace("a", rng.choice(["a", "A"])))
    rows = [(i if i % 9 else None, t, "clash", i, "x", None) for i, t in enumerate(texts)]
    rows += rows[10:13]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, rows, items, spark.createDataFrame(items, "item_id bigint, text string")


def check(found, rows, items):
    got = found.collect()
    assert len(got) == len(rows)
    expected = sorted((str(r[0]), r[1] or "", *map(str, plain_scan(r[1], items))) for r in rows)
    seen = []
    for r in got:
        hit = [i for s in r["spans"] for i in range(s["first"], s["first"] + s["words"])]
        seen.append((str(r["doc_id"]), r["text"] or "", str(r["n_words"]), str(hit), str(r["items"])))
        data = (r["text"] or "").encode()
        for s in r["spans"]:
            part = data[s["start_byte"] : s["start_byte"] + s["bytes"]].decode()
            assert plain_words(part) == plain_words(r["text"])[s["first"] : s["first"] + s["words"]]
            assert len(part) == len(part.strip(" \n;"))
    assert sorted(seen) == expected
    return got


def test_hits_equal_a_plain_scan(spark):
    docs, rows, items, benchmark = tables(spark)
    found = contamination.scanned(docs, benchmark)
    assert found.columns == ["doc_id", "text", "item_id", "hash", "n_words", "spans", "items"]
    got = check(found, rows, items)
    assert 20 < sum(bool(r["spans"]) for r in got) < len(got) - 20


def test_any_number_of_parts_gives_the_same(spark):
    docs, rows, items, benchmark = tables(spark, 40)
    check(contamination.scanned(docs, benchmark, part_rows=25), rows, items)


def test_hits_are_verified(monkeypatch):
    # With all hashes alike only the comparison of words is left.
    monkeypatch.setattr(contamination, "mix", lambda x: x * np.uint64(0))
    table = pa.table({"hash": [0, 0], "words": [b"a b", b"c d"], "length": [2, 2], "item": ["1", "2"]})
    known = contamination.WindowSet.of(table)
    assert known.alike == 2
    (_, _, counts, spans, items), = contamination._scan(pa.array(["x a b y c d", "b a"]), known, contamination.WordHasher())
    assert counts.to_pylist() == [6, 2]
    assert [[(s["first"], s["words"]) for s in row] for row in spans.to_pylist()] == [[(1, 2), (4, 2)], []]
    assert items.to_pylist() == [["1", "2"], []]


def test_spans_and_documents_are_removed(spark):
    benchmark = spark.createDataFrame([(1, "the quick fox"), (2, "é dog")], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(1, "A é; The QUICK fox! É dog ran."), (2, None), (3, "quick fox"), (4, "é dog")], "doc_id bigint, text string"
    )
    found = contamination.scanned(docs, benchmark)
    cut = {r["doc_id"]: r["text"] for r in contamination.without_spans(found).collect()}
    assert cut == {1: "A é;  ! É dog ran.", 2: None, 3: "quick fox", 4: " "}
    assert [r["doc_id"] for r in contamination.without_documents(found).orderBy("doc_id").collect()] == [2, 3]
    some = contamination.without_documents(found, 0.75).orderBy("doc_id")
    assert [r["doc_id"] for r in some.collect()] == [1, 2, 3] and some.columns == ["doc_id", "text"]


def test_empty_tables(spark):
    docs, rows, items, benchmark = tables(spark, 5)
    assert contamination.scanned(docs.limit(0), benchmark).count() == 0
    clean = contamination.scanned(docs, benchmark.limit(0))
    assert clean.where((F.size("spans") > 0) | (F.size("items") > 0)).count() == 0
    assert clean.count() == len(rows)
