"""The filter audit against a plain replay of every order."""

import glob
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq

from skychart.llm import filteraudit
from skychart.sources.workspace import Workspace

SCHEMA = "doc_id bigint, text string, source string, part int, words string, shard string, flags string"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text)


def plain_audit(rows, labels):
    rows = [(i, t or "", s or "") for i, t, s, *_ in rows]
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t] = min(i, smallest.get(t, i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = []
    for i, t, s in rows:
        w = plain_words(t)
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > smallest[t] else set()
        failed.append((s, fails, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {s for _, _, s in rows}:
            left = [f for f in failed if f[0] == part]
            every = left
            for k, name in enumerate(order):
                here = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                earlier = [f for f in every if name in f[1] and f[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = [
                    len(left), len(here), len(earlier), sum(f[1] == {name} for f in every),
                    sum(f[2] for f in here), sum(f[3] for f in here),
                ]
                shapley[part, name] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def fixture(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "A B", "é" * 30, "É x\x0by", "a # b", "w " * 30_000, "W " * 60 + "|"]
    for _ in range(60):
        n = rng.choice([10, 49, 50, 51, 90])
        vocabulary = [f"{rng.choice('abcDEF')}{k}" for k in range(rng.choice([5, 40, 60, 100]))]
        texts.append(" ".join(rng.choice(vocabulary) for _ in range(n)) + rng.choice(["", " $", " é", "%"]))
    texts += texts[9:40] + texts[20:30]
    rows = [(rng.choice([i, i, i, i - 3, None]), t, rng.choice(["a", "b", "", None]), 1, "x", "y", "z") for i, t in enumerate(texts)]
    rows += rows[30:50]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return rows, labels, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_audit_equals_a_plain_replay(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "SHARD_BYTES", 500)
    monkeypatch.setattr(filteraudit, "SPLIT_BYTES", 200)
    rows, labels, docs, label_table = fixture(spark)
    got = filteraudit.audit(docs, label_table).collect()
    assert len(got) == 3 * 120 * 5
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in got}
    assert found == plain_audit(rows, labels)


def test_matrix_holds_every_word_of_every_document(spark, monkeypatch):
    rows, _, docs, _ = fixture(spark)
    from pyspark.sql import functions as F

    monkeypatch.setattr(filteraudit, "BUCKETS", 7)
    monkeypatch.setattr(filteraudit, "SHARD_BYTES", 500)
    monkeypatch.setattr(filteraudit, "SPLIT_BYTES", 200)
    source = docs.select("doc_id", F.lit("p").alias("part"), "text", F.lit(b"k").alias("text_key"))
    local = filteraudit.local_shards(source)
    terms = filteraudit.dictionary(local)
    words = {r["term_id"]: r["word"] for r in terms.collect()}
    assert len(words) == terms.count()
    assert sorted(words.values()) == sorted({w for r in rows for w in plain_words(r[1] or "")})
    found = []
    for shard in filteraudit.csr_shards(local).collect():
        numbers = filteraudit.column_indices(np.array(shard["indptr"]), np.array(shard["gaps"], np.int64)).tolist()
        for k, row in enumerate(shard["rows"]):
            cells = slice(shard["indptr"][k], shard["indptr"][k + 1])
            assert numbers[cells] == sorted(set(numbers[cells]))
            counts = {words[i]: n for i, n in zip(numbers[cells], shard["data"][cells], strict=True)}
            found.append((str(row["doc_id"]), sorted(counts.items())))
    assert sorted(found) == sorted((str(r[0]), sorted(Counter(plain_words(r[1] or "")).items())) for r in rows)


def test_written_shards_are_read_one_by_one(spark, monkeypatch, tmp_path):
    """Many shards in one task's file: each has a row group of its own, so no reader unpacks several at once."""

    class Here(Workspace):
        def __init__(self, session):
            super().__init__(session)
            self.folder = f"{tmp_path}/space"

    monkeypatch.setattr(filteraudit, "Workspace", Here)
    monkeypatch.setattr(filteraudit, "SHARD_BYTES", 500)
    rows, _, docs, _ = fixture(spark)
    assert filteraudit.document_flags(docs.coalesce(1)).count() == len(rows)
    for name in ("local", "matrix"):
        files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/space/{name}-*/*.parquet")]
        assert sum(m.num_row_groups for m in files) == sum(m.num_rows for m in files) > 10 * len(files)


def test_empty_tables(spark):
    rows, labels, docs, label_table = fixture(spark)
    assert filteraudit.audit(docs.limit(0), label_table).count() == 0
    found = filteraudit.audit(docs, label_table.limit(0)).collect()
    expected = plain_audit(rows, [])
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found} == expected
    wordless = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    assert filteraudit.audit(wordless, label_table.limit(0)).count() == 600
