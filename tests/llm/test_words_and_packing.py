"""Word hashes, token packing and shards against plain versions."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skychart.llm import packing, sharding, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, size int, _part string, sequence_id string, offset string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in texts], SCHEMA)


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", lowered)


def test_words_equal_a_plain_split(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 64)
    rng = random.Random(1)
    texts = [None, "", " \n", "A a\tA\x0bé É", "x" * 500, "x" * 500 + " y"]
    texts += ["".join(rng.choice("abC é\n ") for _ in range(rng.randrange(300))) for _ in range(60)]
    column = pa.array(["skipped", *texts])[1:]
    hasher = words.WordHasher()
    values, offsets = words.text_bytes(column)
    plain = [split(t) for t in texts]
    hashes, _, counts = hasher(values, offsets)
    assert counts.tolist() == [len(p) for p in plain]
    by_word = dict(zip((w for p in plain for w in p), hashes.tolist(), strict=True))
    assert [by_word[w] for p in plain for w in p] == hashes.tolist()
    assert len(set(by_word.values())) == len(by_word)

    found, sizes = words.runs(hashes, counts, 3)
    expected = [[tuple(p[i : i + 3]) for i in range(max(1, len(p) - 2))] if p else [] for p in plain]
    assert sizes.tolist() == [len(e) for e in expected]
    by_run = dict(zip((r for e in expected for r in e), found.tolist(), strict=True))
    assert [by_run[r] for e in expected for r in e] == found.tolist()
    assert len(set(by_run.values())) == len(by_run)

    keys = list(zip(*[k.tolist() for k in words.sequence_keys(hashes, counts)], strict=True))
    assert all((keys[i] == keys[j]) == (plain[i] == plain[j]) for i in range(len(keys)) for j in range(i))


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 101, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    used = []
    for length, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        place = next((i for i, u in enumerate(used) if u + length <= 100), len(used))
        if place == len(used):
            used.append(0)
        assert (b, o) == (place, used[place])
        used[place] += length


def test_packing_keeps_every_id(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "A<|endoftext|>b don't", "é " * 5000, "x" * 3000]
    texts += [" ".join(rng.choice(["alpha", "Beta", "12", " ", "\x1c!", "ça"]) for _ in range(rng.randrange(900))) for _ in range(40)]
    docs = frame(spark, list(enumerate(texts)) + [(6, texts[6]), (None, "no id")])
    pieces = packing.tokenized(docs, TOKENIZER).withColumn("group", F.lit(1)).withColumn("offset", F.lit("old"))
    got = packing.packed(pieces, group_pieces=10).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    sequences = {}
    seen = {}
    for r in got:
        text = "no id" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes()
        assert r["doc_tokens"] == len(ids) and r["length"] > 0
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"] / len(ids)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: round(v, 6) for k, v in seen.items()} == {**dict.fromkeys(range(46), 1.0), 6: 2.0, None: 1.0}
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    digest = packing.packed_digest(docs.limit(0), TOKENIZER)
    assert digest.count() == 0


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_equal_a_plain_prefix_sum(spark, shards):
    rng = random.Random(4)
    texts = [(i, "é" * rng.randrange(200)) for i in range(90)] + [(None, "null id"), (7, None), (7, None), (91, "x" * 5000)]
    docs = frame(spark, texts).repartition(4)
    got = sharding.contiguous_shards(sharding.sized(docs), shards).collect()
    rows = sorted(
        ((-1 if i is None else i), zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t in texts
    )
    total, before, slots, expected = sum(r[2] for r in rows), 0, {}, []
    for key, crc, size in rows:
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        expected.append((key, crc, size, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got) == expected
    assert sharding.contiguous_shards(sharding.sized(docs.limit(0)), shards).count() == 0
