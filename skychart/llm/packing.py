"""Token sequences of fixed length, filled by first-fit decreasing in randomised groups."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychart.sources.workspace import Workspace

SEQUENCE = 2048
END_ID = 1
# Pieces that are packed together.
GROUP_PIECES = 8192
# Words whose ids a worker keeps, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 1_000_000, 64
# Bytes of ids in one batch of output.
BATCH_BYTES = 4 << 20

_PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"


# Letters, then ASCII punctuation without an apostrophe: the tokenizer always cuts between the two.
_LETTERS_AND_MARKS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


class WordTokens:
    """Ids of whole texts from the ids of their parts between spaces, which the tokenizer never joins."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {"": b""}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known = self._known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        missing = set().union(*split).difference(known)
        pairs = {}
        for w in missing:
            m = _LETTERS_AND_MARKS.fullmatch(w)
            if m and m[1].isalpha():
                # The tokenizer lowers all letters; here only ASCII, where both agree.
                pairs[w] = (m[1].lower() if m[1].isascii() else m[1], m[2])
        new = [w for w in {*(missing - pairs.keys()), *(x for p in pairs.values() for x in p)} if w not in known]
        found = self._tokenizer.encode_batch_fast(new, add_special_tokens=False)
        known.update(zip(new, [array("I", e.ids).tobytes() for e in found], strict=True))
        known.update({w: known[a] + known[b] for w, (a, b) in pairs.items()})
        ids = [b"".join([known[w] for w in parts]) for parts in split]
        # Long words, and all new ones once the table is full, are forgotten again.
        full = len(known) > KEPT_WORDS
        for w in missing.union(new):
            if full or len(w) > KEPT_LENGTH:
                known.pop(w, None)
        known[""] = b""
        return ids


@cache
def word_tokens(path: str) -> WordTokens:
    """One table for all tasks that a worker runs after each other."""
    return WordTokens(path)


def tokenized(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): every document's ids, cut after each ``sequence`` ids.

    A document's ids are those of its whole text (null: empty) and then ``end_id``, so an empty text has
    one id. ``ids`` are little-endian unsigned 32-bit numbers. ``tokenizer`` is the path of a file that
    every executor has.
    """
    step = 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
        )
        for batch in batches:
            # A few texts at a time, so that many long ones do not add up.
            keys, rows, size = batch.column(0).to_pylist(), [], 0
            for low in range(0, len(keys), 64):
                texts = [t or "" for t in batch.column(1).slice(low, 64).to_pylist()]
                for key, ids in zip(keys[low : low + 64], encode(texts), strict=True):
                    ids += end
                    for a in range(0, len(ids), step):
                        part = ids[a : a + step]
                        rows.append((key, a // 4, len(part) // 4, part, len(ids) // 4))
                        size += len(part)
                if size >= BATCH_BYTES or low + 64 >= len(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                        if rows
                        else [pa.array([], t) for t in schema.types],
                        schema=schema,
                    )
                    rows, size = [], 0

    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return source.mapInArrow(run, _PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items are taken as given, longest first.

    A tournament tree over the bins holds the largest free space below each node, so the first bin that
    has room is found by walking down from the root.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    free = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - free[node]
        free[node] -= length
        while node > 1:
            node //= 2
            left, right = free[2 * node], free[2 * node + 1]
            most = left if left >= right else right
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def packed(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with doc_id, start and length (1 to ``sequence``).

    Rows are dealt to random groups of about ``group_pieces`` rows, by a hash of their place in the written
    table, so that repeated rows spread as well as others; each group is packed on its own by first-fit
    decreasing. In a sequence the pieces follow each other without gaps from offset 0. Other columns are
    carried along (``sequence_id`` and ``offset`` are replaced). An empty table gives an empty result.
    """
    space = Workspace(pieces.sparkSession)
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = space.write(pieces.select(*columns), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def run(group: pa.Table) -> pa.Table:
        number = group.column("_group")[0].as_py()
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), sequence)
        # A group's bins are at most as many as its rows, far below 2^32.
        return (
            group.select(columns)
            .append_column("sequence_id", pa.array((number << 32) + bins))
            .append_column("offset", pa.array(offsets))
        )

    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def packed_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Where every piece of every document lies, with a checksum in place of its ids."""
    pieces = tokenized(docs, tokenizer)
    return packed(
        pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    )
