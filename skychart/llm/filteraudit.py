"""How document filters interact: what each removes in every order, from a sparse document-term matrix.

The matrix is built in three steps. Tasks cut their documents into shards of bounded size and code the words of each shard with
the shard's own vocabulary. The vocabularies of all shards together give the dictionary: every distinct word has one number, its
rank among the words of its hash bucket, times the number of buckets, plus the bucket. Then each shard's codes are
replaced by the dictionary's, which gives CSR shards: for each document the ascending numbers of its words and
their counts (``data``), between two entries of ``indptr``. The numbers are kept as ``gaps``, the first of a row as it is and
then differences, which take a quarter of the space; ``column_indices`` adds them up.

So only vocabularies are exchanged, and only once: a word comes once per shard, however often it occurs, and the most
frequent one has as many rows as there are shards. Ranks are counted while the sorted words stream by, so no bucket
is held as a whole. The row sums of the matrix are word counts, its nonzero entries per
row distinct words.

Filters are conditions per document, kept as bits. The order of filters does not change what a document fails, so
documents are first counted by their bits; all orders are answered from at most 128 counts per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.llm.words import slices, split_words, text_bytes
from skychart.sources.workspace import Workspace

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 50, 65, 5
SYMBOLS = "#$%&*|"
# Bytes of text in a shard, or one longer text.
SHARD_BYTES = 1 << 24
# Bytes split into words at a time.
SPLIT_BYTES = 1 << 22
# Hash buckets of the dictionary.
BUCKETS = 1 << 16

# Kinds of bytes: a code point has one byte that does not continue another.
_CAPITAL, _SYMBOL, _CONTINUES = 1, 2, 3
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[ord("A") : ord("Z") + 1] = _CAPITAL
_KINDS[list(SYMBOLS.encode())] = _SYMBOL
_KINDS[0x80:0xC0] = _CONTINUES

_ROW = "struct<doc_id: bigint, part: string, text_key: binary, flags: int>"
_SHARD = f"shard bigint, rows array<{_ROW}>, indptr array<int>, gaps array<int>, data array<int>"
_ROW_NAMES = ("doc_id", "part", "text_key", "flags")


def _flags(column: pa.Array) -> np.ndarray:
    """Bits of C (share of capitals) and D (symbols) per row."""
    values, offsets = text_bytes(column)
    kinds, offsets = _KINDS[values[offsets[0] : offsets[-1]]], offsets - offsets[0]

    def per_row(kind: int) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(kinds == kind), offsets))

    points = np.diff(offsets) - per_row(_CONTINUES)
    return (100 * per_row(_CAPITAL) > MAX_UPPER_PERCENT * points) * _bit("C") + (per_row(_SYMBOL) > 0) * _bit("D")


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words of a shard, words per row, and the vocabulary they point into."""
    _, offsets = text_bytes(column)
    parts = [split_words(column.slice(low, high - low)) for low, high in slices(offsets, SPLIT_BYTES)]
    words = pa.chunked_array([w for w, _ in parts]).unify_dictionaries()
    codes = np.concatenate([chunk.indices.to_numpy() for chunk in words.chunks])
    return codes, np.concatenate([n for _, n in parts]), words.chunk(0).dictionary


def _compressed(codes: np.ndarray, counts: np.ndarray, n_codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """indptr, indices and data of rows of ``counts`` codes each."""
    cells = np.repeat(np.arange(len(counts), dtype=np.int64) * max(n_codes, 1), counts)
    cells += codes
    cells.sort()
    new = np.ones(len(cells), dtype=bool)
    new[1:] = cells[1:] != cells[:-1]
    first = np.flatnonzero(new)
    cells = cells[first]
    rows = cells // max(n_codes, 1)
    data = np.diff(np.append(first, len(codes)))
    return np.searchsorted(rows, np.arange(len(counts) + 1)), cells - rows * max(n_codes, 1), data


def _gaps(indptr: np.ndarray, indices: np.ndarray) -> np.ndarray:
    """Differences of ascending indices; the first of every row as it is."""
    gaps = np.diff(indices, prepend=0)
    first = indptr[:-1][np.diff(indptr) > 0]
    gaps[first] = indices[first]
    return gaps


def column_indices(indptr: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """The ascending word numbers of all rows of a shard."""
    total = np.cumsum(gaps, dtype=np.int64)
    sizes = np.diff(indptr)
    first = indptr[:-1][sizes > 0]
    return total - np.repeat(total[first] - gaps[first], sizes[sizes > 0])


def local_shards(docs: DataFrame) -> DataFrame:
    """Shards of (doc_id, part, text, text_key) rows, coded by their own vocabulary in ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_bytes(batch.column(2))
            for low, high in slices(offsets, SHARD_BYTES):
                part = batch.slice(low, high - low)
                codes, counts, words = _coded(part.column(2))
                indptr, indices, data = _compressed(codes, counts, len(words))
                rows = pa.StructArray.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(_flags(part.column(2)).astype(np.int32))],
                    names=list(_ROW_NAMES),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                        *[
                            pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
                            for x in (indptr, _gaps(indptr, indices), data)
                        ],
                        pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    ],
                    names=["shard", "rows", "indptr", "gaps", "data", "words"],
                )
                shard += 1

    return docs.mapInArrow(run, f"{_SHARD}, words array<string>")


def _term_id(bucket: str, word: str) -> Column:
    rank = F.dense_rank().over(Window.partitionBy(bucket).orderBy(word))
    return ((rank - 1).cast("bigint") * BUCKETS + F.col(bucket)).alias("term_id")


def _bucket() -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).alias("_bucket")


def dictionary(shards: DataFrame) -> DataFrame:
    """(word, term_id, n_shards): the number of every distinct word, as in ``csr_shards``."""
    words = shards.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_shards"))
    return words.select("word", "n_shards", _bucket()).select("word", _term_id("_bucket", "word"), "n_shards")


def csr_shards(shards: DataFrame) -> DataFrame:
    """(shard, rows, indptr, gaps, data): the shards coded by the dictionary."""
    own = shards.select("shard", F.posexplode("words").alias("_place", "word"))
    codes = (
        own.select("shard", "_place", "word", _bucket())
        .select("shard", "_place", _term_id("_bucket", "word"))
        .groupBy("shard")
        .agg(F.collect_list(F.struct("_place", "term_id")).alias("_codes"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                indptr, gaps, data = (one.column(k).flatten().to_numpy() for k in (2, 3, 4))
                place, term = (x.to_numpy() for x in one.column(5).flatten().flatten())
                codes = np.zeros(len(place), np.int64)
                codes[place] = term
                indices = codes[column_indices(indptr, gaps)]
                owner = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
                order = np.lexsort((indices, owner))
                yield pa.RecordBatch.from_arrays(
                    [
                        *one.columns[:3],
                        pa.array([_gaps(indptr, indices[order])], pa.list_(pa.int64())),
                        pa.array([data[order]], pa.list_(pa.int32())),
                    ],
                    names=["shard", "rows", "indptr", "gaps", "data"],
                )

    # A shard whose texts have no words has no codes.
    coded = shards.drop("words").join(codes, "shard", "left")
    return coded.mapInArrow(run, _SHARD.replace("gaps array<int>", "gaps array<bigint>"))


def row_flags(matrix: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, flags, n_words, n_distinct) of every row; A and B from row sums and nonzero entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column(0).slice(i, 1).flatten()
                indptr, data = (batch.column(k).slice(i, 1).flatten().to_numpy() for k in (1, 2))
                total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
                n_words, n_distinct = np.diff(total[indptr]), np.diff(indptr).astype(np.int64)
                doc_id, part, text_key, flags = rows.flatten()
                few = (n_words < MIN_WORDS) * _bit("A")
                dull = (100 * n_distinct < MIN_DISTINCT_PERCENT * n_words) * _bit("B")
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_id, part, text_key,
                        pa.array((flags.to_numpy() + few + dull).astype(np.int32)),
                        pa.array(n_words), pa.array(n_distinct),
                    ],
                    names=[*_ROW_NAMES, "n_words", "n_distinct"],
                )

    return matrix.select("rows", "indptr", "data").mapInArrow(
        run, "doc_id bigint, part string, text_key binary, flags int, n_words bigint, n_distinct bigint"
    )


def document_flags(docs: DataFrame) -> DataFrame:
    """``row_flags`` of all rows of (doc_id, text, source), by way of the written matrix.

    A null text counts as empty: no words, no characters, so only A (and perhaps E) holds. A null source is the part ''.
    """
    space = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("text_key"),
    )
    # A row is a whole shard: Spark's reader unpacks up to 4,096 rows of a row group at a time.
    local = space.write(local_shards(rows), "local", codec="zstd", group_rows=1)
    return row_flags(space.write(csr_shards(local), "matrix", codec="zstd", group_rows=1))


def counted_flags(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, flags, good, toxic, n): rows by their failed filters, E among them.

    E holds where a smaller doc_id has the same text; rows with the smallest id of a text, repeated or not, and rows
    without id never fail it, and rows without id make no other fail it. ``good`` and ``toxic`` tell whether any label of
    the id says so; null ids have no labels.
    """
    # Equal rows are one from here on. Rows without id are spread by their texts.
    once = flags.groupBy("doc_id", "part", "text_key", "flags").agg(F.count("*").alias("n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.hex("text_key")))
    said = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").cast("string").alias("_key"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
    )
    labelled = once.withColumn("_key", key).join(said, "_key", "left").fillna(False, ["good", "toxic"])

    # Copies of a text agree in all filters but E: a few rows stand for thousands of copies.
    copies = labelled.groupBy("text_key", "part", "flags", "good", "toxic").agg(
        F.min("doc_id").alias("_first"),
        F.min_by("n", "doc_id").alias("_n_first"),
        F.sum("n").alias("_n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("_n_nameless"),
    )
    least = F.min("_first").over(Window.partitionBy("text_key"))
    first = F.when(F.col("_first") == F.col("_least"), F.col("_n_first")).otherwise(0)
    original = F.coalesce(first, F.lit(0)) + F.col("_n_nameless")
    both = F.array(
        F.struct(F.col("flags").alias("flags"), original.alias("n")),
        F.struct((F.col("flags") + _bit("E")).alias("flags"), (F.col("_n") - original).alias("n")),
    )
    return (
        copies.withColumn("_least", least)
        .select("part", "good", "toxic", F.explode(both).alias("_x"))
        .select("part", "good", "toxic", "_x.flags", "_x.n")
        .groupBy("part", "flags", "good", "toxic")
        .agg(F.sum("n").alias("n"))
    )


def every_order(counts: DataFrame) -> DataFrame:
    """For each part, each order of the filters and each step what its filter does, from (part, flags, good, toxic, n)."""
    bits = [1 << i for i in range(len(FILTERS))]
    # A step depends only on its filter and on the set of filters before it.
    cases = [(f, s) for f in bits for s in range(1 << len(FILTERS)) if not s & f]
    case = F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(s).alias("earlier")) for f, s in cases]))
    fails = F.col("flags").bitwiseAND(F.col("filter")) != 0
    gone = F.col("flags").bitwiseAND(F.col("earlier")) != 0
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).cast("bigint")

    orders_in_all = len(list(permutations(FILTERS)))
    # Of all orders a document falls to this filter in an equal share for each filter it fails.
    share = F.lit(orders_in_all) / F.bit_count("flags")
    per_case = (
        counts.withColumn("_case", case)
        .select("*", "_case.filter", "_case.earlier")
        .groupBy("part", "filter", "earlier")
        .agg(
            total(~fails & ~gone).alias("kept"),
            total(fails & ~gone).alias("removed"),
            total(fails & gone).alias("redundant"),
            total(F.col("flags") == F.col("filter")).alias("unique_fails"),
            total(fails & ~gone & F.col("good")).alias("good_lost"),
            total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
            F.sum(F.when(fails, n * share.cast("bigint")).otherwise(0)).cast("bigint").alias("shapley"),
        )
    )
    steps = [
        ("".join(order), k + 1, _bit(order[k]), sum(_bit(x) for x in order[:k]))
        for order in permutations(FILTERS)
        for k in range(len(FILTERS))
    ]
    # A fixed table of orders, far below any limit.
    orders = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, filter int, earlier int")
    return per_case.join(F.broadcast(orders), ["filter", "earlier"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What filters A to E remove from ``docs`` (doc_id, text, source), per part, order and step.

    A: under 50 words; B: fewer than 65 % of the words distinct; C: more than 5 % of the code points A to Z; D: one of
    ``#$%&*|``; E: the text of a smaller doc_id. Words are what stands between ASCII white space, case counts.

    Nulls: see ``document_flags`` and ``counted_flags``; null labels say nothing. Repeated rows count each, of a repeated
    id in ``labels`` any row may say so. Other columns are not read. An empty ``docs`` gives no rows.
    """
    return every_order(counted_flags(document_flags(docs), labels))
