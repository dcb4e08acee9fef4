"""Runs of repeated words: stretches of a text that repeat with a period, found on suffix arrays.

A square is a stretch followed at once by itself; it branches where the word after it differs from the word
that a further copy would begin with. The two copies of a branching square are suffixes that part exactly at the depth of
their LCP interval, so they lie in different children of it. For every interval, each suffix i outside the
largest child looks up whether i + depth or i - depth lies in the interval too, but in another child: at most
n log n look-ups in the inverse suffix array. A branching square stands at the end of a run; rotating it to the left, as
long as the words agree, gives the whole run. Intervals are pairs of bounds in the arrays, no tree is built.

A text is the unit of work: it is read once, by the task that has it, and nothing is exchanged. Texts are handled in
slices of about a megabyte (or one longer text), some 150 bytes of memory per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skychart.llm.words import slices, split_words, text_bytes

# Words of the shortest run.
MIN_LENGTH = 12

RUNS = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("period", T.LongType(), False),
        ]
    ),
    False,
)
_ARROW_RUN = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.field("element", _ARROW_RUN, False))


class SuffixArray:
    """Suffixes of many word sequences that stand one after another, sorted by prefix doubling.

    ``codes`` number the words so that different sequences share none; ``stops`` holds, for each place, the end of its
    sequence. ``levels[l]`` ranks the places by their first 2^l words, so equal ranks mean equal words.
    """

    def __init__(self, codes: np.ndarray, stops: np.ndarray):
        n = len(codes)
        self.size = n
        order = np.argsort(codes, kind="stable")
        keys, rows = codes[order], np.arange(n)
        self.levels: list[np.ndarray] = []
        rank = np.full(n + 1, -1)
        at, h = order, 1
        while True:
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = keys[1:] != keys[:-1]
            rank = rank.copy()
            rank[at] = np.maximum.accumulate(np.where(fresh, rows, 0))
            self.levels.append(rank)
            # Only suffixes that still tie are sorted further.
            tied = ~fresh
            tied[:-1] |= tied[1:]
            rows = rows[tied]
            if not len(rows):
                break
            at = order[rows]
            following = at + h
            second = np.where(following < stops[at], rank[np.minimum(following, n)], -1)
            keys = rank[at] * (n + 1) + second + 1
            again = np.argsort(keys, kind="stable")
            keys, at = keys[again], at[again]
            order[rows] = at
            h *= 2
        self.order = order
        self.inverse = self.levels[-1][:n]

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[level]
            step = (rank[i] == rank[j]).astype(np.int64) << level
            i, j, total = i + step, j + step, total + step
        return total

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[level], 1 << level
            back_i, back_j = np.maximum(i - step, 0), np.maximum(j - step, 0)
            same = (np.minimum(i, j) >= step) & (rank[back_i] == rank[back_j])
            move = same.astype(np.int64) << level
            i, j, total = i - move, j - move, total + move
        return total


def _least_depth(min_length: int) -> int:
    """A run of ``min_length`` words or more, of any period, has a branching square of at least this half.

    The half may be any multiple of the period up to half the run.
    """
    half = min_length // 2
    return min(q * (half // q) for q in range(1, half + 1))


def _intervals(rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the LCP interval of each row: the nearest rows before and after with a lower LCP."""
    n = len(rows)
    left, right = [0] * n, [0] * n
    stack: list[int] = []
    row_list, depth_list = rows.tolist(), depths.tolist()
    previous = -2
    for k in range(n):
        row, depth = row_list[k], depth_list[k]
        if row != previous + 1:
            for s in stack:
                right[s] = previous + 1
            stack = []
            base = row - 1
        while stack and depth_list[stack[-1]] > depth:
            right[stack.pop()] = row
        if not stack:
            left[k] = base
        elif depth_list[stack[-1]] == depth:
            left[k] = left[stack[-1]]
        else:
            left[k] = row_list[stack[-1]]
        stack.append(k)
        previous = row
    for s in stack:
        right[s] = previous + 1
    return np.array(left, np.int64), np.array(right, np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def branching_squares(suffixes: SuffixArray, starts: np.ndarray, stops: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of every branching square whose half is at least ``depth`` words long."""
    order, inverse = suffixes.order, suffixes.inverse
    level = min(depth.bit_length() - 1, len(suffixes.levels) - 1)
    ranked = suffixes.levels[level][order]
    rows = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    lcp = suffixes.common_after(order[rows - 1], order[rows])
    rows, lcp = rows[lcp >= depth], lcp[lcp >= depth]
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = _intervals(rows, lcp)

    # The rows of one interval cut it into its children.
    by = np.lexsort((rows, lcp, left))
    rows, lcp, left, right = rows[by], lcp[by], left[by], right[by]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (left[1:] != left[:-1]) | (lcp[1:] != lcp[:-1])
    heads = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    low = np.zeros(len(rows) + len(heads), np.int64)
    low[np.arange(len(rows)) + group + 1] = rows
    head_places = heads + np.arange(len(heads))
    low[head_places] = left[heads]
    high = np.concatenate([low[1:], [0]])
    high[np.concatenate([head_places[1:], [len(low)]]) - 1] = right[heads]
    owner = np.zeros(len(low), np.int64)
    owner[head_places[1:]] = 1
    owner = np.cumsum(owner)
    sizes = high - low
    largest = np.maximum.reduceat(sizes, head_places)[owner] == sizes
    # The first of the largest children is passed over.
    seen = np.cumsum(largest)
    passed = largest & (seen == (seen[head_places] - largest[head_places])[owner] + 1)
    small = np.flatnonzero(~passed)

    row = _spread(low[small], sizes[small])
    child = np.repeat(small, sizes[small])
    of = heads[owner[child]]
    half, i = lcp[of], order[row]
    found_at, found_half = [], []
    for step in (half, -half):
        j = i + step
        inside = (j < stops[i]) & (j >= starts[i])
        place = inverse[np.where(inside, j, 0)]
        other = inside & (place >= left[of]) & (place < right[of]) & ((place < low[child]) | (place >= high[child]))
        found_at.append(np.minimum(i, j)[other])
        found_half.append(half[other])
    return np.concatenate(found_at), np.concatenate(found_half)


def find_runs(codes: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all sequences, by start, then period; starts count over all sequences.

    ``codes`` are the words of the sequences, one after another; equal codes are equal words.
    """
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts, stops = (ends - counts)[owner], ends[owner]
    nothing = np.zeros(0, np.int64)
    if not len(codes):
        return nothing, nothing, nothing
    suffixes = SuffixArray(owner * (int(codes.max()) + 1) + codes, stops)
    depth = _least_depth(min_length)
    at, half = branching_squares(suffixes, starts, stops, depth)
    begin = at - suffixes.common_before(at, at + half)
    end = at + 2 * half
    long_enough = end - begin >= min_length
    begin, end, half = begin[long_enough], end[long_enough], half[long_enough]
    # A run is also found by multiples of its period: the least one counts.
    by = np.lexsort((half, end, begin))
    begin, end, half = begin[by], end[by], half[by]
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[new], end[new], half[new]
    # Periods below the least depth show only in their multiples.
    for shorter in range(depth - 1, 0, -1):
        holds = suffixes.common_after(begin, begin + shorter) >= end - begin - shorter
        period = np.where(holds, shorter, period)
    return begin, end - begin, period


def _analysed(column: pa.Array, min_length: int) -> tuple[pa.Array, pa.Array]:
    words, counts = split_words(column)
    codes = words.indices.to_numpy().astype(np.int64)
    begin, length, period = find_runs(codes, counts, min_length)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(counts)])
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    text = words.filter(pa.array(kept)).dictionary_decode().cast(pa.string())
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), text), " ")
    cuts = np.searchsorted(begin, bounds)
    owner = np.searchsorted(bounds, begin, side="right") - 1
    found = pa.StructArray.from_arrays(
        [pa.array(begin - bounds[owner]), pa.array(length), pa.array(period)], fields=list(_ARROW_RUN)
    )
    offsets = pa.array(cuts.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, found).cast(_ARROW_RUNS), collapsed


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Add ``runs`` and ``collapsed`` to every row.

    ``runs`` lists (start, length, period), counted in words from 0: each stretch of at least ``min_length`` words and of twice
    its smallest period that no neighbouring word extends with that period, by start, then period. ``collapsed`` holds the
    words that no run has after its first period, joined by blanks. Words are what stands between ASCII white
    space, case counts.

    A null or empty text has no runs and an empty ``collapsed``; a text without runs keeps all its words. Repeated rows are
    answered each; a null in any other column does not matter. Other columns are carried along, those
    named ``runs`` or ``collapsed`` are replaced. An empty table gives an empty result.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    carried = docs.drop("runs", "collapsed")
    place = carried.columns.index(text)
    schema = T.StructType([*carried.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place).cast(pa.string())
            _, offsets = text_bytes(column)
            for low, high in slices(offsets):
                part = batch.slice(low, high - low)
                found, collapsed = _analysed(column.slice(low, high - low), min_length)
                yield pa.RecordBatch.from_arrays([*part.columns, found, collapsed], names=names)

    return carried.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """One row per row of ``periodic_runs``: its runs and text as hashes, and its longest run (the first of equal ones)."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    picked = found.withColumn("_longest", longest)
    period = -F.col("_longest.short")
    return picked.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_longest.back")).alias("start"),
        F.col("_longest.length").alias("length"),
        period.alias("period"),
        F.floor(1000 * F.col("_longest.length") / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
