"""Fuzzy search: a batch of query strings against names and summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skychart.operators.spread import spread
from skychart.sources.workspace import Workspace

# Share of the query that may differ, and results shown.
THRESHOLD = 0.2
LIMIT = 25
# Characters of the patterns that one automaton holds; its nodes take some hundred bytes each.
SET_CHARACTERS = 1 << 20
# Places that wait to be compared, and rows searched at a time.
WAITING, ROWS_AT_ONCE = 1 << 15, 1024
# No character.
_NOTHING = 0xFFFFFFFF
_ARROW = {"int": pa.int32(), "bigint": pa.int64()}


def _patterns(queries: DataFrame, threshold: float) -> DataFrame:
    """Lower-cased patterns with the errors allowed and the pieces of which one must occur.

    With k errors spread over k + 1 pieces, some piece is untouched: a text without any piece
    cannot match.
    """
    size = F.length("pattern")
    count = F.col("errors") + 1
    pieces = F.transform(
        F.sequence(F.lit(0), F.col("errors")),
        lambda i: F.substring(
            F.col("pattern"),
            F.floor(i * size / count).cast("int") + 1,
            (F.floor((i + 1) * size / count) - F.floor(i * size / count)).cast("int"),
        ),
    )
    return (
        queries.where(F.length("query") > 1)
        .withColumn("pattern", F.lower("query"))
        .withColumn("errors", F.floor(size * F.lit(threshold) + 1e-9).cast("int"))
        .withColumn("pieces", pieces)
        .select("query_id", "pattern", "errors", "pieces")
    )


class PieceIndex:
    """One automaton over the pieces of a bounded set of patterns, and the check of the places it finds."""

    def __init__(self, patterns: list[tuple[int, str, int, list[str]]]):
        self.query_ids = np.array([p[0] for p in patterns], np.int64)
        self.codes = [_codes(p[1]) for p in patterns]
        self.sizes = np.array([len(c) for c in self.codes], np.int64)
        self.errors = np.array([p[2] for p in patterns], np.int64)
        self.automaton = ahocorasick.Automaton()
        wanted: dict[str, list[tuple[int, int]]] = {}
        for number, (_, pattern, errors, pieces) in enumerate(patterns):
            for i, piece in enumerate(pieces):
                # Where the piece ends, counted from the pattern's first character.
                end = i * len(pattern) // (errors + 1) + len(piece)
                wanted.setdefault(piece, []).append((number, end))
        for piece, places in wanted.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def hits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, query id) of the rows of which some text holds a pattern, each pair once."""
        done: set[tuple[int, int]] = set()
        waiting: list[tuple[int, int, np.ndarray, int]] = []
        for row, some in enumerate(texts):
            for text in some:
                codes = _codes(text)
                seen: set[tuple[int, int]] = set()
                for last, places in self.automaton.iter(text):
                    for number, end in places:
                        if (row, number) in done:
                            continue
                        if not self.errors[number]:
                            done.add((row, number))
                            continue
                        at = last + 1 - end
                        if (number, at) not in seen:
                            seen.add((number, at))
                            waiting.append((row, number, codes, at))
                    if len(waiting) >= WAITING:
                        self._settle(waiting, done)
                        waiting = []
        self._settle(waiting, done)
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, numbers = (np.array(x, np.int64) for x in zip(*sorted(done), strict=True))
        return rows, self.query_ids[numbers]

    def _settle(self, waiting: list[tuple[int, int, np.ndarray, int]], done: set[tuple[int, int]]) -> None:
        """Compare the surroundings of all waiting places with their patterns, those of equal size at once."""
        shapes: dict[tuple[int, int], list[int]] = {}
        for i, (row, number, _, _) in enumerate(waiting):
            if (row, number) not in done:
                shapes.setdefault((int(self.sizes[number]), int(self.errors[number])), []).append(i)
        for (size, errors), members in shapes.items():
            width = size + 2 * errors
            windows = np.full((len(members), width), _NOTHING, np.uint32)
            patterns = np.empty((len(members), size), np.uint32)
            for k, i in enumerate(members):
                _, number, codes, at = waiting[i]
                begin, stop = max(at - errors, 0), min(at + size + errors, len(codes))
                windows[k, : stop - begin] = codes[begin:stop]
                patterns[k] = self.codes[number]
            for k in np.flatnonzero(_least_edits(windows, patterns) <= errors).tolist():
                done.add(waiting[members[k]][:2])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _least_edits(windows: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Per row, the fewest edits between the pattern and any part of the window."""
    size = patterns.shape[1]
    column = np.repeat(np.arange(size + 1, dtype=np.int16)[:, None], len(windows), axis=1)
    least = column[size].copy()
    for j in range(windows.shape[1]):
        same = patterns.T == windows[:, j]
        # A match may begin anywhere, so no characters cost nothing.
        diagonal = column[0].copy()
        column[0] = 0
        for i in range(1, size + 1):
            above = column[i].copy()
            column[i] = np.minimum(np.minimum(above, column[i - 1]) + 1, diagonal + ~same[i - 1])
            diagonal = above
        np.minimum(least, column[size], out=least)
    return least


def fuzzy_hits(
    points: DataFrame,
    queries: DataFrame,
    keys: Sequence[str] = ("name", "summary"),
    threshold: float = THRESHOLD,
    set_characters: int = SET_CHARACTERS,
) -> DataFrame:
    """(query_id, id) of every point with a key that matches the whole query, each pair once.

    A text that matches holds some piece of the pattern unchanged. The pieces of all patterns of a set form one automaton,
    which reads each text once, whatever the number of patterns, and only the surroundings of the places it names are compared. A
    set is handed to every task and so bounded: beyond ``set_characters`` characters of patterns there are more sets, dealt
    by hash, and one reading of the texts for each.
    """
    patterns = Workspace(points.sparkSession).write(_patterns(queries, threshold).distinct(), "patterns")
    n_sets = max(1, -(-(patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0) // set_characters))
    number = F.pmod(F.xxhash64("query_id", "pattern"), F.lit(n_sets))
    texts = [F.lower(F.coalesce(F.col(k), F.lit(""))).alias(f"_t_{k}") for k in keys]
    lowered = spread(points).select("id", *texts)
    hits = [_hits_of_set(lowered, patterns.where(number == i)) for i in range(n_sets)]
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return found.distinct()


def _hits_of_set(lowered: DataFrame, patterns: DataFrame) -> DataFrame:
    rows = patterns.select("query_id", "pattern", "errors", "pieces").orderBy("query_id", "pattern").collect()
    shared = lowered.sparkSession.sparkContext.broadcast([(r[0], r[1], r[2], list(r[3])) for r in rows])
    kind = patterns.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PieceIndex(shared.value) if shared.value else None
        for batch in batches:
            if index is None:
                continue
            columns = [batch.column(k) for k in range(1, batch.num_columns)]
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                texts = list(zip(*[c.slice(low, ROWS_AT_ONCE).to_pylist() for c in columns], strict=True))
                at, query_ids = index.hits(texts)
                ids = batch.column(0).take(pa.array(at + low))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids).cast(_ARROW[kind]), ids], names=["query_id", "id"])

    return lowered.mapInArrow(run, f"query_id {kind}, id {lowered.schema['id'].dataType.simpleString()}")


def fuzzy_search(
    points: DataFrame,
    queries: DataFrame,
    keys: Sequence[str] = ("name", "summary"),
    threshold: float = THRESHOLD,
    limit: int = LIMIT,
) -> DataFrame:
    """Per query, the most used hits up to the limit."""
    hits = fuzzy_hits(points, queries, keys, threshold).join(
        points.select("id", "name", "weekly_downloads"), "id"
    )
    most_used = Window.partitionBy("query_id").orderBy(F.col("weekly_downloads").desc_nulls_last(), "id")
    return (
        hits.withColumn("result_rank", F.row_number().over(most_used))
        .where(F.col("result_rank") <= limit)
        .select("query_id", "result_rank", "id", "name", "weekly_downloads")
    )
