"""Benchmark passages in documents: windows of test words in a hash set, scanned for in every text, hits verified.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. A window is ``WINDOW``
consecutive words of an item, or all words of a shorter one. Every window of a text is hashed and looked up in
the set, first in a bit map, then exactly; a hit counts only after its words were compared with the item's. What a
document holds is the union of all windows found in it.

The hash set goes to every task, so its size is bounded: the distinct (window, item) pairs are counted, and beyond
``PART_ROWS`` of them (or ``PART_BYTES`` of window texts) they are dealt to as many parts as needed by hash. Each part is
a broadcast of its own and one pass over the documents, after which it is released; the hits of all passes are
joined by document. The answer is the same for any number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skychart.llm.words import WordHasher, mix, slices, text_bytes
from skychart.sources.workspace import Workspace

WINDOW = 10
# What one broadcast part holds at most, but for a single longer window: pairs of window and item, and bytes of windows.
PART_ROWS, PART_BYTES = 1 << 18, 1 << 25
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MAP_BITS = 22

# Bytes of words as they count, all others a blank.
_NORMAL = np.full(256, 0x20, dtype=np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _NORMAL[_low : _high + 1] = np.arange(_low, _high + 1)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)

SPANS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("first", "words", "start_byte", "bytes")]), False
)
_ARROW_SPAN = pa.struct([pa.field(n, pa.int64(), False) for n in ("first", "words", "start_byte", "bytes")])
_ARROW_SPANS = pa.list_(pa.field("element", _ARROW_SPAN, False))
_ARROW_ITEMS = pa.list_(pa.field("element", pa.string(), False))
_ADDED = ("n_words", "spans", "items")


def _split(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a few rows at a time: first row, end, their normal bytes, word hashes, where words start, words per row."""
    values, offsets = text_bytes(column)
    for low, high in slices(offsets):
        data = _NORMAL[values[offsets[low] : offsets[high]]]
        hashes, starts, counts = hasher(data, offsets[low : high + 1] - offsets[low])
        yield low, high, data, hashes, starts, counts


def _windows(hashes: np.ndarray, counts: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash of the words from each place on, whether they lie in one row) for lengths 1 to ``longest``."""
    ends = np.repeat(np.cumsum(counts), counts)
    place = np.arange(len(hashes))
    value = hashes.copy()
    for length in range(1, longest + 1):
        if length > 1:
            value[: len(value) - length + 1] = mix(value[: len(value) - length + 1] * _ODD + hashes[length - 1 :])
        yield length, mix(value + np.uint64(length)), place + length <= ends


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (hash, words, length, item): the windows of all items; ``words`` are joined by blanks.

    An item without words has no window; one without id is listed under an empty id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, high, data, hashes, starts, counts in _split(batch.column(1), hasher):
                ends = np.cumsum(counts)
                raw, stops = data.tobytes(), [*starts[1:].tolist(), len(data)]
                words = [raw[a:b].rstrip() for a, b in zip(starts.tolist(), stops, strict=True)] if len(starts) else []
                owner = np.repeat(np.arange(low, high), counts)
                for length, value, valid in _windows(hashes, counts, min(window, int(counts.max(initial=0)))):
                    if length < window:
                        # Only items that are themselves that short.
                        at = (ends - counts)[counts == length]
                    else:
                        at = np.flatnonzero(valid)
                    for some in np.array_split(at, max(1, len(at) // 10_000)):
                        texts = [b" ".join(words[i : i + length]) for i in some.tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(value[some].view(np.int64)),
                                pa.array(texts, pa.binary()),
                                pa.array(np.full(len(some), length, np.int32)),
                                pa.array([ids[i] for i in owner[some].tolist()], pa.string()),
                            ],
                            names=["hash", "words", "length", "item"],
                        )

    source = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text")
    )
    return source.mapInArrow(run, "hash bigint, words binary, length int, item string").distinct()


@dataclass
class WindowSet:
    """The distinct windows of one part, by hash, and the items that hold each."""

    hashes: np.ndarray
    words: list[bytes]
    lengths: list[int]
    # Windows that share a hash, at most.
    alike: int
    bits: np.ndarray
    item_offsets: np.ndarray
    item_codes: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, rows: pa.Table) -> WindowSet:
        """From (hash, words, length, item), in any order."""
        words = rows.column("words").to_pylist()
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        coded = rows.column("item").combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        order = sorted(range(len(words)), key=lambda i: (hashes[i], words[i]))
        fresh = [j for j, i in enumerate(order) if j == 0 or words[i] != words[order[j - 1]]]
        kept = hashes[[order[j] for j in fresh]] if fresh else np.zeros(0, np.uint64)
        _, repeats = np.unique(kept, return_counts=True)
        bits = np.zeros(1 << _MAP_BITS, dtype=bool)
        bits[kept >> np.uint64(64 - _MAP_BITS)] = True
        return cls(
            hashes=kept,
            words=[words[order[j]] for j in fresh],
            lengths=sorted(set(rows.column("length").to_pylist())),
            alike=int(repeats.max(initial=0)),
            bits=bits,
            item_offsets=np.array([*fresh, len(order)], np.int64),
            item_codes=coded.indices.to_numpy()[order] if order else np.zeros(0, np.int32),
            items=coded.dictionary.to_pylist(),
        )

    def candidates(self, value: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) wherever a hash is one of the set's."""
        at = np.flatnonzero(valid & self.bits[value >> np.uint64(64 - _MAP_BITS)])
        first = np.searchsorted(self.hashes, value[at])
        places, found = [], []
        for shift in range(self.alike):
            window = np.minimum(first + shift, len(self.hashes) - 1)
            same = (first + shift < len(self.hashes)) & (self.hashes[window] == value[at])
            places.append(at[same])
            found.append(window[same])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(found)

    def items_of(self, windows: np.ndarray) -> list[str]:
        windows = np.unique(windows)
        codes = [self.item_codes[self.item_offsets[w] : self.item_offsets[w + 1]] for w in windows.tolist()]
        return [self.items[c] for c in np.unique(np.concatenate(codes)).tolist()]


def _hits(windows: WindowSet, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple:
    """Places, lengths and windows of the verified hits, and where the stretch up to the next word ends."""
    # A word and the blanks after it: up to the next word, and for the last one of all to the end of the bytes.
    stops = np.append(starts[1:], len(data))
    raw = memoryview(data)
    places, sizes, found = [], [], []
    for length, value, valid in _windows(hashes, counts, max(windows.lengths, default=0)):
        if length not in windows.lengths:
            continue
        at, which = windows.candidates(value, valid)
        for place, window in zip(at.tolist(), which.tolist(), strict=True):
            if b" ".join(bytes(raw[starts[place] : stops[place + length - 1]]).split()) == windows.words[window]:
                places.append(place)
                sizes.append(length)
                found.append(window)
    return np.array(places, np.int64), np.array(sizes, np.int64), np.array(found, np.int64), stops


def _scan(column: pa.Array, windows: WindowSet, hasher: WordHasher) -> Iterator[tuple[int, int, pa.Array, pa.Array, pa.Array]]:
    """(first row, end, words per row, spans, items) of a few rows at a time."""
    for low, high, data, hashes, starts, counts in _split(column, hasher):
        bounds = np.concatenate([[0], np.cumsum(counts)])
        places, sizes, found, stops = _hits(windows, data, hashes, starts, counts)
        change = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(change, places, 1)
        np.add.at(change, places + sizes, -1)
        hit = np.cumsum(change[:-1]) > 0
        # A span ends where the words stop being hit, and with its row.
        edge = np.zeros(len(hashes) + 1, dtype=bool)
        edge[bounds] = True
        before, after = np.append(False, hit), np.append(hit, False)
        opens = np.flatnonzero((after & (~before | edge))[:-1])
        closes = np.flatnonzero((before & (~after | edge))[1:]) + 1
        owner = np.searchsorted(bounds, opens, side="right") - 1
        offset = np.searchsorted(opens, bounds)
        # Bytes count from the row's first one.
        _, row_offsets = text_bytes(column)
        base = (row_offsets[low:high] - row_offsets[low])[owner]
        last = closes - 1
        raw = memoryview(data)
        tail = [len(bytes(raw[a:b]).rstrip()) for a, b in zip(starts[last].tolist(), stops[last].tolist(), strict=True)]
        spans = pa.StructArray.from_arrays(
            [
                pa.array(opens - bounds[owner]),
                pa.array(closes - opens),
                pa.array(starts[opens] - base if len(opens) else np.zeros(0, np.int64)),
                pa.array(starts[last] + np.array(tail, np.int64) - starts[opens] if len(opens) else np.zeros(0, np.int64)),
            ],
            fields=list(_ARROW_SPAN),
        )
        by = np.argsort(places, kind="stable")
        places, found = places[by], found[by]
        cuts = np.searchsorted(places, bounds).tolist()
        items = [windows.items_of(found[a:b]) if b > a else [] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield (
            low,
            high,
            pa.array(counts.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), spans).cast(_ARROW_SPANS),
            pa.array(items, _ARROW_ITEMS),
        )


def _one_pass(docs: DataFrame, text: str, part: DataFrame) -> DataFrame:
    """``docs`` with n_words, spans and items as far as one part of the windows tells."""
    windows = docs.sparkSession.sparkContext.broadcast(WindowSet.of(part.toArrow()))
    place = docs.columns.index(text)
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("items", T.ArrayType(T.StringType(), False)),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), windows.value
        for batch in batches:
            for low, high, *found in _scan(batch.column(place).cast(pa.string()), known, hasher):
                yield pa.RecordBatch.from_arrays([*batch.slice(low, high - low).columns, *found], names=schema.names)

    return docs.mapInArrow(run, schema)


def _merged_spans(lists: Column) -> Column:
    """The union of spans of all passes: overlapping ones become one."""
    sorted_spans = F.array_sort(F.flatten(lists))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        end = F.greatest(last["first"] + last["words"], x["first"] + x["words"])
        byte_end = F.greatest(last["start_byte"] + last["bytes"], x["start_byte"] + x["bytes"])
        joined = F.struct(
            last["first"].alias("first"),
            (end - last["first"]).alias("words"),
            last["start_byte"].alias("start_byte"),
            (byte_end - last["start_byte"]).alias("bytes"),
        )
        apart = (F.size(done) == 0) | (F.get(done, F.size(done) - 1)["first"] + F.get(done, F.size(done) - 1)["words"] < x["first"])
        return F.when(apart, F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))
        )

    empty = F.array().cast(SPANS)
    return F.aggregate(sorted_spans, empty, add)


def scanned(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``spans`` and ``items``.

    ``spans``: the stretches of words that windows cover, in order, as first word, words, first byte and bytes (of the
    UTF-8 text). ``items``: the distinct ids (as text, sorted) of the items with a window in the text.

    A null or empty text, or one of other characters only, has no words and no spans. Items that are null or without words
    match nothing; an item without id is listed as ''; a repeated id counts once. Repeated rows of ``docs`` are
    answered each, nulls in other columns do not matter. Other columns are carried along, those named like the three
    are replaced. An empty ``docs`` gives an empty result, an empty ``benchmark`` rows without spans.
    """
    space = Workspace(docs.sparkSession)
    docs = docs.drop(*_ADDED)
    windows = space.write(benchmark_windows(benchmark, item, item_text, window), "windows")
    rows, size = windows.agg(F.count("*"), F.sum(F.octet_length("words"))).first()
    parts = max(-(-rows // part_rows), -(-(size or 0) // part_bytes), 1)
    if parts == 1:
        return _one_pass(docs, text, windows).withColumn("items", F.array_sort("items"))

    # Rows are told apart by all that a hit depends on, and by their ids where there are some.
    keys = {"_t": F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256), "_i": F.col("_id")}
    named = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    texts = docs.select(F.col(text).cast("string").alias("_text"), named.cast("string").alias("_id"))
    dealt = F.pmod(F.xxhash64("hash", "item"), F.lit(parts))
    hits = []
    for part in range(parts):
        found = _one_pass(texts, "_text", windows.where(dealt == part)).where(F.size("spans") > 0)
        once = found.select(*[k.alias(n) for n, k in keys.items()], "spans", "items").dropDuplicates(["_t", "_i"])
        hits.append(space.write(once, "hits"))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("_t", "_i").agg(
        F.collect_list("spans").alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items")
    )
    merged = merged.withColumn("_spans", _merged_spans(F.col("_spans")))
    # The words are counted by a pass with no windows at all.
    counted = _one_pass(docs, text, windows.limit(0)).alias("d")
    own = F.col(f"d.{text}").cast("string")
    own_id = F.col("d.doc_id").cast("string") if "doc_id" in docs.columns else F.lit(None).cast("string")
    joined = counted.join(
        merged.alias("m"), (F.sha2(F.coalesce(own, F.lit("")), 256) == F.col("m._t")) & own_id.eqNullSafe(F.col("m._i")), "left"
    )
    return joined.select(
        *[F.col(f"d.`{c}`") for c in docs.columns],
        F.col("d.n_words").alias("n_words"),
        F.coalesce(F.col("m._spans"), F.col("d.spans")).alias("spans"),
        F.coalesce(F.col("m._items"), F.col("d.items")).alias("items"),
    )


def n_hit() -> Column:
    """Words of a scanned row that lie in spans."""
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["words"])


def without_documents(found: DataFrame, max_share: float = 0.0) -> DataFrame:
    """The scanned rows of whose words at most ``max_share`` lie in spans, with the columns they had before."""
    return found.where(n_hit() <= max_share * F.col("n_words")).drop(*_ADDED)


def without_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The scanned rows with the spans cut out of their texts and a blank in place of each; a null text stays null."""
    raw = F.col(text).cast("string").cast("binary")
    n = F.size("spans")

    def gap(i: Column) -> Column:
        before, after = F.get("spans", i - 1), F.get("spans", i)
        begin = F.when(i == 0, F.lit(0)).otherwise(before["start_byte"] + before["bytes"])
        end = F.when(i == n, F.octet_length(text)).otherwise(after["start_byte"])
        return F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")

    cut = F.array_join(F.transform(F.sequence(F.lit(0), n), gap), " ")
    return found.withColumn(text, F.when(n > 0, cut).otherwise(F.col(text))).drop(*_ADDED)
