"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max index."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skychart.llm.words import slices, span_hashes, text_bytes
from skychart.sources.workspace import Workspace

# Labelled rows that the index is fitted on: those with the smallest hash of their id.
MAX_EXAMPLES = 20_000
# A term's chi-square with the label below which the link is taken for noise and adds no weight.
MIN_CHI2 = 20.0
# Besides whole words, their beginnings of this length are terms, which finds inflected and joined forms.
STEM = 5
NEIGHBOURS = 25
BLOCK = 64
# The terms with most postings, kept as columns, and queries that are searched in step. A column costs every query one
# product per example, a list only the queries with its term.
COLUMNS, QUERIES = 768, 128
# Columns that are multiplied for every example, examples per wanted one that bound the k-th best score, and the share of
# the examples (one in so many) from which on a query is multiplied with all of them.
LEADING, FIRST, WHOLE = 256, 2, 24
# Bytes of text whose terms are counted at a time (or one longer text), and bits of a term's key beside the number of its row.
PARSED, KEY_BITS = 1 << 18, 54
# Words that no example has are counted over all documents in so many hash groups.
OTHER_BITS = 21
# Terms of documents that wait to be counted together.
COUNTED = 1 << 20
# The weight of the base rate in a vote, in units of one example without any likeness.
PRIOR_WEIGHT = 1.0
# Added to the distance 1 - cosine, by which votes are divided.
NEAREST = 0.01
# Distinct texts whose score a worker keeps.
KEPT_SCORES = 100_000
# The part of the ids that never trains: crc32(doc_id as text) mod 5 = 0.
FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[^\x00-\x7F]")
_TERM = "term bigint, toxic bigint, n bigint"
_SLOT = "slot bigint, n bigint"
_NEAR = T.ArrayType(
    T.StructType(
        [T.StructField("example", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("toxic", T.DoubleType())]
    )
)


def is_held_out(doc_id):
    """Whether an id belongs to the fold that never trains; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def counted(text: str | None) -> Counter[str]:
    """Occurrences of words, and of beginnings of longer words marked by a star."""
    counts = Counter(words_of(text))
    stems: Counter[str] = Counter()
    for w, n in counts.items():
        if len(w) > STEM:
            stems[w[:STEM] + "*"] += n
    counts.update(stems)
    return counts


_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[128:] = True
_STAR = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64((1 << KEY_BITS) - 1)


def counts_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``counted`` for many texts: (from row, to row, rows from the first, keys, occurrences), by row and key.

    A key are 54 bits that stand for a term; two terms share theirs by a chance of about 2^-54 a pair.
    """
    texts = plain(texts)
    values, offsets = text_bytes(texts)
    for low, high in slices(offsets, PARSED):
        for a in range(low, high, 1 << (64 - KEY_BITS)):
            b = min(high, a + (1 << (64 - KEY_BITS)))
            rows, keys = _keys(values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            both, times = np.unique(rows.astype(np.uint64) << np.uint64(KEY_BITS) | keys, return_counts=True)
            yield a, b, (both >> np.uint64(KEY_BITS)).astype(np.int64), both & _KEY, times


def plain(texts: pa.Array) -> pa.Array:
    """Texts whose words are their longest runs of ASCII letters and other bytes above 127."""
    texts = texts.cast(pa.large_string()).fill_null("")
    wide = pc.invert(pc.string_is_ascii(texts)).to_numpy(zero_copy_only=False)
    if wide.any():
        words = []
        for x in texts.filter(pa.array(wide)).to_pylist():
            x = x.lower()
            for c in set(_WIDE.findall(x)):
                if not _WORD.match(c):
                    x = x.replace(c, " ")
            words.append(x)
        texts = pc.replace_with_mask(texts, pa.array(wide), pa.array(words, pa.large_string()))
    return texts


def _keys(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of every word and beginning between the bounds of rows."""
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _LETTER[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[rows] = True
    starts = np.flatnonzero(letter[1:] & (~letter[:-1] | fresh))
    ends = np.flatnonzero(letter[:-1] & (~letter[1:] | fresh))
    if len(data) and data.max() > 127:
        # Places of the first bytes of code points, and how many lie before a byte.
        points = np.flatnonzero((data & 0xC0) != 0x80)
        first, last = np.searchsorted(points, starts), np.searchsorted(points, ends)
        long = last - first > STEM
        cuts = points[first[long] + STEM]
    else:
        long = ends - starts > STEM
        cuts = starts[long] + STEM
    words = span_hashes(data, starts, ends)
    stems = span_hashes(data, starts[long], cuts) * _STAR + _STAR
    row = np.repeat(np.arange(len(rows) - 1), np.diff(np.searchsorted(starts, rows)))
    return np.concatenate([row, row[long]]), np.concatenate([words, stems]) & _KEY


def places(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Where each key is in the sorted vocabulary, -1 where it is not."""
    if not len(vocabulary):
        return np.full(len(keys), -1, np.int64)
    # Keys in order are looked up in neighbouring memory.
    order = np.argsort(keys)
    ascending = keys[order]
    at = np.minimum(np.searchsorted(vocabulary, ascending), len(vocabulary) - 1)
    found = np.empty(len(keys), np.int64)
    found[order] = np.where(vocabulary[at] == ascending, at, -1)
    return found


def other_slots(keys: np.ndarray) -> np.ndarray:
    """The hash groups of terms that no example has."""
    return (keys >> np.uint64(KEY_BITS - OTHER_BITS)).astype(np.int64)


# An entry of a list, read in one piece.
_ENTRY = np.dtype([("example", np.int32), ("weight", np.float32)])


@dataclass
class BlockMaxIndex:
    """Distinct example vectors by term, in blocks of fixed ranges with their largest weights.

    Terms with many postings are columns of a matrix, the others have lists. A query's score of an example is at most what
    the lists and the leading columns give plus the sum over the later columns of its weight times the block's largest weight.
    Each query looks at its most promising examples, then at all whose bound reaches the worst of the best found so far.
    The result is exact; scores are as precise as weights of single precision.
    """

    idf: np.ndarray
    block: int = BLOCK
    size: int = 0
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    lists: np.ndarray = field(default_factory=lambda: np.zeros(0, _ENTRY))
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    rest_length: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def __getstate__(self) -> dict:
        """What is sent to tasks: of the columns only what is not zero."""
        at = np.flatnonzero(self.dense)
        place = at.astype(np.uint32 if self.dense.size < 1 << 32 else np.int64)
        lost = {"dense": (self.dense.shape, place, self.dense.ravel()[at]), "most": None, "rest_length": None}
        return self.__dict__ | lost

    def __setstate__(self, state: dict) -> None:
        shape, at, values = state["dense"]
        self.__dict__ |= state | {"dense": np.zeros(shape, np.float32)}
        self.dense.ravel()[at] = values
        self._bound()

    def _bound(self) -> None:
        """Of the columns the largest weights per block, and each example's length in the later ones."""
        self.most, later = self._largest(), self.dense[:, LEADING:]
        self.rest_length = np.sqrt(np.einsum("ij,ij->i", later, later))

    def _largest(self) -> np.ndarray:
        if not self.size:
            return np.zeros(self.dense.shape, np.float32)
        return np.maximum.reduceat(self.dense, np.arange(0, self.size, self.block), axis=0)

    @classmethod
    def build(cls, examples: Sequence, idf: np.ndarray, block: int = BLOCK, columns: int = COLUMNS) -> BlockMaxIndex:
        """``examples`` are sequences of (term, occurrences), or arrays of two columns."""
        index = cls(idf, block, size=len(examples))
        if not examples:
            index.column, index.first = np.full(len(idf), -1, np.int32), np.zeros(len(idf) + 1, np.int64)
            return index
        # Entries are held once, in small types: the driver builds this.
        lengths = np.zeros(len(idf), np.int64)
        for e in examples:
            lengths[np.asarray(e, dtype=np.int64).reshape(-1, 2)[:, 0]] += 1
        frequent = np.argsort(-lengths, kind="stable")[:columns]
        index.column = np.full(len(idf), -1, np.int32)
        index.column[frequent] = np.arange(len(frequent))
        index.dense = np.zeros((index.size, len(frequent)), np.float32)
        lengths[frequent] = 0
        index.first = np.concatenate([[0], np.cumsum(lengths)])
        index.lists = np.zeros(index.first[-1], _ENTRY)
        free = index.first[:-1].copy()
        for i, e in enumerate(examples):
            terms, weights, _ = index._weights(e)
            place = index.column[terms]
            index.dense[i, place[place >= 0]] = weights[place >= 0]
            terms = terms[place < 0]
            index.lists["example"][free[terms]] = i
            index.lists["weight"][free[terms]] = weights[place < 0]
            free[terms] += 1
        index._bound()
        return index

    def _weights(self, counts, beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
        """Terms, TF-IDF weights of length 1, and the length; ``beyond`` is the squared length outside the index's terms."""
        pairs = np.asarray(counts, dtype=np.int64).reshape(-1, 2)
        raw = (1.0 + np.log(pairs[:, 1])) * self.idf[pairs[:, 0]]
        length = math.sqrt(float(raw @ raw) + beyond)
        return pairs[:, 0], raw / length if length else raw, length

    def weights(self, counts) -> list[tuple[int, float]]:
        """TF-IDF weights of length 1."""
        terms, weights, _ = self._weights(counts)
        return list(zip(terms.tolist(), weights.tolist(), strict=True))

    def nearest(self, counts, k: int) -> list[tuple[float, int]]:
        """The ``k`` nearest examples that share a term, as (cosine, example), ties to the smaller example."""
        return self.search([(counts, 0.0)], k)[0]

    def search(self, queries: Sequence[tuple], k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` of several (counts, squared length of other terms) in step.

        The lists and the leading columns are read for all examples. What the later columns, which weigh little each, add
        to an example is at most the bound of its block, and at most the product of both lengths in them; they are multiplied
        only for examples whose bound reaches the k-th best score of the most promising ones.
        """
        n, size = len(queries), self.size
        if not size or not n:
            return [[] for _ in queries]
        wide = np.zeros((n, self.dense.shape[1]), np.float64)
        rest = np.zeros((n, size), np.float64)
        packed = self.lists.view(np.int64)
        pairs = [np.asarray(counts, dtype=np.int64).reshape(-1, 2) for counts, _ in queries]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).tolist()
        pairs = np.concatenate(pairs)
        terms = pairs[:, 0]
        raw, place = (1.0 + np.log(pairs[:, 1])) * self.idf[terms], self.column[terms]
        low, sizes = self.first[terms], self.first[terms + 1] - self.first[terms]
        # Room for the longest query's entries is made once, not for each.
        lengths = np.concatenate([[0], np.cumsum(sizes)])[ends]
        room = int(np.diff(lengths).max())
        count, entries, examples, products = np.arange(room), np.empty(room, np.int64), np.empty(room, np.int64), np.empty(room)
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            length = math.sqrt(float(raw[a:b] @ raw[a:b]) + queries[i][1])
            weights = raw[a:b] / length if length else raw[a:b]
            some = np.flatnonzero(place[a:b] >= 0)
            wide[i, place[a:b][some]] = weights[some]
            m = int(lengths[i + 1] - lengths[i])
            if not m:
                continue
            own = sizes[a:b]
            at = np.repeat(low[a:b] - (np.cumsum(own) - own), own)
            at += count[:m]
            both = packed.take(at, out=entries[:m], mode="clip").view(_ENTRY)
            examples[:m] = both["example"]
            products[:m] = both["weight"]
            products[:m] *= np.repeat(weights, own)
            rest[i] = np.bincount(examples[:m], products[:m], minlength=size)
        narrow = wide.astype(np.float32)
        head, tail = narrow[:, :LEADING], narrow[:, LEADING:]
        # Scores so far, without the later columns, and the most that these add to any example of a block.
        scores = head @ self.dense[:, :LEADING].T
        scores += rest
        most = tail @ self.most[:, LEADING:].T
        length = np.linalg.norm(tail, axis=1)
        whole = np.zeros(n, bool)
        least = np.full(n, -np.inf, np.float32)
        open_: list[np.ndarray] = []
        for i in range(n):
            bounds = scores[i] + np.minimum(np.repeat(most[i], self.block)[:size], length[i] * self.rest_length)
            # The most promising examples give a bound of the k-th best; the margin covers rounding in sums of another order.
            if size > FIRST * k:
                first = np.flatnonzero(bounds >= np.partition(bounds, -FIRST * k)[-FIRST * k])[: 2 * FIRST * k]
                found = scores[i, first] + self.dense[first, LEADING:] @ tail[i]
                least[i] = np.partition(found, -k)[-k]
            open_.append(np.flatnonzero(bounds >= max(least[i] - 1e-4, 0.0)))
            whole[i] = len(open_[i]) * WHOLE > size
        # Where many examples are left, one product with all of them costs less than picking.
        rows = np.flatnonzero(whole)
        if len(rows):
            scores[rows] += tail[rows] @ self.dense[:, LEADING:].T
        out = []
        for i in range(n):
            near = open_[i]
            found = scores[i, near]
            if not whole[i]:
                found = found + self.dense[near, LEADING:] @ tail[i]
            if len(near) > k:
                best = found >= np.partition(found, -k)[-k] - 1e-4
                near, found = near[best], found[best]
            near = near[found > 0]
            exact = self.dense[near].astype(np.float64) @ wide[i] + rest[i, near]
            order = np.lexsort((near, -exact))[:k]
            out.append(list(zip(exact[order].tolist(), near[order].tolist(), strict=True)))
        return out


def monotone(raw: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing map from raw scores to rates (pooled adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for x, y, w in zip(raw[order], truth[order], weight[order], strict=True):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class ToxicModel:
    """The labelled examples: distinct vectors with their labels, and the calibration of their votes.

    ``vocabulary`` has the keys of the examples' terms in order. ``others`` has the documents, ``total`` in all, that have a
    word of a hash group which no example has.
    """

    vocabulary: np.ndarray
    index: BlockMaxIndex
    toxic: np.ndarray
    count: np.ndarray
    base: float
    empty: float
    knots: tuple[np.ndarray, np.ndarray] | None = None
    others: np.ndarray = field(default_factory=lambda: np.zeros(1 << OTHER_BITS, np.int32))
    total: int = 0

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, float] | None]:
        """Of each text (term, occurrences) of the examples' terms, and the squared length of all others; None without words."""
        for low, high, rows, keys, times in counts_of(texts):
            known = places(keys, self.vocabulary)
            old, new = known >= 0, known < 0
            idf = np.log(1.0 + self.total / np.maximum(1, self.others[other_slots(keys[new])]))
            beyond = np.bincount(rows[new], ((1.0 + np.log(times[new])) * idf) ** 2, minlength=high - low)
            some = np.bincount(rows, minlength=high - low)
            pairs = np.column_stack([known[old], times[old]])
            ends = np.searchsorted(rows[old], np.arange(high - low + 1))
            for i in range(high - low):
                yield (pairs[ends[i] : ends[i + 1]], float(beyond[i])) if some[i] else None

    def vote(self, near: list[tuple[float, int]], left_out: int = -1) -> float:
        """The share of toxic examples among the neighbours, weighted by distance; one copy may be left out."""
        total, toxic = PRIOR_WEIGHT, PRIOR_WEIGHT * self.base
        for s, i in near:
            n, t = self.count[i], self.toxic[i]
            if i == left_out:
                n, t = n - 1, t * (n - 1) / n
            weight = s * s / (max(0.0, 1.0 - s) + NEAREST)
            total += weight * n
            toxic += weight * t
        return toxic / total

    def calibrated(self, raw: float) -> float:
        if self.knots is None or not len(self.knots[0]):
            return raw
        return float(min(1.0, max(0.0, np.interp(raw, *self.knots))))

    def scores(self, texts: pa.Array) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Probability and evidence of each text; one without words has the rate of such examples."""
        for group in batched(self.vectors(texts), QUERIES):
            found = iter(self.index.search([v for v in group if v is not None], NEIGHBOURS))
            for v in group:
                if v is None:
                    yield self.empty, []
                else:
                    near = next(found)
                    yield self.calibrated(self.vote(near)), near


def labelled(labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of at most ``max_examples`` training rows; an id labelled twice is toxic if any label says so."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_examples)
    )


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents with each term of the vocabulary, with each hash group of other terms, and in all."""
    shared, size = docs.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary)
    slots = size + (1 << OTHER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(slots + 1, np.int64)
        waiting: list[np.ndarray] = []

        def add() -> None:
            nonlocal sums
            sums += np.bincount(np.concatenate(waiting), minlength=slots + 1)
            waiting.clear()

        for batch in batches:
            for low, high, rows, keys, _ in counts_of(batch.column(0)):
                known = places(keys, shared.value)
                slot = np.where(known < 0, size + other_slots(keys), known)
                # Two terms of one group count once in a document.
                waiting.append(np.unique(rows * slots + slot) % slots)
                sums[-1] += high - low
                # All slots are gone through once for many texts.
                if sum(len(w) for w in waiting) >= COUNTED:
                    add()
        if waiting:
            add()
        used = np.flatnonzero(sums)
        for low in range(0, len(used), 1 << 16):
            part = used[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(sums[part])], names=["slot", "n"])

    found = (
        docs.select(F.col("text").cast("string"))
        .mapInArrow(run, _SLOT)
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    shared.destroy()
    sums = np.zeros(slots + 1, np.int64)
    sums[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return sums[:size], sums[size:-1].astype(np.int32), int(sums[-1])


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> ToxicModel:
    """Learn from labelled documents outside the held-out fold.

    ``max_examples`` bounds the rows that are learned from; the index, which every task gets, has all words and
    beginnings of their texts. Frequencies of terms are those in all documents. A term's weight is its idf, times one plus
    the root of its chi-square beyond ``MIN_CHI2`` where it is linked with the label.
    Without labelled rows the model knows nothing: every score is 0.
    """
    space = Workspace(docs.sparkSession)
    chosen = space.write(labelled(labels, max_examples), "labelled")
    # The side is bounded by max_examples rows of two numbers.
    examples = space.write(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "toxic"),
        "examples",
    )
    totals = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    n = n1 + n0
    if not n:
        return ToxicModel(np.zeros(0, np.uint64), BlockMaxIndex(np.zeros(0)), np.zeros(0), np.zeros(0), 0.0, 0.0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for low, high, rows, keys, _ in counts_of(batch.column(0)):
                for label in (0, 1):
                    has, n = np.unique(keys[toxic[low:high][rows] == label], return_counts=True)
                    columns = [pa.array(has.view(np.int64)), pa.array(np.full(len(has), label)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "toxic", "n"])

    # At most the distinct words of max_examples rows.
    terms = (
        examples.mapInArrow(seen, _TERM)
        .groupBy("term")
        .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("df"))
        .toArrow()
    )
    vocabulary = terms.column("term").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    a, df = (terms.column(c).to_numpy()[order].astype(np.float64) for c in ("a", "df"))
    del terms, order
    # Chi-square of the two-by-two table of term and label.
    below = df * (n - df) * float(n1) * n0
    chi2 = np.divide(n * (a * n - df * n1) ** 2, below, out=np.zeros(len(df)), where=below > 0)
    link = np.where(a * n > df * n1, np.sqrt(np.maximum(0.0, chi2 - MIN_CHI2)), 0.0)
    documents, others, total = _frequencies(docs, vocabulary)
    weight = np.log(1.0 + total / np.maximum(documents, 1)) * (1.0 + link)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, rows, keys, times in counts_of(batch.column(0)):
                pairs = np.column_stack([places(keys, shared.value), times]).astype("<u4")
                ends = np.searchsorted(rows, np.arange(high - low + 1))
                found = pa.array([pairs[ends[i] : ends[i + 1]].tobytes() for i in range(high - low)], pa.binary())
                labels = batch.column(1).slice(low, high - low).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([found, labels, pa.array(np.ones(high - low, np.int64))], names=["vector", "toxic", "n"])

    grouped = space.write(
        examples.mapInArrow(vectors, "vector binary, toxic bigint, n bigint")
        .groupBy("vector")
        .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")),
        "vectors",
    )
    shared.destroy()
    # At most max_examples rows. Neighbouring numbers go to texts with the same heaviest frequent term, for tight blocks.
    frequent = np.zeros(len(df))
    frequent[np.argsort(-df, kind="stable")[:COLUMNS]] = 1.0
    rows = []
    for r in grouped.toLocalIterator():
        pairs = _parsed(r["vector"])
        lead = int(pairs[np.argmax((weight * frequent)[pairs[:, 0]] * pairs[:, 1]), 0]) if len(pairs) else -1
        rows.append((lead, bytes(r["vector"]), r["toxic"], r["n"]))
    rows.sort()
    full = [r for r in rows if r[1]]
    blank = next((r for r in rows if not r[1]), (-1, b"", 0, 0))
    base = n1 / n
    model = ToxicModel(
        vocabulary,
        BlockMaxIndex.build([_parsed(r[1]) for r in full], weight),
        np.array([float(r[2]) for r in full]),
        np.array([float(r[3]) for r in full]),
        base,
        (blank[2] + PRIOR_WEIGHT * base) / (blank[3] + PRIOR_WEIGHT),
        others=others,
        total=total,
    )
    # Each example is scored by the others; the votes are then mapped to the rates they had.
    if full:
        numbers = {hashlib.md5(r[1]).digest(): i for i, r in enumerate(full)}
        lent = docs.sparkSession.sparkContext.broadcast((replace(model, vocabulary=model.vocabulary[:0], others=np.zeros(0)), numbers))

        def votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, numbers = lent.value
            for frame in frames:
                keys = [bytes(v) for v in frame["vector"] if len(v)]
                for low in range(0, len(keys), QUERIES):
                    part = keys[low : low + QUERIES]
                    found = model.index.search([(_parsed(v), 0.0) for v in part], NEIGHBOURS + 1)
                    own = [numbers[hashlib.md5(v).digest()] for v in part]
                    raw = [model.vote(_others(near, i, model.count[i]), i) for near, i in zip(found, own, strict=True)]
                    yield pd.DataFrame({"example": own, "raw": raw})

        cores = max(1, docs.sparkSession.sparkContext.defaultParallelism)
        raw = np.zeros(len(full))
        for r in grouped.select("vector").repartition(cores).mapInPandas(votes, "example bigint, raw double").collect():
            raw[r["example"]] = r["raw"]
        lent.destroy()
        model.knots = monotone(raw, model.toxic / model.count, model.count)
    return model


def _others(near: list[tuple[float, int]], own: int, copies: float) -> list[tuple[float, int]]:
    """The neighbours an example has without itself, as many as any other text has."""
    return [x for x in near if x[1] != own or copies > 1][:NEIGHBOURS]


def _parsed(key: bytes) -> np.ndarray:
    return np.frombuffer(key, "<u4").reshape(-1, 2)


def scored(docs: DataFrame, model: ToxicModel, keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) of every document, with ``_score`` and ``_neighbours``, over its whole text.

    A null or empty text has no terms, and so the rate of the examples without terms; words that no example has
    count in a text's length. Copies score
    alike. ``_neighbours`` is the evidence: example numbers (vectors of the index), cosines and shares of toxic
    labels, nearest first. Every row is scored on its own, without an exchange. Columns of the two added names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("_score", "_neighbours")]
    near_type = pa.list_(pa.struct([("example", pa.int32()), ("similarity", pa.float64()), ("toxic", pa.float64())]))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            keys = [hashlib.md5((x.as_py() or "").encode("utf-8", "replace")).digest() for x in texts]
            if len(known) >= KEPT_SCORES:
                known.clear()
            fresh = list({k: i for i, k in enumerate(keys) if k not in known}.items())
            if fresh:
                found = model.scores(texts.take(pa.array([i for _, i in fresh])))
                known |= {k: (score, near[:5]) for (k, _), (score, near) in zip(fresh, found, strict=True)}
            scores = [known[k][0] for k in keys]
            evidence = [
                [{"example": i, "similarity": s, "toxic": float(model.toxic[i] / model.count[i])} for s, i in known[k][1]]
                for k in keys
            ]
            added = [pa.array(scores, pa.float64()), pa.array(evidence, near_type)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *added], names=[*kept, "_score", "_neighbours"]
            )

    source = docs.select(*kept, F.col("text").cast("string").alias("_text_of_row"))
    schema = T.StructType(
        [
            *source.schema.fields[:-1],
            T.StructField("_score", T.DoubleType()),
            T.StructField("_neighbours", _NEAR),
        ]
    )
    return source.mapInArrow(run, schema)
