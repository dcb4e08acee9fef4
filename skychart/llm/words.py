"""64-bit hashes of words and word runs, taken straight from the bytes of an Arrow column.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z count as a-z. Equal words
have equal hashes everywhere; different ones differ but for a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes hashed at a time; temporary arrays take about 60 times as much.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(ends, dtype=kind, count=len(column) + 1, offset=column.offset * kind().itemsize)
    values = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return values, offsets.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or of one longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _STEP, dtype=np.uint64)
    up[0] = 1
    down = np.full(n, pow(_STEP, -1, 1 << 64), dtype=np.uint64)
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class WordHasher:
    """Hashes the words of many rows at once; keeps its tables between calls."""

    def __init__(self) -> None:
        self._up, self._down = _powers(CHUNK)

    def __call__(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows between the offsets: word hashes, where each word starts, and words per row."""
        data, bounds = values[offsets[0] : offsets[-1]], offsets - offsets[0]
        found, places, low = [], [], 0
        while low < len(data):
            high = self._cut(data, bounds, low)
            hashes, starts = self._part(data[low:high], bounds[np.searchsorted(bounds, low) : np.searchsorted(bounds, high)] - low)
            found.append(hashes)
            places.append(starts + low)
            low = high
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        starts = np.concatenate(places) if places else np.zeros(0, np.int64)
        counts = np.diff(np.searchsorted(starts, bounds))
        return hashes, starts, counts

    def _cut(self, data: np.ndarray, bounds: np.ndarray, low: int) -> int:
        """The end of the next part: no word crosses it."""
        step = CHUNK
        while low + step < len(data):
            high = low + step
            row = int(bounds[np.searchsorted(bounds, high, side="right") - 1])
            spaces = np.flatnonzero(_SPACE[data[low:high]])
            end = max(row, low + int(spaces[-1]) + 1 if len(spaces) else 0)
            if end > low:
                return end
            step *= 2  # a word longer than the part
        return len(data)

    def _part(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self._up):
            up, down = _powers(len(data))
        else:
            up, down = self._up[: len(data)], self._down
        solid = ~_SPACE[data]
        fresh = np.ones(len(data) + 1, dtype=bool)
        fresh[1:-1] = ~solid[:-1]
        fresh[rows] = True
        starts = np.flatnonzero(solid & fresh[:-1])
        fresh[:-1] |= ~solid
        ends = np.flatnonzero(solid & fresh[1:])
        terms = _BYTES[data] * up
        sums = np.cumsum(terms)
        word = (sums[ends] - sums[starts] + terms[starts]) * down[starts]
        return mix(word + (ends - starts + 1).astype(np.uint64) * _ODD), starts


@cache
def _first_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(CHUNK)


def _some_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _first_powers() if n <= CHUNK else _powers(n)
    return up[:n], down[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``starts`` (in ascending order) to before ``ends``, where A-Z count as a-z."""
    out, low = [np.zeros(0, np.uint64)], 0
    while low < len(starts):
        # As many spans as lie in a part of the bytes, or one longer span.
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK)))
        first, last = int(starts[low]), int(ends[low:high].max())
        up, down = _some_powers(last - first)
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTES[data[first:last]] * up, out=sums[1:])
        at, to = starts[low:high] - first, ends[low:high] - first
        out.append(mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64) * _ODD))
        low = high
    return np.concatenate(out)


def runs(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs of each row, and runs per row; a row of fewer words gives one run of all."""
    n = len(hashes)
    value = hashes.copy()
    first = np.cumsum(counts) - counts
    short = {m: first[counts == m] for m in range(1, k)}
    values = {}
    for m, at in short.items():
        v = hashes[at]
        for j in range(1, m):
            v = mix(v * _ODD + hashes[at + j])
        values[m] = mix(v + np.uint64(m))
    for j in range(1, min(k, n)):
        value[: n - j] = mix(value[: n - j] * _ODD + hashes[j:])
    place = np.arange(n) - np.repeat(first, counts)
    valid = place + k <= np.repeat(counts, counts)
    for m, at in short.items():
        value[at] = values[m]
        valid[at] = True
    return value[valid], np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))


def run_sums(numbers: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Sums of a number per word over the runs that ``runs`` gives, in the same order."""
    ends = np.cumsum(counts)
    place = np.arange(len(numbers))
    first, last = np.repeat(ends - counts, counts), np.repeat(ends, counts)
    valid = (place + k <= last) | (place == first)
    total = np.concatenate([[0], np.cumsum(numbers)])
    return (total[np.minimum(place + k, last)] - total[:-1])[valid]


def sequence_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each row's whole word sequence."""
    first = np.cumsum(counts) - counts
    place = (np.arange(len(hashes)) - np.repeat(first, counts)).astype(np.uint64)
    out = []
    for seed in (np.uint64(1), np.uint64(2)):
        # Every word is hashed together with its place, so the sum depends on the order.
        terms = mix(hashes + mix(place * _ODD + seed))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        out.append(mix(sums[first + counts] - sums[first] + counts.astype(np.uint64) * seed))
    return out[0], out[1]


def split_words(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of every row as they are written, one after another, and words per row; a null has none.

    Equal words have equal indices, and no two words share one.
    """
    parts = pc.ascii_split_whitespace(column.fill_null(""))
    ends = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    # White space at the ends of a text leaves empty parts.
    empty = pc.index(coded.dictionary, "").as_py()
    if empty < 0:
        return coded, np.diff(ends)
    codes = coded.indices.to_numpy()
    solid = codes != empty
    before = np.concatenate([[0], np.cumsum(solid)])
    codes = codes[solid]
    codes -= codes > empty
    words = pa.concat_arrays([coded.dictionary.slice(0, empty), coded.dictionary.slice(empty + 1)])
    return pa.DictionaryArray.from_arrays(pa.array(codes), words), np.diff(before[ends])
