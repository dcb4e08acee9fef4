"""Secrets in texts: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skychart.llm.words import text_bytes
from skychart.sources.workspace import Workspace

# Labelled findings that the forest is fitted on, and its size.
MAX_FINDINGS, TREES, DEPTH = 20_000, 24, 6
# Words of two to six letters that make up the dictionary.
MAX_WORDS, SHORTEST, LONGEST = 5_000, 2, 6
# A run this long may be a secret anywhere; after a name like "password" a shorter one may.
RUN, ASSIGNED = 16, 6
# Bytes around a candidate that its neighbouring words are taken from.
AROUND = 40

_NAMES = "api_?key|apikey|access_?key|auth|credential|passwd|password|private_?key|pwd|secret|token"
_RUN = re.compile(rf"[A-Za-z0-9_+/-]{{{RUN},}}={{0,2}}")
_ASSIGNMENT = re.compile(r"[=:]")
_NAME = re.compile(rf"([\w-]*(?:{_NAMES})[\w-]*)[\"']?\s*$", re.IGNORECASE)
_VALUE = re.compile(rf"\s*[\"']?([^\s\"',;]{{{ASSIGNED},}})")
_WORD = re.compile(r"[^\W\d_]+")
_KEYED = re.compile(rf"(?:{_NAMES})", re.IGNORECASE)
# Fixed formats of well-known issuers: a prefix and the characters that follow it.
_ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")

FEATURES = (
    "length", "digits", "upper", "symbols", "distinct", "transitions", "bigrams", "coverage",
    "assigned", "quoted", "key_before", "key_after", "word_before", "word_after", "path",
)
# Letters 1 to 26, digits 27, all else 0.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[ord("a") : ord("z") + 1] = np.arange(1, 27)
_KIND[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_KIND[ord("0") : ord("9") + 1] = 27
_KINDS = 28


@dataclass
class Language:
    """What all documents say about ordinary text: letter pairs, and the most frequent short words."""

    pairs: np.ndarray
    words: frozenset[str]

    def surprise(self, text: str) -> float:
        """Mean negative log probability of the steps between neighbouring characters."""
        kinds = _KIND[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
        return float(-self.pairs[kinds[:-1], kinds[1:]].mean()) if len(kinds) > 1 else 0.0

    def coverage(self, text: str) -> float:
        """Share of the characters that dictionary words cover, the longest first, from left to right."""
        text, i, covered = text.lower(), 0, 0
        while i < len(text):
            for n in range(LONGEST, SHORTEST - 1, -1):
                if text[i : i + n] in self.words:
                    covered += n
                    i += n
                    break
            else:
                i += 1
        return covered / max(1, len(text))


def language(docs: DataFrame) -> Language:
    """Counts over all texts; their sizes are fixed: letter pairs, and ``MAX_WORDS`` words."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_KINDS * _KINDS, np.int64)
        for batch in batches:
            values, offsets = text_bytes(batch.column(0))
            for low in range(int(offsets[0]), int(offsets[-1]), 1 << 20):
                kinds = _KIND[values[low : min(low + (1 << 20) + 1, int(offsets[-1]))]]
                total += np.bincount(kinds[:-1] * _KINDS + kinds[1:], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["pair", "n"])

    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.mapInArrow(pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones(_KINDS * _KINDS)
    counts[found.column("pair").to_numpy()] += found.column("n").to_numpy()
    table = counts.reshape(_KINDS, _KINDS)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(rf"(?<![^\W_])[^\W\d_]{{{SHORTEST},{LONGEST}}}(?![^\W_])")
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pattern.findall(text.as_py().lower()))
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()))], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    words = (
        texts.mapInArrow(short, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(MAX_WORDS)
        .collect()
    )
    return Language(np.log(table / table.sum(axis=1, keepdims=True)), frozenset(r["word"] for r in words))


@dataclass
class Candidate:
    start: int
    value: str
    name: str
    before: str
    after: str


def candidates(text: str) -> list[Candidate]:
    """Places that may hold a secret, from left to right without overlap; ``start`` counts code points."""
    places = [(*m.span(), "") for m in _RUN.finditer(text)]
    for m in _ASSIGNMENT.finditer(text):
        name = _NAME.search(text, max(0, m.start() - AROUND), m.start())
        value = _VALUE.match(text, m.end()) if name else None
        if value:
            places.append((*value.span(1), name.group(1)))
    found, end = [], 0
    # A named value comes before the runs inside it.
    for a, b, name in sorted(places, key=lambda p: (p[0], not p[2], -p[1])):
        if a >= end:
            found.append(Candidate(a, text[a:b], name, text[max(0, a - AROUND) : a], text[b : b + AROUND]))
            end = b
    return found


def row_features(c: Candidate, path: str, known: Language) -> list[float]:
    v, n = c.value, len(c.value)
    kinds = ["d" if x.isdigit() else "u" if x.isupper() else "l" if x.isalpha() else "s" for x in v]
    before, after = _WORD.findall(c.before.lower()), _WORD.findall(c.after.lower())
    return [
        float(n),
        kinds.count("d") / n,
        kinds.count("u") / n,
        kinds.count("s") / n,
        len(set(v)) / n,
        sum(a != b for a, b in zip(kinds[:-1], kinds[1:], strict=True)) / max(1, n - 1),
        known.surprise(v),
        known.coverage(v),
        float(c.before.rstrip("\"' ").endswith(("=", ":"))),
        float(c.before.endswith(('"', "'"))),
        float(bool(_KEYED.search(c.before)) or bool(c.name)),
        float(bool(_KEYED.search(c.after))),
        float(zlib.crc32(before[-1].encode()) % 64) if before else -1.0,
        float(zlib.crc32(after[0].encode()) % 64) if after else -1.0,
        float(zlib.crc32(path.encode()) % 64),
    ]


def reviewed(c: Candidate) -> int:
    """The review that labels findings where a table has none: issuers' formats, long hexadecimal
    digests, and values assigned to a secret's name that mix letters with digits are secrets."""
    if _ISSUED.fullmatch(c.value):
        return 1
    mixed = any(x.isdigit() for x in c.value) and any(x.isalpha() for x in c.value)
    return int(mixed and (bool(_HEX.fullmatch(c.value)) or bool(c.name)))


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, children and share of secrets."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    base: float = 0.0

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.full(len(x), self.base)
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                inner = feature[node] >= 0
                if not inner.any():
                    break
                value = x[np.arange(len(x)), np.maximum(feature[node], 0)]
                below = np.where(value <= threshold[node], left[node], right[node])
                node = np.where(inner, below, node)
            total += share[node]
        return total / len(self.trees)


def _exported(tree) -> tuple[np.ndarray, ...]:
    rows: list[list[float]] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, 0.0])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2] = add(node.leftChild())
            rows[at][3] = add(node.rightChild())
        else:
            stats = list(node.impurityStats().stats())
            rows[at][4] = stats[1] / sum(stats) if sum(stats) else 0.0
        return at

    add(tree._java_obj.rootNode())
    table = np.array(rows)
    return table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]


def labelled_findings(docs: DataFrame, known: Language, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """(features, label) of reviewed candidates in documents taken by hash of their id, ``max_findings`` at most."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (order, i, row_features(c, path, shared.value), float(reviewed(c)))
                for order, path, text in zip(frame["order"], frame["path"], frame["text"], strict=True)
                for i, c in enumerate(candidates(text))
            ]
            yield pd.DataFrame(rows, columns=["order", "place", "features", "label"])

    source = docs.select(
        F.xxhash64("doc_id").alias("order"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    found = Workspace(docs.sparkSession).write(
        source.mapInPandas(run, "order bigint, place bigint, features array<double>, label double"), "reviewed"
    )
    # Secrets are rare: half of the bound is kept for them.
    halves = [
        found.where(F.col("label") == v).orderBy("order", "place").limit(max_findings // 2) for v in (0.0, 1.0)
    ]
    return halves[0].unionByName(halves[1]).select("features", "label")


def train(findings: DataFrame, seed: int = 11) -> Forest:
    """A random forest from (features, label); with labels of one kind only, that kind's rate everywhere."""
    findings = Workspace(findings.sparkSession).write(findings, "findings")
    counts = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Forest(base=1.0 if 1.0 in counts else 0.0)
    rows = findings.select(array_to_vector("features").alias("features"), "label")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=5).fit(rows)
    return Forest([_exported(t) for t in model.trees])


def fit(docs: DataFrame, max_findings: int = MAX_FINDINGS) -> tuple[Language, Forest]:
    """Language counts over all documents, and a forest on reviewed findings of (doc_id, path, text)."""
    known = language(docs)
    return known, train(labelled_findings(docs, known, max_findings))


def scan(docs: DataFrame, known: Language, forest: Forest) -> DataFrame:
    """(doc_id, start, length, value, score, is_secret): every candidate of every whole text of (doc_id, path, text).

    ``start`` and ``length`` count code points from 0; a candidate whose score is below 0.5 is a false positive. Null
    and empty texts have no candidates; a null path counts as ''. Repeated rows give repeated findings.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "value", "score", "is_secret"]
        for batch in batches:
            rows, found = [], []
            for i, (path, text) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                for c in candidates(text.as_py()):
                    rows.append(i)
                    found.append((c, path.as_py()))
            score = _scores(found, *shared.value)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([c.start for c, _ in found], pa.int64()),
                    pa.array([len(c.value) for c, _ in found], pa.int64()),
                    pa.array([c.value for c, _ in found], pa.string()),
                    pa.array(score),
                    pa.array(score >= 0.5),
                ],
                names=names,
            )

    return _source(docs, [F.col("doc_id").cast("bigint")], "path").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, value string, score double, is_secret boolean"
    )


def redacted(
    docs: DataFrame, known: Language, forest: Forest, path: str = "path", mark: str = "[secret]"
) -> DataFrame:
    """The documents with every secret replaced by ``mark``; ``n_chars``, where there is one, counts the new text.

    Texts without secrets stay as they are, null ones too. ``path`` names the column that holds a row's path; all
    columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, forest))
    schema = docs.schema
    text_at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            paths = batch.column(batch.num_columns - 2).to_pylist()
            found = [(i, c) for i, t in enumerate(texts) if t for c in candidates(t)]
            score = _scores([(c, paths[i]) for i, c in found], *shared.value)
            changed = set()
            # From the last to the first, so that earlier places stay valid.
            for (i, c), s in reversed(list(zip(found, score, strict=True))):
                if s >= 0.5:
                    texts[i] = texts[i][: c.start] + mark + texts[i][c.start + len(c.value) :]
                    changed.add(i)
            columns = list(batch.columns[: len(schema.fields)])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if size_at is not None and changed:
                sizes = columns[size_at].to_pylist()
                for i in changed:
                    sizes[i] = len(texts[i])
                columns[size_at] = pa.array(sizes, columns[size_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _source(docs, docs.columns, path).mapInArrow(run, T.StructType(schema.fields))


def _source(docs: DataFrame, kept: list, path: str) -> DataFrame:
    return docs.select(
        *kept,
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"),
    )


def _scores(found: list[tuple[Candidate, str]], known: Language, forest: Forest) -> np.ndarray:
    if not found:
        return np.zeros(0)
    return forest.probability(np.array([row_features(c, path, known) for c, path in found]))
