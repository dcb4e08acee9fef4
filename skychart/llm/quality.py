"""Document quality: classifier evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skychart.llm.words import WordHasher, slices, text_bytes
from skychart.sources.workspace import Workspace

# Labelled rows that the classifier is fitted on: those with the smallest hash of their id.
MAX_EXAMPLES = 20_000
FOLDS = 5
# Fewest and most documents that a prior may weigh.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
RIDGE, NEWTON_ROUNDS = 1.0, 25
# Probabilities are kept this far from 0 and 1.
EDGE = 1e-4

# Byte classes whose shares are features; bytes of other scripts count as letters.
_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": [*range(0x61, 0x7B), *range(0x80, 0x100)],
    "digit": range(0x30, 0x3A),
    "stop": [ord(c) for c in ".!?"],
    "comma": [ord(c) for c in ",;:"],
    "bar": [ord(c) for c in "|\t"],
    "mark": [ord(c) for c in "#$%&*+<=>@\\^_`{}~[]"],
    "line": [0x0A],
}
FEATURES = (*_CLASSES, "log_words", "word_length", "distinct", "repeated_lines")


def features(values: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """One row per text; an empty text has zeros only."""
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for low, high in slices(offsets):
        bounds = offsets[low : high + 1]
        data, at = values[bounds[0] : bounds[-1]], bounds - bounds[0]
        size = np.maximum(np.diff(at), 1)
        for j, members in enumerate(_CLASSES.values()):
            marked = np.zeros(256, dtype=np.int64)
            marked[list(members)] = 1
            total = np.concatenate([[0], np.cumsum(marked[data])])
            out[low:high, j] = np.diff(total[at]) / size
        hashes, _, counts = hasher(values, bounds)
        ends = np.cumsum(counts)
        distinct = [len(np.unique(hashes[a:b])) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        lines = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts = data[a:b].tobytes().split(b"\n")
            lines.append(1.0 - len(set(parts)) / len(parts))
        some = np.maximum(counts, 1)
        j = len(_CLASSES)
        out[low:high, j] = np.log1p(counts) / 10
        out[low:high, j + 1] = np.minimum(np.diff(at) / some, 50) / 10
        out[low:high, j + 2] = np.array(distinct) / some
        out[low:high, j + 3] = lines
    return out


@dataclass
class Classifier:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.centre) / self.spread, np.ones(len(x))]) @ self.weights
        return np.clip(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))), EDGE, 1 - EDGE)


def is_held_out(doc_id):
    """The fold of ids that never trains; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Classifier:
    """Logistic regression on at most ``max_examples`` labelled documents outside the held-out fold.

    Ids labelled twice are good only if all their labels say so. Without labels every document gets 0.5, with
    labels of one kind only the smoothed share of that kind.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_examples)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            x = features(*text_bytes(batch.column(0)), hasher)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(FEATURES))], batch.column(1)],
                names=[*FEATURES, "quality"],
            )

    rows = (
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        # At most max_examples rows of two numbers.
        .join(F.broadcast(chosen), "doc_id")
        .select("text", "quality")
        .mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", quality int")
        .toArrow()
    )
    x = np.column_stack([rows.column(f).to_numpy() for f in FEATURES])
    y = rows.column("quality").to_numpy().astype(float)
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    spread = np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0) if len(x) else np.ones(x.shape[1])
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.append(np.full(z.shape[1] - 1, RIDGE), 1e-3)
    for _ in range(NEWTON_ROUNDS if len(x) else 0):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(centre, spread, w)


def evidence(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, host, path, evidence): the classifier's probability from each whole text; null host or path count as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            p = model.probability(features(*text_bytes(batch.column(3)), hasher))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p)], names=["doc_id", "host", "path", "evidence"])

    source = docs.select(
        F.col("doc_id").cast("bigint"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("host", "path")],
        F.col("text").cast("string"),
    )
    return source.mapInArrow(run, "doc_id bigint, host string, path string, evidence double")


def _prior_weight(groups: DataFrame, mean: str, within: float) -> float:
    """How many documents the level above weighs, from how far the groups' means differ (method of moments).

    The variance of a group's mean is the variance between groups plus ``within`` / n; what the first explains
    decides the weight, within / between.
    """
    w = F.col("n").cast("double")
    found = groups.agg(
        F.sum(w).alias("n"),
        F.sum(w * w).alias("n2"),
        F.count("*").alias("groups"),
        F.sum(w * F.pow(F.col("total") / w - F.col(mean), F.lit(2))).alias("ss"),
    ).first()
    if not found["n"] or found["groups"] < 2:
        return MOST_WEIGHT
    effective = found["n"] - found["n2"] / found["n"]
    between = (found["ss"] - (found["groups"] - 1) * within) / effective if effective > 0 else 0.0
    if between <= 0:
        return MOST_WEIGHT
    return float(min(MOST_WEIGHT, max(LEAST_WEIGHT, within / between)))


def judged(docs: DataFrame, model: Classifier) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, score, keep) of every row of (doc_id, host, path, text).

    Means of the evidence are pulled together level by level: a host's towards the global mean, a path's
    towards its host's, each by a number of documents estimated from the data, so sparse sites hardly leave
    the level above. A document's score combines its own evidence, as a likelihood ratio against the global mean, with
    its path's posterior as prior; its own evidence is taken out of its path's sum first. ``keep`` is score >= 0.5.

    Sums combine before they are exchanged, and a site's row is joined to its documents' numbers, not to their
    texts. Repeated rows count as often as they occur. An empty table gives no rows.
    """
    space = Workspace(docs.sparkSession)
    rows = space.write(evidence(docs, model), "evidence")
    paths = rows.groupBy("host", "path").agg(F.sum("evidence").alias("total"), F.count("*").alias("n"))
    paths = space.write(paths, "paths")
    whole = rows.agg(F.avg("evidence").alias("mean"), F.var_pop("evidence").alias("spread")).first()
    mean = whole["mean"] if whole["mean"] is not None else 0.5
    within = max(whole["spread"] or 0.0, 1e-9)
    hosts = paths.groupBy("host").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).withColumn("mean", F.lit(mean))
    k_host = _prior_weight(hosts, "mean", within)
    hosts = hosts.select(
        "host", ((F.col("total") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior")
    )
    hosts = space.write(hosts, "hosts")
    sites = paths.join(hosts, "host")
    k_path = _prior_weight(sites, "host_posterior", within)
    joined = rows.join(sites, ["host", "path"])
    prior = F.col("host_posterior")
    others = (F.col("total") - F.col("evidence") + k_path * prior) / (F.col("n") - 1 + k_path)

    def logit(p):
        p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
        return F.log(p / (1 - p))

    z = logit(F.col("evidence")) - logit(F.lit(mean)) + logit(others)
    score = 1 / (1 + F.exp(-z))
    return joined.select(
        "doc_id",
        "evidence",
        "host_posterior",
        ((F.col("total") + k_path * prior) / (F.col("n") + k_path)).alias("path_posterior"),
        score.alias("score"),
        (score >= 0.5).alias("keep"),
    )
