"""A hidden Markov language model over words, trained by Baum-Welch counts summed across partitions.

Each token is a word (a run of characters other than ASCII white space, A-Z lower-cased) or the end of its text. The
base model gives a token w that occurs c times among N training tokens, V of them distinct, the probability
P0(w) = (c + 1) / (N + V + 1); all unknown words share 1 / (N + V + 1). A state s gives it
P0(w) x P(class(w) | s) / P0(class(w)), where the classes are ``1 << CLASS_BITS`` hash groups of words and
one for the end; unknown words have the same probability in every state. So the parameters have
a fixed size whatever the vocabulary, and a state's probabilities still sum to 1 over all words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychart.llm.words import WordHasher, mix, slices, text_bytes
from skychart.sources.workspace import Workspace

STATES, CLASS_BITS = 8, 15
CLASSES = 1 << CLASS_BITS
END_CLASS, UNKNOWN = CLASSES, CLASSES + 1
END_HASH = mix(np.array([0x454E44], dtype=np.uint64))[0]
# Rounds of training, each over all training texts.
ROUNDS = 4
# In training, long texts are cut into runs of so many tokens; a later run starts from the states' overall shares.
RUN_TOKENS = 256
RUNS_AT_ONCE = 1024
# Texts that are scored in step.
TEXTS_AT_ONCE = 4096
# Bytes of text handled at once in training, and in one block of scoring.
PART_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
# Distinct words a task gathers before it passes their counts on.
GATHERED = 1 << 20
# Texts of this remainder are never learned from.
FOLDS, HELD_OUT = 7, 2


def is_held_out(doc_id: Column) -> Column:
    """Whether an id's text is kept out of training; a null id's is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Model:
    """Start and transition probabilities, overall state shares, and class ratios P(class | s) / P0(class)."""

    start: np.ndarray
    move: np.ndarray
    share: np.ndarray
    ratio: np.ndarray


def classes_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def with_ends(hashes: np.ndarray, counts: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Insert ``end`` after each text; the new values and the place where each text starts."""
    stops = np.cumsum(counts)
    values = np.insert(hashes, stops, end)
    return values, stops - counts + np.arange(len(counts))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): occurrences of every token, by hash, over the texts of (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = WordHasher(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            sums = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]))
            return words, sums.astype(np.int64)

        def out(words: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(words), 1 << 16):
                part = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[part].view(np.int64)), pa.array(sums[part])], names=["h", "c"]
                )

        for batch in batches:
            values, offsets = text_bytes(batch.column(0))
            for low, high in slices(offsets):
                hashes, _, _ = hasher(values, offsets[low : high + 1])
                words, sums = np.unique(hashes, return_counts=True)
                parts += [(words, sums), (np.array([END_HASH]), np.array([high - low]))]
                held += len(words) + 1
                if held >= 2 * GATHERED:
                    parts = [merged()]
                    held = len(parts[0][0])
                    if held >= GATHERED:
                        yield from out(*parts.pop())
                        held = 0
        if parts:
            yield from out(*merged())

    return docs.select(F.col("text")).mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def _expected(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, fresh: np.ndarray, model: Model, sums: dict) -> None:
    """Add the expected counts of some token runs: scaled forward and backward recursions, all runs in step."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, fresh = starts[order], lengths[order], fresh[order]
    steps = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")
    alpha, ratio, scale = [], [], []
    for t in range(steps):
        n = alive[t]
        r = model.ratio[classes[starts[:n] + t]]
        a = (alpha[-1][:n] @ model.move if t else np.where(fresh[:, None], model.start, model.share)) * r
        c = a.sum(axis=1, keepdims=True)
        alpha.append(a / c)
        ratio.append(r)
        scale.append(c)
        sums["loglik"] += float(np.log(c).sum())
    beta = np.ones((0, model.move.shape[0]))
    gamma = [np.zeros(0)] * steps
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        b = np.ones((n, model.move.shape[0]))
        b[: len(beta)] = beta
        gamma[t] = alpha[t] * b
        message = ratio[t] * b / scale[t]
        if t:
            sums["move"] += alpha[t - 1][:n].T @ message
            beta = message @ model.move.T
    sums["start"] += gamma[0][fresh].sum(axis=0)
    tokens = np.concatenate([classes[starts[: alive[t]] + t] for t in range(steps)])
    every = np.concatenate(gamma)
    for s in range(every.shape[1]):
        sums["class"][:, s] += np.bincount(tokens, weights=every[:, s], minlength=CLASSES + 1)


def expected_counts(docs: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected class, transition and start counts over the texts of (text).

    A task adds up its own counts, a table of fixed size; the driver gets their sum.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)
    names = [f"s{i}" for i in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hasher = shared.value, WordHasher()
        sums = {
            "class": np.zeros((CLASSES + 1, states)),
            "move": np.zeros((states, states)),
            "start": np.zeros(states),
            "loglik": 0.0,
        }
        for batch in batches:
            values, offsets = text_bytes(batch.column(0))
            for low, high in slices(offsets, PART_BYTES):
                hashes, _, counts = hasher(values, offsets[low : high + 1])
                tokens, begin = with_ends(classes_of(hashes), counts, END_CLASS)
                pieces = -(-(counts + 1) // RUN_TOKENS)
                first = np.cumsum(pieces) - pieces
                number = np.arange(pieces.sum()) - np.repeat(first, pieces)
                starts = np.repeat(begin, pieces) + number * RUN_TOKENS
                lengths = np.minimum(np.repeat(begin + counts + 1, pieces) - starts, RUN_TOKENS)
                # Some runs at a time: their states take about 100 bytes a token, four times over.
                for at in range(0, len(starts), RUNS_AT_ONCE):
                    part = slice(at, at + RUNS_AT_ONCE)
                    _expected(tokens, starts[part], lengths[part], number[part] == 0, model, sums)
        move = sums["move"] * model.move
        table = np.vstack([sums["class"], move, sums["start"][None, :]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(table))), *[pa.array(np.ascontiguousarray(table[:, s])) for s in range(states)]],
            names=["row", *names],
        )

    schema = "row bigint, " + ", ".join(f"{s} double" for s in names)
    found = (
        docs.select("text")
        .mapInArrow(run, schema)
        .groupBy("row")
        .agg(*[F.sum(s).alias(s) for s in names])
        .toArrow()
    )
    table = np.zeros((CLASSES + 1 + states + 1, states))
    table[found.column("row").to_numpy()] = np.column_stack([found.column(s).to_numpy() for s in names])
    return table[: CLASSES + 1], table[CLASSES + 1 : -1], table[-1]


def improved(counts: tuple[np.ndarray, np.ndarray, np.ndarray], base: np.ndarray) -> Model:
    """The next model: expected counts, smoothed by one count a class on the whole, in proportion to the base."""
    by_class, moves, starts = counts
    states = len(starts)
    weight = float(len(base))
    emitted = (by_class + weight * base[:, None] / base.sum()) / (by_class.sum(axis=0) + weight)
    ratio = np.ones((CLASSES + 2, states))
    used = base > 0
    # Known words have the mass base.sum() in every state; unknown ones keep theirs.
    ratio[: CLASSES + 1][used] = emitted[used] * base.sum() / base[used, None]
    move = (moves + 1.0) / (moves + 1.0).sum(axis=1, keepdims=True)
    start = (starts + 1.0) / (starts + 1.0).sum()
    share = (by_class.sum(axis=0) + 1.0) / (by_class.sum() + states)
    return Model(start, move, share, ratio)


def first_model(states: int) -> Model:
    """Lasting states with slightly different words, the same in every run."""
    random = np.random.default_rng(7)
    ratio = np.ones((CLASSES + 2, states))
    ratio[:CLASSES] += random.uniform(-0.5, 0.5, (CLASSES, states))
    even = np.full(states, 1.0 / states)
    return Model(even, 0.9 * np.eye(states) + 0.1 / states, even, ratio)


@dataclass
class Trained:
    model: Model
    vocabulary: DataFrame
    tokens: int
    distinct: int


def train(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> Trained:
    """Learn from all texts of (doc_id, text); every one counts in the vocabulary and in every round."""
    space = Workspace(docs.sparkSession)
    vocabulary = space.write(word_counts(docs), "vocabulary")
    total = vocabulary.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count("*").alias("v"),
    ).first()
    n, v = total["n"], total["v"]
    by_class = F.when(F.col("h") == _end(), END_CLASS).otherwise(F.shiftrightunsigned("h", 64 - CLASS_BITS))
    mass = vocabulary.groupBy(by_class.alias("class")).agg(F.sum(F.col("c") + 1).alias("m")).toArrow()
    base = np.zeros(CLASSES + 1)
    base[mass.column("class").to_numpy()] = mass.column("m").to_numpy() / (n + v + 1)
    model = first_model(states)
    if not n:
        return Trained(model, vocabulary, 0, 0)
    for _ in range(rounds):
        model = improved(expected_counts(docs, model), base)
    return Trained(model, vocabulary, n, v)


def _end() -> Column:
    return F.lit(int(np.array([END_HASH]).view(np.int64)[0]))


def _numbered(docs: DataFrame) -> DataFrame:
    """The texts as numbers into word lists, one list for each block of about ``BLOCK_BYTES`` of a task's text.

    Kind 0: an entry of a block's list (place, h). Kind 1: a document with the places of its tokens.
    Lists are far shorter than the texts, so looking them up needs little to be exchanged.
    """
    names = ["block", "kind", "place", "h", "doc_id", "held_out", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, number = WordHasher(), TaskContext.get().partitionId() << 32
        pending: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            words = np.unique(np.concatenate([p[0] for p in pending]))
            for low in range(0, len(words), 1 << 16):
                part = words[low : low + (1 << 16)]
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number)),
                        pa.array(np.zeros(n, np.int32)),
                        pa.array(np.arange(low, low + n)),
                        pa.array(part.view(np.int64)),
                        pa.nulls(n, pa.int64()),
                        pa.nulls(n, pa.bool_()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names=names,
                )
            for hashes, begin, ids, flags in pending:
                places = np.searchsorted(words, hashes).astype("<u4")
                n = len(begin)
                ends = np.append(begin[1:], len(hashes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number)),
                        pa.array(np.ones(n, np.int32)),
                        pa.array(np.arange(n)),
                        pa.nulls(n, pa.int64()),
                        ids,
                        flags,
                        pa.array([places[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=names,
                )

        for batch in batches:
            values, offsets = text_bytes(batch.column(2))
            for low, high in slices(offsets, PART_BYTES):
                hashes, _, counts = hasher(values, offsets[low : high + 1])
                tokens, begin = with_ends(hashes, counts, END_HASH)
                pending.append((tokens, begin, batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)))
                size += int(offsets[high] - offsets[low])
                if size >= BLOCK_BYTES:
                    yield from out()
                    pending, size, number = [], 0, number + 1
        if pending:
            yield from out()

    schema = "block bigint, kind int, place bigint, h bigint, doc_id bigint, held_out boolean, tokens binary"
    return docs.mapInArrow(run, schema)


def forward(classes: np.ndarray, begin: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 of the likelihood ratio to the base model of each token sequence, by the scaled forward recursion."""
    order = np.argsort(-lengths, kind="stable")
    start, left = begin[order], lengths[order]
    total = np.zeros(len(order))
    alive = np.searchsorted(-left, -np.arange(int(left[0])), side="left") if len(left) else []
    alpha = None
    for t, n in enumerate(alive):
        r = model.ratio[classes[start[:n] + t]]
        alpha = (alpha[:n] @ model.move if t else model.start) * r
        scale = alpha.sum(axis=1)
        total[:n] += np.log10(scale)
        alpha = alpha / scale[:, None]
    out = np.zeros(len(order))
    out[order] = total
    return out


def scored(docs: DataFrame, trained: Trained) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every row of (doc_id, held_out, text).

    A null or empty text is its end token. Scores are log10 probabilities of whole texts. Without any training text
    every token has probability 1 under both models.
    """
    space = Workspace(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("bigint"), "held_out", F.coalesce("text", F.lit("")))
    numbered = space.write(_numbered(source), "numbered")
    entries = (
        numbered.where("kind = 0")
        .join(trained.vocabulary, "h", "left")
        .select("block", "kind", "place", "h", F.coalesce("c", F.lit(0)).alias("c"))
    )
    texts = numbered.where("kind = 1").drop("h")
    rows = entries.unionByName(texts, allowMissingColumns=True)
    rows = rows.select("block", "kind", "place", "h", "c", "doc_id", "held_out", "tokens")
    dealt = rows.repartition("block").sortWithinPartitions("block", "kind", "place")
    shared = docs.sparkSession.sparkContext.broadcast(trained.model)
    tokens = trained.tokens
    whole = tokens + trained.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block, parts, logs, classes, known = shared.value, None, [], None, None, None

        def texts_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            places = [np.frombuffer(x, "<u4") for x in batch.column("tokens").to_pylist()]
            lengths = np.array([len(p) for p in places], dtype=np.int64)
            begin = np.cumsum(lengths) - lengths
            flat = np.concatenate(places)
            base = np.add.reduceat(logs[flat], begin)
            gain = forward(classes[flat], begin, lengths, model) if tokens else np.zeros(len(lengths))
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(lengths),
                    pa.array(np.add.reduceat(known[flat], begin)),
                    pa.array(base),
                    pa.array(base + gain),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            cuts = [0, *change.tolist(), len(blocks)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(low, high - low)
                if kinds[low] == 0:
                    if blocks[low] != block:
                        block, parts = blocks[low], []
                    parts.append((part.column("h").to_numpy(), part.column("c").to_numpy()))
                    logs = None
                    continue
                if logs is None:
                    h = np.concatenate([p[0] for p in parts])
                    c = np.concatenate([p[1] for p in parts])
                    parts = []
                    logs = np.log10((c + 1) / whole) if tokens else np.zeros(len(c))
                    known = (c > 0).astype(np.int64)
                    classes = classes_of(h.view(np.uint64))
                    classes[h.view(np.uint64) == END_HASH] = END_CLASS
                    classes[c == 0] = UNKNOWN
                for at in range(0, part.num_rows, TEXTS_AT_ONCE):
                    yield texts_of(part.slice(at, TEXTS_AT_ONCE))

    return dealt.mapInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    )


def learned_and_scored(docs: DataFrame) -> DataFrame:
    """Train on the texts outside the held-out fold, score all."""
    marked = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    trained = train(marked.where("not held_out").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return scored(marked, trained).withColumn("train_tokens", F.lit(trained.tokens).cast("bigint"))
