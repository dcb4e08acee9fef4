"""Raking of token weights to target marginals, and sampling by the calibrated probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skychart.sources.workspace import Workspace

# The axes whose token shares are fixed.
AXES = ("source", "lang", "topic")
# Without given targets, a share is raised to this power, which lifts rare values.
TEMPERATURE = 0.8
# Raking ends after a round whose factors all lie this close to 1.
TOLERANCE = 1e-6
MAX_ROUNDS = 100
# Words that make a text "long" or "medium"; shorter ones are "short".
LONG, MEDIUM = 1000, 100


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words.cast("bigint")


def _occurrences(text: Column, character: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def topic(text: Column, tokens: Column) -> Column:
    """What a text is about by its form, where the table has no topics: tables, symbols, or prose by length."""
    text = F.coalesce(text, F.lit(""))
    marks = reduce(add, [_occurrences(text, c) for c in "#$%&*"])
    return (
        F.when(_occurrences(text, "|") * 5 > tokens, "table")
        .when(marks > tokens, "symbols")
        .when(tokens >= LONG, "long")
        .when(tokens >= MEDIUM, "medium")
        .otherwise("short")
    )


def with_axes(docs: DataFrame) -> DataFrame:
    """Add ``_tokens`` and one ``_<axis>`` column per axis; a null source or lang counts as the value ''.

    A table's own ``topic`` column is used where there is one, otherwise ``topic()``. Internal names start
    with an underscore and replace columns of the same name.
    """
    counted = docs.withColumn("_tokens", n_tokens(F.col("text")))
    given = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in AXES if c in docs.columns}
    given.setdefault("topic", topic(F.col("text"), F.col("_tokens")))
    return counted.withColumns({f"_{c}": given[c] for c in AXES})


def rake(
    cells: DataFrame,
    axes: Sequence[str],
    targets: Mapping[str, DataFrame],
    space: Workspace,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Iterative proportional fitting of ``weight`` in a cell table to the marginals ``targets[axis]``.

    ``targets[axis]`` has (axis, target), shares that sum to 1. One round scales the weights to each axis in
    turn; the table of cells is written after each round, which keeps the plan short. The fit ends when no
    factor of a round is off 1 by more than ``tolerance``, or after ``max_rounds`` where the targets
    contradict each other (then the last axis fits).
    """
    for _ in range(max_rounds):
        cells = cells.withColumn("_off", F.lit(0.0))
        for axis in axes:
            # Partial sums combine before the exchange, so a value with most cells is no hot key.
            sums = cells.groupBy(axis).agg(F.sum("weight").alias("_sum"))
            factor = sums.join(targets[axis], axis).select(axis, (F.col("target") / F.col("_sum")).alias("_factor"))
            cells = cells.join(factor, axis).withColumns(
                {
                    "weight": F.col("weight") * F.col("_factor"),
                    "_off": F.greatest("_off", F.abs(F.col("_factor") - 1)),
                }
            ).drop("_factor")
        cells = space.replace(cells, "cells")
        # The round's largest correction: what the marginals were off before it.
        off = cells.agg(F.max("_off").alias("off")).first()["off"] or 0.0
        cells = cells.drop("_off")
        if off <= tolerance:
            break
    return cells


def tempered(cells: DataFrame, axis: str, temperature: float) -> DataFrame:
    """Default target shares of an axis: token shares to the power of ``temperature``, scaled to sum 1."""
    powers = cells.groupBy(axis).agg(F.sum("_n").alias("_n")).select(axis, F.pow("_n", F.lit(temperature)).alias("_p"))
    total = powers.agg(F.sum("_p").alias("_all"))
    return powers.crossJoin(F.broadcast(total)).select(axis, (F.col("_p") / F.col("_all")).alias("target"))


def mixed(
    docs: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    temperature: float = TEMPERATURE,
    seed: str = "mix",
) -> DataFrame:
    """Add ``_tokens``, ``_source``, ``_lang``, ``_topic``, ``_ratio``, ``_probability``, ``_copies`` and ``_sampled``.

    Tokens are summed per (source, lang, topic); the sums are raked to the target marginals. ``_ratio`` is a
    document's calibrated token weight, its cell's raked share over its share of the tokens, and the copies expected of it:
    ``_copies`` is its whole part, and one more where a hash of seed and doc_id, uniform in [0, 1), lies below the rest. So the
    expected tokens are those of all documents, their expected shares meet the targets, and no cell changes how
    much is kept of another one of the same ratio. ``_probability`` that a document is in the sample at all is the ratio, at most 1.
    Equal ids are decided alike and any rerun gives the same sample. Rows without id are decided one by one, equal ones too:
    by their text and their place in the table, so the same as long as the table is read in the same parts.
    Texts without words carry no tokens: they keep the weight of their cell if it has tokens, else one copy.
    Targets for values that do not occur are ignored, and shares are rescaled; a value without target is dropped from the sample.
    """
    space = Workspace(docs.sparkSession)
    axes = [f"_{c}" for c in AXES]
    marked = with_axes(docs)
    cells = space.write(
        marked.groupBy(*axes).agg(F.sum("_tokens").alias("_n")).where("_n > 0"), "tokens"
    )
    total = cells.agg(F.sum("_n").alias("_total"))
    shares = cells.crossJoin(F.broadcast(total)).select(*axes, "_n", (F.col("_n") / F.col("_total")).alias("weight"))
    given = {}
    for c, axis in zip(AXES, axes, strict=True):
        if targets and c in targets:
            present = targets[c].select(F.col(c).alias(axis), "target").join(cells.select(axis).distinct(), axis)
            whole = present.agg(F.sum("target").alias("_all"))
            wanted = present.crossJoin(F.broadcast(whole)).select(axis, (F.col("target") / F.col("_all")).alias("target"))
        else:
            wanted = tempered(cells, axis, temperature)
        given[axis] = space.write(wanted, f"target{axis}")
    raked = rake(space.write(shares, "cells"), axes, given, space)
    ratios = space.write(
        raked.crossJoin(F.broadcast(total)).select(
            *axes, (F.col("weight") * F.col("_total") / F.col("_n")).alias("_ratio")
        ),
        "ratios",
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("_nameless")))
    uniform = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    place = F.concat_ws(":", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.monotonically_increasing_id().cast("string"))
    joined = marked.withColumn("_nameless", F.when(F.col("doc_id").isNull(), place)).join(ratios, axes, "left")
    dropped = F.lit(0.0) if targets else F.lit(1.0)
    expected = F.coalesce("_ratio", F.when(F.col("_tokens") > 0, dropped).otherwise(1.0))
    copies = F.floor(expected) + (uniform < expected - F.floor(expected)).cast("bigint")
    return (
        joined.withColumns({"_probability": F.least(expected, F.lit(1.0)), "_copies": copies})
        .withColumn("_sampled", F.col("_copies") > 0)
        .drop("_nameless")
    )


def sample(docs: DataFrame, repeats: bool = False, **options) -> DataFrame:
    """The sampled documents, with the columns of ``docs``: each once, or with ``repeats`` in as many rows as it has copies.

    Only with repeats do the token shares meet the targets; without, cells whose ratio is above 1 fall short.
    """
    chosen = mixed(docs, **options).where("_sampled")
    if repeats:
        chosen = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
    return chosen.select(*docs.columns)
