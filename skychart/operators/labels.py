"""Cluster prompts and cluster labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.functions.markup import strip
from skychart.operators.mapstats import NOISE
from skychart.operators.ranking import running_total

# Text budgets in characters, and the instruction a labelling model is given.
MAX_SUMMARY = 256
MAX_PROMPT = 256 * 64
INSTRUCTION = (
    "Based on the following Python packages and their descriptions, "
    "provide a short, descriptive label (1-4 words) that captures the main theme or purpose of this group."
    "It will be used as a label for the group in a plot with multiple groups. Only return the label. \n\n"
)


def trim_summary(summary: Column, limit: int = MAX_SUMMARY) -> Column:
    return F.substring(F.coalesce(summary, F.lit("")), 1, limit)


def cluster_prompts(
    points: DataFrame, max_summary: int = MAX_SUMMARY, max_total: int = MAX_PROMPT
) -> DataFrame:
    """One prompt per cluster: a line per item, most used first, cut at the budget.

    A running sum of line lengths finds the lines that start inside the budget, so at most the
    budget's worth of text is ever gathered for a cluster of any size.
    """
    line = F.concat(
        F.lit("- "), F.coalesce("name", F.lit("")), F.lit(": "), trim_summary(F.col("summary"), max_summary)
    )
    lines = points.select("cluster_id", "weekly_downloads", "name", line.alias("line"))
    length = F.length("line") + 1
    placed = running_total(
        lines,
        [F.col("weekly_downloads").desc_nulls_last(), F.col("name").asc(), F.col("line").asc()],
        group=["cluster_id"],
        weight=length,
        out="start",
    )
    text = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("start") <= max_total, F.struct("start", "line")))),
            lambda l: l["line"],
        ),
        "\n",
    )
    gathered = placed.groupBy("cluster_id").agg(
        text.alias("text"), (F.sum(length) - 1).alias("total")
    )
    trimmed = F.when(F.col("total") <= max_total, F.col("text")).otherwise(
        F.concat(F.substring("text", 1, max_total), F.lit("..."))
    )
    return gathered.select("cluster_id", F.concat(F.lit(INSTRUCTION), trimmed).alias("prompt"))


def top_terms(points: DataFrame, terms: int = 3) -> DataFrame:
    """The shipped labeler: per cluster the words most typical of it against the other clusters.

    A word scores its count in the cluster times log(1 + words per cluster / its count overall).
    """
    words = F.filter(
        F.split(F.lower(F.concat_ws(" ", "name", "summary")), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1
    )
    counts = (
        points.select("cluster_id", F.explode(words).alias("word"))
        .groupBy("cluster_id", "word")
        .agg(F.count("*").alias("n"))
    )
    overall = counts.groupBy("word").agg(F.sum("n").alias("n_word"))
    average = counts.agg(F.sum("n") / F.countDistinct("cluster_id")).scalar()
    score = F.round(F.col("n") * F.log1p(average / F.col("n_word")), 6)
    best = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "word")
    return (
        counts.join(overall, "word")
        .withColumn("score", score)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= terms)
        .groupBy("cluster_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda t: t["word"]), " "
            ).alias("answer")
        )
    )


def cluster_labels(
    points: DataFrame, labeler: Callable[[DataFrame], DataFrame] = top_terms
) -> DataFrame:
    """One label per cluster: the labeler's answer, or a fallback where it gave none.

    ``labeler`` takes the clustered points and returns ``cluster_id, answer``.
    """
    clusters = points.select("cluster_id").distinct()
    answers = labeler(points.where(F.col("cluster_id") != NOISE))
    answer = strip(F.col("answer"))
    label = (
        F.when(F.col("cluster_id") == NOISE, "Not clustered")
        .when(answer != "", answer)
        .otherwise(F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string")))
    )
    return clusters.join(answers, "cluster_id", "left").select("cluster_id", label.alias("cluster_label"))
