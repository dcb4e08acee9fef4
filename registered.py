"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skychart import schemas
from skychart.functions import markup, scaling, text, vectors
from skychart.operators import (
    clean,
    constellations,
    density,
    descent,
    embed,
    graph,
    knn,
    labels,
    layout,
    mapstats,
    outputs,
    ranking,
    recent,
    search,
    spatial,
)
from skychart.operators.spread import spread
from skychart.plans import pipeline
from skychart.sources import files
from skychart.sources.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


# --- views over the tables -------------------------------------------------------------------


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Usage events, a user's clicks under a second spelling of the key."""
    click = F.when(F.col("event_type") == "click", "U").otherwise("u")
    return table(spark, d, "events").select(
        F.col("ts").alias("timestamp"), F.concat(click, F.col("user_id").cast("string")).alias("project")
    )


def metadata(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("event_type") == "click", "U").otherwise("u"), F.col("user_id").cast("string"))
    return table(spark, d, "events").select(
        name.alias("name"),
        F.col("props").alias("description"),
        F.lit("text/plain").alias("description_content_type"),
        F.col("event_type").alias("summary"),
        F.col("event_id").cast("string").alias("version"),
        F.col("ts").alias("upload_time"),
    )


def raw_parts(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows with repeated names, tied downloads and nulls in either or both texts."""
    size = F.col("p_size")
    return table(spark, d, "part").select(
        F.col("p_name").alias("name"),
        F.when(size % 7 != 0, F.col("p_type")).alias("description"),
        F.when(size % 2 == 0, F.lit("text/markdown")).alias("description_content_type"),
        F.when(size % 5 != 0, F.col("p_brand")).alias("summary"),
        F.col("p_partkey").cast("string").alias("latest_version"),
        (size * 100).cast("string").alias("number_of_downloads"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as map points: usage from lineitem, summary from part, label 9 as noise."""
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("weekly_downloads"))
    e = table(spark, d, "embeddings")
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("summary"))
    return (
        e.join(used, e["vec_id"] == used["l_partkey"], "left")
        .join(part, e["vec_id"] == part["p_partkey"], "left")
        .select(
            F.col("vec_id").alias("id"),
            F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"),
            "summary",
            "weekly_downloads",
            F.col("embedding")[0].cast("double").alias("x"),
            F.col("embedding")[1].cast("double").alias("y"),
            F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster_id"),
        )
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    """Customers as map points: usage is their orders, nation 24 is noise."""
    spent = (
        table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(F.count("*").alias("weekly_downloads"), (F.max("o_totalprice") / 131072).alias("y"))
    )
    c = table(spark, d, "customer")
    return c.join(spent, c["c_custkey"] == spent["o_custkey"], "left").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("summary"),
        "weekly_downloads",
        (F.col("c_acctbal") / 1000).alias("x"),
        F.coalesce("y", F.lit(0.0)).alias("y"),
        F.when(F.col("c_nationkey") == 24, -1).otherwise(F.col("c_nationkey")).alias("cluster_id"),
    )


def place_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.cluster_metadata(places(spark, d))


def views(spark: SparkSession, d: str) -> DataFrame:
    """One viewport per supplier, of sizes and zooms spread over all rules."""
    key = F.col("s_suppkey")
    x, y = F.col("s_acctbal") / 1000, (key % 50) / 10
    width, height = F.lit(0.05) * (1 + key % 40), F.lit(0.04) * (1 + key % 30)
    return table(spark, d, "supplier").select(
        key.alias("view_id"),
        x.alias("min_x"),
        (x + width).alias("max_x"),
        y.alias("min_y"),
        (y + height).alias("max_y"),
        (key % 24 + 1.0).alias("zoom"),
        (key % 3 == 0).alias("mobile"),
    )


def picks(spark: SparkSession, d: str) -> DataFrame:
    """One pick position per supplier: near the map, some with a radius too small to hit."""
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        key.alias("query_id"),
        (F.col("s_acctbal") / 1000).alias("x"),
        ((key % 50) / 10).alias("y"),
        (F.lit(0.02) * (1 + key % 25)).alias("radius"),
    )


def selected(spark: SparkSession, d: str) -> DataFrame:
    """The clusters switched on: three of four nations."""
    return table(spark, d, "nation").where("n_nationkey % 4 != 1").select(
        F.col("n_nationkey").alias("cluster_id")
    )


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with markup written around them, by turns of the id."""
    doc, body = F.col("doc_id").cast("string"), F.col("text")
    markdown = F.concat(
        F.lit("# Guide "), doc,
        F.lit("\n\nSome **strong** text, [a link](https://example.com/"), doc,
        F.lit(") and ![badge](b.png).\n\n```\ncode = 1\n```\n\n- first\n- second\n\n"), body,
    )
    rst = F.concat(
        F.lit("Guide "), doc,
        F.lit(
            "\n=======\n\n.. note::\n\n   Mind the gap.\n\n:author: someone\n:date: today\n\n"
            "See `the docs <https://example.com>`_ and ``code``.\n\n"
        ), body,
    )
    both = F.concat(F.lit("# Überschrift\n\n.. image:: logo.png\n\n"), body)
    turn = F.col("doc_id") % 4
    declared = F.when(F.col("doc_id") % 7 == 0, "text/x-rst").when(
        F.col("doc_id") % 7 == 1, "Text/Markdown; charset=UTF-8"
    ).when(F.col("doc_id") % 7 == 2, "text/plain").when(F.col("doc_id") % 7 == 3, "")
    return spread(table(spark, d, "documents")).select(
        "doc_id",
        F.when(turn == 0, markdown).when(turn == 1, rst).when(turn == 2, body).otherwise(both).alias("description"),
        declared.alias("declared"),
    )


def planted(spark: SparkSession, d: str, width: float = 0.005) -> DataFrame:
    """Vectors pulled towards a corner of their own per label, so that every label is a dense group."""
    corner = F.transform(
        F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0)
    )
    near = F.transform("embedding", lambda v: v.cast("double") * width)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.zip_with(corner, near, lambda a, b: a + b).alias("vec")
    )


def halved(spark: SparkSession, d: str) -> DataFrame:
    """The planted groups, each in two dense halves at a distance of 0.3; some vectors lie alone and far away."""
    odd, alone = F.col("id") % 2 == 1, F.col("id") % 50 == 7

    def place(v: Column, i: Column) -> Column:
        far = F.when(i == 63, 5.0 * (1 + F.col("id"))).otherwise(0.0)
        return F.when(alone, far).otherwise(v + F.when(odd & (i == 10 + F.col("label")), 0.3).otherwise(0.0))

    return planted(spark, d).select("id", "label", F.transform("vec", place).alias("vec"))


def vectors_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def neighbor_table(spark: SparkSession, d: str, k: int) -> DataFrame:
    return Workspace(spark).write(knn.knn_exact(vectors_table(spark, d), k), "knn")


# --- recent usage and cleaning ---------------------------------------------------------------


@query
def recent_counts(spark: SparkSession, d: str) -> DataFrame:
    return recent.recent_counts(facts(spark, d), min_count=2)


@query
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return recent.latest_per_key(metadata(spark, d)).select(
        "name_lower", "name", "description", "summary", "version"
    )


@query
def popular_items(spark: SparkSession, d: str) -> DataFrame:
    return recent.popular_items(facts(spark, d), metadata(spark, d), min_count=2)


@query
def cast_rename(spark: SparkSession, d: str) -> DataFrame:
    return clean.cast_rename(raw_parts(spark, d))


@query
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.distinct_rows(clean.cast_rename(raw_parts(spark, d)))


@query
def null_rules(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_null_text(clean.drop_all_null(raw_parts(spark, d)))


@query
def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    return clean.read_raw(raw_parts(spark, d))


@query
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return clean.top_n(clean.read_raw(raw_parts(spark, d)), 40)


@query
def sort_by_downloads(spark: SparkSession, d: str) -> DataFrame:
    return clean.sort_by_downloads(points(spark, d), limit=25).select("name", "weekly_downloads")


@query
def fill_null_downloads(spark: SparkSession, d: str) -> DataFrame:
    return clean.fill_null_downloads(points(spark, d)).select("id", "weekly_downloads")


@query
def combine_text(spark: SparkSession, d: str) -> DataFrame:
    rows = raw_parts(spark, d).select(
        F.col("latest_version").alias("id"), "summary", F.col("description").alias("description_cleaned")
    )
    return clean.combine_text(rows).select("id", "summary_and_description_cleaned")


@query
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).where(F.col("cluster_id") == 7).select("id", "name", "weekly_downloads")


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents with line breaks and quotes through a CSV file."""
    path = f"{Workspace(spark).folder}/csv"
    files.write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    written = schemas.schema("doc_id BIGINT, text STRING, lang STRING")
    return files.scan_csv(spark, path, written, ["doc_id", "text"])


@query
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The packages record set written as JSON Lines and read back."""
    path = f"{Workspace(spark).folder}/packages.json"
    files.write_json(outputs.packages_output(places(spark, d)), path)
    return files.scan_json(spark, path, schemas.PACKAGES_JSON)


@query
def parquet_columns(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Workspace(spark).folder}/parquet"
    files.write_parquet(places(spark, d), path)
    files.write_parquet(places(spark, d).limit(0), path, overwrite=False)
    return files.scan_parquet(spark, path, ["id", "cluster_id"])


# --- markup and text -------------------------------------------------------------------------


@query
def content_type_meta(spark: SparkSession, d: str) -> DataFrame:
    return marked_documents(spark, d).select(
        "doc_id", markup.content_type_from_metadata(F.coalesce("declared", F.lit(""))).alias("kind")
    )


@query
def content_type_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return marked_documents(spark, d).select(
        "doc_id", markup.content_type(F.col("description"), F.col("declared")).alias("kind")
    )


@query
def rst_score(spark: SparkSession, d: str) -> DataFrame:
    return marked_documents(spark, d).select("doc_id", markup.rst_score(F.col("description")).alias("score"))


@query
def markdown_score(spark: SparkSession, d: str) -> DataFrame:
    return marked_documents(spark, d).select(
        "doc_id", markup.markdown_score(F.col("description")).alias("score")
    )


@query
def extract_text_html(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "pages")).select("page_id", text.extract_html(F.col("html")).alias("extracted"))


def plain_body() -> Column:
    """A whole text as letters, digits, full stops and blanks: what no markup touches."""
    return F.regexp_replace("text", r"[^\p{L}\p{N}. \n]", " ")


@query
def extract_text_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text inside known markup, so that the plain text is known too."""
    doc = F.col("doc_id").cast("string")
    source = F.concat(
        F.lit("# Guide "), doc, F.lit(" ##\n\nSome **strong** text, [a link](https://example.com/"), doc,
        F.lit(
            ") &amp; ![badge](b.png).\n\n```\ncode = *1*\n```\n\n- first\n- [x] second\n\n***\n\n> > quoted &eacute;&#x41;\n\n"
            "| a | b |\n|---|:-:|\n| 1 | 2 |\n\n<!-- hidden -->\n\nTitle\n-----\n"
        ), plain_body(),
    )
    rows = spread(table(spark, d, "documents"))
    return rows.select("doc_id", text.extract_markdown(source).alias("extracted"))


@query
def extract_text_rst(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text inside known markup, so that the plain text is known too."""
    source = F.concat(
        F.lit("Guide "), F.col("doc_id").cast("string"),
        F.lit(
            "\n=======\n\n.. image:: a.png\n   :alt: x\n   :width: 3\n\n.. note::\n\n   Mind the gap.\n\n:author: someone\n"
            ":date: today\n\n.. _target: http://example.com\n\nSee `the docs <https://example.com>`_ and :py:func:`call`, ``code``.\n\n"
            "* **one**\n* *two*\n\n+---+---+\n\nCode::\n\n"
        ), plain_body(),
    )
    rows = spread(table(spark, d, "documents"))
    return rows.select("doc_id", text.extract_rst(source).alias("extracted"))


def _words_in_markup(kinds: list[Callable[[Column], Column]]) -> Column:
    """All lower-case words of a text, each in its kind of markup by turns."""

    def one(word: Column, i: Column) -> Column:
        marked = kinds[0](word)
        for k, kind in enumerate(kinds[1:], 1):
            marked = F.when(i % len(kinds) == k, kind(word)).otherwise(marked)
        return marked

    return F.array_join(F.transform(F.regexp_extract_all("text", F.lit("[a-z]+"), 0), one), " ")


def _around(pattern: str) -> Callable[[Column], Column]:
    """The pattern with the word in place of each W."""
    parts = pattern.split("W")
    return lambda word: F.concat(*[x for part in parts[:-1] for x in (F.lit(part), word)], F.lit(parts[-1]))


# Markup around every word, and what is left of it: a bar stands between two text nodes.
NESTED_MARKDOWN = {
    "**W *W* W**": "|W|W|W|", "[W](http://x.org/a_(W))": "|W|", "``W ` W``": "|W ` W|", "W": "W", "__W ~~W~~__": "|W|W|", "[W][Ref]": "|W|",
    '<a title="W > W">W</a>': "|W|", r"\*W\*": "*W*", "[W][none]": "[W][none]",
}
NESTED_RST = {
    "**W * W**": "|W * W|", "|Ver|": "1.0 beta", ":a:`W <W>`": "|W|", "W": "W", "``W *W``": "|W *W|", "`W`_": "|W|", "*W*": "|W|",
}


@query
def extract_text_nested_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents with nested markup around each of their words, references among it."""
    source = F.concat(_words_in_markup([_around(p) for p in NESTED_MARKDOWN]), F.lit("\n\n[ref]: http://x.org\n"))
    return spread(table(spark, d, "documents")).select("doc_id", text.extract_markdown(source).alias("extracted"))


@query
def extract_text_nested_rst(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a comment, a substitution and markup around each of their words."""
    head = F.lit(".. hidden\n   more hidden\n\n.. |ver| replace:: 1.0 beta\n\n")
    source = F.concat(head, _words_in_markup([_around(p) for p in NESTED_RST]))
    return spread(table(spark, d, "documents")).select("doc_id", text.extract_rst(source).alias("extracted"))


@query
def extract_text_plain(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(
        "doc_id", text.extract_text(F.col("text"), F.lit("plain")).alias("extracted")
    )


# --- map statistics --------------------------------------------------------------------------


@query
def cluster_metadata(spark: SparkSession, d: str) -> DataFrame:
    rounded = ("centroid_x", "centroid_y", "min_x", "max_x", "min_y", "max_y")
    return place_clusters(spark, d).withColumns({c: r6(c) for c in rounded})


@query
def distinct_clusters(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.distinct_clusters(points(spark, d))


@query
def exclude_noise(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.exclude_noise(points(spark, d)).select("id", "cluster_id")


@query
def data_bounds(spark: SparkSession, d: str) -> DataFrame:
    bounds = mapstats.data_bounds(places(spark, d))
    return bounds.select(*[r6(c).alias(c) for c in bounds.columns])


@query
def download_range(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.download_range(places(spark, d))


@query
def run_stats(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.run_stats(places(spark, d))


@query
def median_center(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.median_center(places(spark, d)).select(r6("x").alias("x"), r6("y").alias("y"))


@query
def log_radius_scale(spark: SparkSession, d: str) -> DataFrame:
    return mapstats.log_radius_scale(places(spark, d)).select("id", r6("x").alias("x"), r6("y").alias("y"))


@query
def labeled_plot(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("cluster_label")
    )
    plot = mapstats.labeled_plot_table(places(spark, d), named)
    return plot.select("id", "cluster_id", "cluster_label", "weekly_downloads", r6("size").alias("size"))


@query
def unlabeled_plot(spark: SparkSession, d: str) -> DataFrame:
    plot = mapstats.unlabeled_plot_table(points(spark, d))
    return plot.select("id", "cluster_id", "weekly_downloads", r6("size").alias("size"))


@query
def point_size(spark: SparkSession, d: str) -> DataFrame:
    sized = mapstats.point_sizes(clean.fill_null_downloads(places(spark, d)), gamma=1.5)
    return sized.select("id", r6("size").alias("size"))


@query
def visible_size(spark: SparkSession, d: str) -> DataFrame:
    sized = mapstats.point_sizes(places(spark, d))
    on = selected(spark, d).withColumn("on", F.lit(True))
    return sized.join(on, "cluster_id", "left").select(
        "id",
        r6(scaling.visible_size(F.col("size"), F.coalesce("on", F.lit(False)))).alias("size"),
    )


@query
def cluster_color(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", scaling.cluster_color(F.col("p_partkey") - 2).alias("color")
    )


@query
def format_downloads(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey") * F.col("o_orderkey") * (F.col("o_custkey") % 97)
    return table(spark, d, "orders").select("o_orderkey", scaling.format_downloads(n).alias("shown"))


# --- spatial queries -------------------------------------------------------------------------


@query
def viewport_filter(spark: SparkSession, d: str) -> DataFrame:
    return spatial.viewport_filter(places(spark, d), 1.0, 4.0, 0.5, 3.0, [1, 2, 3, 5, 8, 13, 21]).select(
        "id", "cluster_id"
    )


@query
def viewport_padding(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d).select(
        "view_id",
        r6(spatial.viewport_padding()).alias("padding"),
        r6(spatial.viewport_padding(spatial.MIN_CLUSTER_PADDING)).alias("cluster_padding"),
    )


@query
def viewport_points(spark: SparkSession, d: str) -> DataFrame:
    return spatial.viewport_points(places(spark, d), views(spark, d), selected(spark, d)).select("view_id", "id")


@query
def viewport_clusters(spark: SparkSession, d: str) -> DataFrame:
    parts = places(spark, d).withColumn("cluster_id", F.col("id"))
    boxes = mapstats.cluster_metadata(parts)
    return spatial.viewport_clusters(boxes, views(spark, d)).select("view_id", "cluster_id")


@query
def grid_range(spark: SparkSession, d: str) -> DataFrame:
    return spatial.grid_range_join(places(spark, d), picks(spark, d), 0.25).select("query_id", "id")


@query
def nearest_within(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.nearest_within(places(spark, d), picks(spark, d), selected(spark, d))
    return found.select("query_id", "nearest_id", r6("distance").alias("distance"))


@query
def label_top_k(spark: SparkSession, d: str) -> DataFrame:
    found = spatial.label_top_k(places(spark, d), views(spark, d), selected(spark, d))
    return found.select("view_id", "id", "label_rank")


@query
def cluster_label_top_k(spark: SparkSession, d: str) -> DataFrame:
    parts = places(spark, d).withColumn("cluster_id", F.col("id") % 100)
    return spatial.cluster_label_top_k(mapstats.cluster_metadata(parts), views(spark, d)).select(
        "view_id", "cluster_id"
    )


@query
def cluster_list(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("label")
    )
    return spatial.cluster_list(clusters)


@query
def detail_lookup(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("label")
    )
    return spatial.detail_lookup(places(spark, d), clusters, 77)


# --- search ----------------------------------------------------------------------------------

DOCUMENT_SEARCHES = [(1, "licence"), (2, "ñas"), (3, "threa in g")]
LONG_SEARCH = "a new anvil of brass, longer than any name or type"
SEARCHES = [
    (1, "r"), (2, "bolt"), (3, "RED"), (4, "blue bolt"), (5, "hot rinq"), (6, "anvli"), (7, "new anvil brass"), (8, LONG_SEARCH),
]


def part_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("summary"),
        F.col("p_size").cast("bigint").alias("weekly_downloads"),
    )


@query
def fuzzy_search(spark: SparkSession, d: str) -> DataFrame:
    searches = spark.createDataFrame(SEARCHES, "query_id int, query string")
    return search.fuzzy_search(part_points(spark, d), searches).select("query_id", "result_rank", "id")


@query
def fuzzy_hits_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same search over the whole text of every document."""
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("summary")
    )
    return search.fuzzy_hits(docs, spark.createDataFrame(DOCUMENT_SEARCHES, "query_id int, query string"))


# --- constellations, labels, outputs ---------------------------------------------------------


@query
def top_fraction(spark: SparkSession, d: str) -> DataFrame:
    return constellations.top_fraction_per_cluster(places(spark, d)).select("cluster_id", "name", "rank")


def _edges(df: DataFrame) -> DataFrame:
    return df.select(
        "cluster_id", "from_package", "to_package", *[r6(c).alias(c) for c in ("from_x", "from_y", "to_x", "to_y")]
    )


@query
def spanning_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(constellations.spanning_edges(places(spark, d)))


@query
def constellation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(constellations.constellations(places(spark, d), cutoff=0.1))


@query
def edge_visible(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spatial.edge_visible(constellations.spanning_edges(places(spark, d)), selected(spark, d)))


@query
def constellations_output(spark: SparkSession, d: str) -> DataFrame:
    edges = constellations.constellations(places(spark, d), cutoff=0.1)
    # Ends that are not in the id table: the edge is dropped.
    ids = outputs.with_ids(places(spark, d).where("weekly_downloads % 7 != 3"))
    out = outputs.constellations_output(edges, ids)
    return out.withColumns({c: r6(c) for c in ("fromX", "fromY", "toX", "toY")})


@query
def cluster_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by language: thousands of characters, cut at the budget."""
    rows = table(spark, d, "documents").select(
        F.ascii("lang").alias("cluster_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("summary"),
        F.col("n_chars").alias("weekly_downloads"),
    )
    return labels.cluster_prompts(rows)


@query
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.cluster_labels(points(spark, d))


@query
def label_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A labeler that answers for some clusters, with blanks for others."""

    def by_nation(df: DataFrame) -> DataFrame:
        nation = table(spark, d, "nation")
        key = F.col("n_nationkey")
        blank = F.when(key % 2 == 0, "\n").otherwise(" \t\u00a0")
        answer = F.when(key % 3 == 0, blank).otherwise(F.concat(F.lit("\t "), "n_name", F.lit(" \n")))
        return df.select("cluster_id").distinct().join(
            nation.where("n_nationkey % 5 != 0").select(F.col("n_nationkey").alias("cluster_id"), answer.alias("answer")),
            "cluster_id",
        )

    return labels.cluster_labels(places(spark, d), by_nation)


@query
def packages_output(spark: SparkSession, d: str) -> DataFrame:
    out = outputs.packages_output(outputs.with_ids(places(spark, d)))
    return out.withColumns({"x": r6("x"), "y": r6("y")})


@query
def clusters_output(spark: SparkSession, d: str) -> DataFrame:
    """Labels of even nations against metadata of the nations below 20."""
    named = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("cluster_label")
    )
    stats = mapstats.cluster_metadata(places(spark, d).where("cluster_id < 20"))
    out = outputs.clusters_output(named, stats)
    rounded = ("centroidX", "centroidY", "minX", "maxX", "minY", "maxY")
    return out.withColumns({c: r6(c) for c in rounded})


@query
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    return ranking.global_dense_id(
        table(spark, d, "orders").select("o_orderkey", "o_totalprice"),
        [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()],
    ).select("o_orderkey", "id")


@query
def clustered_dataset(spark: SparkSession, d: str) -> DataFrame:
    placed = points(spark, d).select("name", "cluster_id", r6("x").alias("x"), r6("y").alias("y"))
    meta = points(spark, d).where("weekly_downloads IS NOT NULL").select("name", "weekly_downloads", "summary")
    return pipeline.clustered_dataset(placed, meta)


# --- vectors and graphs ----------------------------------------------------------------------


@query
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    unit = table(spark, d, "embeddings").select(
        "vec_id",
        F.posexplode(vectors.l2_normalize(F.transform("embedding", lambda v: v.cast("double") * F.col("label")))).alias("dim", "v"),
    )
    return unit.select("vec_id", "dim", r6("v").alias("v"))


@query
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the pairs of places of a cluster that lie within a radius; the grid rules out the others."""
    radius = 0.05
    here = places(spark, d).select("id", "cluster_id", "x", "y")
    sides = [(F.col(c) + s * radius).alias(f"{n}_{c}") for c in ("x", "y") for n, s in (("low", -1), ("high", 1))]
    boxes = here.select("id", "cluster_id", "x", "y", *sides)
    spots = here.select(*[F.col(c).alias(f"other_{c}") for c in here.columns])
    measured = vectors.distance(F.array("x", "y"), F.array("other_x", "other_y"))
    return (
        spatial.overlap_join(
            spots, boxes, ["other_x", "other_x", "other_y", "other_y"], ["low_x", "high_x", "low_y", "high_y"]
        )
        .where((F.col("cluster_id") == F.col("other_cluster_id")) & (F.col("id") < F.col("other_id")))
        .withColumn("distance", measured)
        .where(F.col("distance") <= radius)
        .select("cluster_id", "id", F.col("other_id").alias("other"), r6("distance").alias("distance"))
    )


@query
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return knn.knn_exact(vectors_table(spark, d), 10).select(
        "id", "rank", "neighbor", r6("distance").alias("distance")
    )


@query
def knn_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Per vector: whether ten neighbours came back, and whether most of them are the true ones."""
    near = knn.knn_approximate(vectors_table(spark, d), 10).select("id", "neighbor")
    true = neighbor_table(spark, d, 10).select("id", "neighbor", F.lit(1).alias("true"))
    counted = near.join(true, ["id", "neighbor"], "left").groupBy("id")
    return counted.agg(F.count("*").alias("found"), (F.count("true") >= 6).alias("near"))


@query
def knn_descent(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours by descent, with their distances, and the share of each vector's true neighbours among them."""
    near = Workspace(spark).write(descent.knn_descent(vectors_table(spark, d), 10), "near")
    true = neighbor_table(spark, d, 10).select("id", "neighbor", F.lit(1).alias("true"))
    recall = near.join(true, ["id", "neighbor"], "left").groupBy("id").agg((F.count("true") / 10).alias("recall"))
    return near.join(recall, "id").select("id", "rank", "neighbor", r6("distance").alias("distance"), "recall")


@query
def core_distance(spark: SparkSession, d: str) -> DataFrame:
    return density.core_distance(neighbor_table(spark, d, 2)).select("id", r6("core").alias("core"))


@query
def mutual_reachability(spark: SparkSession, d: str) -> DataFrame:
    near = neighbor_table(spark, d, 4)
    edges = near.select(
        F.least("id", "neighbor").alias("src"),
        F.greatest("id", "neighbor").alias("dst"),
        F.col("distance").alias("weight"),
    ).distinct()
    return density.mutual_reachability(edges, density.core_distance(near)).select(
        "src", "dst", r6("weight").alias("weight")
    )


@query
def membership(spark: SparkSession, d: str) -> DataFrame:
    return layout.membership(neighbor_table(spark, d, 9), 10).select(
        "id", "neighbor", F.round("weight", 3).alias("weight")
    )


@query
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    return layout.fuzzy_graph(neighbor_table(spark, d, 9), 10).select(
        "src", "dst", F.round("weight", 3).alias("weight")
    )


def _rank_graph(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour graph whose weights are plain fractions of the better of the two ranks."""
    return neighbor_table(spark, d, 5).groupBy(
        F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst")
    ).agg(F.max(1 / (F.col("rank") + 1.0)).alias("weight"))


@query
def supervise_graph(spark: SparkSession, d: str) -> DataFrame:
    labelled = points(spark, d).select("id", F.col("cluster_id").alias("label"))
    return layout.supervise_graph(_rank_graph(spark, d), labelled).select(
        "src", "dst", F.round("weight", 5).alias("weight")
    )


@query
def spanning_forest(spark: SparkSession, d: str) -> DataFrame:
    """Minimum spanning forest of the nations of customers and, below zero, of suppliers, by the least price paid."""
    customers = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    bought = table(spark, d, "lineitem").join(customers, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = (
        bought.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy((-1 - F.col("s_nationkey")).cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst"))
        .agg(F.min("l_extendedprice").alias("weight"))
    )
    return graph.minimum_spanning_forest(edges).select("src", "dst", "weight")


@query
def spanning_forest_parts(spark: SparkSession, d: str) -> DataFrame:
    """Minimum spanning forest of parts and, below zero, of their suppliers, by the least price paid."""
    edges = (
        table(spark, d, "lineitem")
        .groupBy((-1 - F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"))
        .agg(F.min("l_extendedprice").alias("weight"))
    )
    return graph.minimum_spanning_forest(edges).select("src", "dst", "weight")


@query
def connected_components_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders and, below zero, the parts they hold: no star, but ways of many steps."""
    items = table(spark, d, "lineitem")
    return graph.connected_components(items.select(F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst")))


@query
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Parts linked by a brand and size they share, the shared kind numbered below zero."""
    kind = -(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("bigint") * 100 + F.col("p_size"))
    return graph.connected_components(table(spark, d, "part").select(kind.alias("src"), F.col("p_partkey").alias("dst")))


@query
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    return density.density_clusters(planted(spark, d).select("id", "vec"), method="exact")


@query
def density_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Groups that split above the joining distance: their halves are the leaves, what lies alone is noise."""
    return density.density_clusters(halved(spark, d).select("id", "vec"), method="exact")


@query
def density_graph(spark: SparkSession, d: str) -> DataFrame:
    """The same groups from the neighbour graph's tree, whose parts are joined by their least edges."""
    return density.density_clusters(planted(spark, d).select("id", "vec"), method="graph")


@query
def density_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The halves again, all merges of the tree made in parallel rounds but the last hundred."""
    rows = halved(spark, d).select("id", "vec")
    tree = density.reachability_tree(rows, 2, "graph")
    found = density.clusters_of_tree(tree, local_edges=100)
    return rows.select("id").join(found, "id", "left").select("id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))


def same_label(placed: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(id, together): whether enough of the five nearest others have the vector's own label."""
    near = knn.knn_exact(placed, 5).select("id", "neighbor")
    other = labels.select(F.col("id").alias("neighbor"), F.col("label").alias("other"))
    return (
        near.join(labels, "id")
        .join(other, "neighbor")
        .groupBy("id")
        .agg((F.avg((F.col("label") == F.col("other")).cast("int")) >= least).alias("together"))
    )


@query
def reduce_dims(spark: SparkSession, d: str) -> DataFrame:
    """Per vector: whether the reduced one has length 1 and still lies among its own label."""
    rows = planted(spark, d)
    reduced = Workspace(spark).write(layout.reduce_dims(rows.select("id", "vec")), "reduced")
    together = same_label(reduced, rows.select("id", "label"), 0.8)
    unit = F.abs(vectors.norm(F.col("vec")) - 1) < 1e-6
    return reduced.select("id", F.size("vec").alias("dimensions"), unit.alias("unit")).join(together, "id")


@query
def reduce_dims_kept(spark: SparkSession, d: str) -> DataFrame:
    """Vectors without planted groups: the share of each one's ten nearest that are still among its ten nearest."""
    rows = Workspace(spark).write(layout.unit_vectors(vectors_table(spark, d)), "unit")
    reduced = Workspace(spark).write(layout.reduce_dims(rows), "reduced")
    near = [knn.knn_exact(x, 10).select("id", "neighbor") for x in (rows, reduced)]
    return layout.kept_neighbors(*near)


@query
def map_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Per label: whether nearly all of its vectors lie on the map among their own label."""
    rows = planted(spark, d)
    placed = layout.map_coordinates(rows.select("id", "vec"), rows.select("id", "label"))
    placed = Workspace(spark).write(placed.select("id", F.array("x", "y").alias("vec")), "placed")
    together = same_label(placed, rows.select("id", "label"), 0.6).join(rows.select("id", "label"), "id")
    return together.groupBy("label").agg(
        F.count("*").alias("n"), (F.avg(F.col("together").cast("int")) >= 0.95).alias("together")
    )


@query
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every vector, weighted by document frequencies over all texts."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    own = embed.embed_text(rows, "text").select("doc_id", F.posexplode("embeddings").alias("dim", "v"))
    return own.select("doc_id", "dim", F.round(F.col("v").cast("double"), 4).alias("v"))


@query
def whole_map(spark: SparkSession, d: str) -> DataFrame:
    """All stages over the documents; returns the packages record set."""
    raw = table(spark, d, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("description_content_type"),
        F.col("source").alias("summary"),
        F.lit("1").alias("latest_version"),
        F.col("n_chars").cast("string").alias("number_of_downloads"),
    )
    records = pipeline.run_pipeline(raw, f"{Workspace(spark).folder}/map", pipeline.MapSettings(top_packages=None))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("clusterId").isNotNull()
    return records["packages"].select("id", "name", "summary", "downloads", placed.alias("placed"))
