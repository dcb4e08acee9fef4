"""Queries over the map: viewports, boxes, nearest points, top labels.

All of them are batch tables of queries joined with the points. The joins are equi-joins on grid
cells of several sizes, so no pair outside a shared cell is ever formed. Two small tables can have very many pairs, so
the number of tasks does not follow from their bytes, and the rows of a crowded cell are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.operators.ranking import global_dense_id
from skychart.sources.workspace import Workspace

BOX = ("min_x", "max_x", "min_y", "max_y")

# Cells are never smaller than 2^-20: a larger cell than needed is still right.
_SMALLEST = 2.0**-20

# A cell's length is the power of two above a box's longer side, halved so many times.
_FINER = 1
# Parts of a cell's left rows, each of which meets all its right rows, and tasks of a join per core.
_SALTS, _TASKS_PER_CORE = 8, 4

# Most labels of a viewport, the most used points that viewports meet first, and how many times as many they have met after each
# further turn.
MOST_LABELS, TIER, TIER_GROWTH = 50, 8192, 8

# Share of the viewport added as padding, and the least padding for clusters.
PADDING_FACTOR = 0.1
MIN_CLUSTER_PADDING = 0.1


def _level(box: Sequence[str]) -> Column:
    """The power of two that is the length of the box's cells: at least half its longer side."""
    min_x, max_x, min_y, max_y = (F.col(c) for c in box)
    side = F.greatest(max_x - min_x, max_y - min_y, F.lit(_SMALLEST))
    return F.ceil(F.log2(side)).cast("int") - _FINER


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def _levels_in_use(df: DataFrame, box: Sequence[str]) -> Column:
    """The distinct box sizes as powers of two: some dozens at most, so a scalar."""
    return df.agg(F.array_sort(F.collect_set(_level(box)))).scalar()


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Sequence[str],
    right_box: Sequence[str],
) -> DataFrame:
    """All pairs of rows whose closed boxes intersect; column names must not collide.

    A box meets at most nine cells of its own size. A pair is matched on cells of the larger size
    of the two and kept only in the cell holding the lower-left corner of the intersection, so
    each pair appears once without a distinct. Points are boxes of zero size. The rows of a cell are dealt by salts.
    """
    tasks = _TASKS_PER_CORE * left.sparkSession.sparkContext.defaultParallelism
    left = left.where((F.col(left_box[0]) <= F.col(left_box[1])) & (F.col(left_box[2]) <= F.col(left_box[3])))
    right = right.where(
        (F.col(right_box[0]) <= F.col(right_box[1])) & (F.col(right_box[2]) <= F.col(right_box[3]))
    )
    points_only = left_box[0] == left_box[1] and left_box[2] == left_box[3]
    if points_only:
        levels = _levels_in_use(right, right_box)
        left_level = F.lit(-1_000)
        right_levels = F.array(_level(right_box))
    else:
        levels = F.array_distinct(
            F.concat(_levels_in_use(left, left_box), _levels_in_use(right, right_box))
        )
        left_level = _level(left_box)
        right_levels = levels

    def placed(df: DataFrame, box: Sequence[str], own: Column, side: str, candidates: Column) -> DataFrame:
        own_name, at = f"_{side}_level", F.col(f"_{side}_at")
        df = (
            df.withColumn(own_name, own)
            .withColumn(f"_{side}_levels", candidates)
            .withColumn(
                f"_{side}_at",
                F.explode(F.filter(f"_{side}_levels", lambda v: v >= F.col(own_name))),
            )
            .drop(f"_{side}_levels")
        )
        for axis, low, high in (("x", box[0], box[1]), ("y", box[2], box[3])):
            name = f"_{side}_c{axis}"
            if low == high:
                df = df.withColumn(name, _cell(F.col(low), at))
            else:
                df = df.withColumn(
                    name, F.explode(F.sequence(_cell(F.col(low), at), _cell(F.col(high), at)))
                )
        return df

    a = placed(left, left_box, left_level, "l", levels)
    b = placed(right, right_box, _level(right_box), "r", right_levels)
    a = a.withColumn("_l_salt", F.pmod(F.xxhash64(*left.columns), F.lit(_SALTS)).cast("int"))
    b = b.withColumn("_r_length", F.pow(F.lit(2.0), F.col("_r_at")))
    b = b.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    key = ("at", "cx", "cy", "salt")
    a, b = a.repartition(tasks, *[f"_l_{c}" for c in key]), b.repartition(tasks, *[f"_r_{c}" for c in key])
    same_cell = (
        (a["_l_at"] == b["_r_at"])
        & (a["_l_cx"] == b["_r_cx"])
        & (a["_l_cy"] == b["_r_cy"])
        & (a["_l_salt"] == b["_r_salt"])
    )
    at = F.col("_r_at")
    corner_x = F.greatest(F.col(left_box[0]), F.col(right_box[0]))
    corner_y = F.greatest(F.col(left_box[2]), F.col(right_box[2]))
    return (
        a.join(b, same_cell)
        .where(
            (F.col(left_box[0]) <= F.col(right_box[1]))
            & (F.col(right_box[0]) <= F.col(left_box[1]))
            & (F.col(left_box[2]) <= F.col(right_box[3]))
            & (F.col(right_box[2]) <= F.col(left_box[3]))
            & (at == F.greatest(F.col("_l_level"), F.col("_r_level")))
            & (F.col("_r_cx") == F.floor(corner_x / F.col("_r_length")).cast("bigint"))
            & (F.col("_r_cy") == F.floor(corner_y / F.col("_r_length")).cast("bigint"))
        )
        .select(*left.columns, *right.columns)
    )


def viewport_padding(floor: float | None = None) -> Column:
    """10 % of the viewport's smaller side, for clusters at least 0.1."""
    side = F.least(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    padding = side * PADDING_FACTOR
    return padding if floor is None else F.greatest(F.lit(floor), padding)


def _prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})


def viewport_filter(
    points: DataFrame,
    min_x: float,
    max_x: float,
    min_y: float,
    max_y: float,
    selected: Sequence[int] | None = None,
) -> DataFrame:
    """Points inside one viewport grown by its padding; literal bounds reach the scan."""
    padding = min(max_x - min_x, max_y - min_y) * PADDING_FACTOR
    inside = F.col("x").between(min_x - padding, max_x + padding) & F.col("y").between(
        min_y - padding, max_y + padding
    )
    if selected is not None:
        inside = inside & F.col("cluster_id").isin(list(selected))
    return points.where(inside)


def viewport_points(
    points: DataFrame, views: DataFrame, selected: DataFrame | None = None
) -> DataFrame:
    """Per viewport, the points of selected clusters inside its bounds grown by the padding."""
    if selected is not None:
        points = points.join(selected.select("cluster_id").distinct(), "cluster_id", "left_semi")
    padded = _prefixed(views.withColumn("_pad", viewport_padding()), "_v_", BOX).withColumns(
        {
            "_p_min_x": F.col("_v_min_x") - F.col("_pad"),
            "_p_max_x": F.col("_v_max_x") + F.col("_pad"),
            "_p_min_y": F.col("_v_min_y") - F.col("_pad"),
            "_p_max_y": F.col("_v_max_y") + F.col("_pad"),
        }
    )
    box = ["_p_min_x", "_p_max_x", "_p_min_y", "_p_max_y"]
    kept = [c for c in views.columns if c not in BOX]
    return overlap_join(points, padded, ["x", "x", "y", "y"], box).select(*kept, *points.columns)


def viewport_clusters(clusters: DataFrame, views: DataFrame) -> DataFrame:
    """Per viewport, the clusters whose box is not apart from it by more than the padding."""
    views = _prefixed(
        views.withColumn("_pad", viewport_padding(MIN_CLUSTER_PADDING)), "_v_", BOX
    )
    # A hair wider than the padding, so that rounding cannot lose a pair before the exact test.
    grown = {}
    for c in BOX:
        sign = -1 if c.startswith("min") else 1
        hair = F.lit(1e-9) * (1 + F.abs(F.col(f"_v_{c}")) + F.col("_pad"))
        grown[f"_p_{c}"] = F.col(f"_v_{c}") + sign * (F.col("_pad") + hair)
    views = views.withColumns(grown)
    pad = F.col("_pad")
    apart = (
        (F.col("_v_max_x") < F.col("min_x") - pad)
        | (F.col("_v_min_x") > F.col("max_x") + pad)
        | (F.col("_v_max_y") < F.col("min_y") - pad)
        | (F.col("_v_min_y") > F.col("max_y") + pad)
    )
    kept = [c for c in views.columns if not c.startswith("_")]
    return (
        overlap_join(clusters, views, BOX, [f"_p_{c}" for c in BOX])
        .where(~apart)
        .select(*kept, *clusters.columns)
    )


def edge_visible(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges of the selected clusters."""
    return edges.join(selected.select("cluster_id").distinct(), "cluster_id", "left_semi")


def grid_range_join(points: DataFrame, queries: DataFrame, cell_size: float) -> DataFrame:
    """Per query (x, y, radius), the points in all grid cells up to ``ceil(radius / cell)`` away."""
    q = _prefixed(queries, "_q_", ["x", "y", "radius"])
    reach = F.ceil(F.col("_q_radius") / cell_size)
    column = F.floor(F.col("_q_x") / cell_size)
    row = F.floor(F.col("_q_y") / cell_size)
    q = q.withColumns(
        {
            "_c_min_x": column - reach,
            "_c_max_x": column + reach,
            "_c_min_y": row - reach,
            "_c_max_y": row + reach,
        }
    )
    cells = points.withColumns(
        {"_cell_x": F.floor(F.col("x") / cell_size), "_cell_y": F.floor(F.col("y") / cell_size)}
    )
    joined = overlap_join(
        cells,
        q,
        ["_cell_x", "_cell_x", "_cell_y", "_cell_y"],
        ["_c_min_x", "_c_max_x", "_c_min_y", "_c_max_y"],
    )
    kept = [c for c in q.columns if not c.startswith("_c_")]
    return joined.select(*kept, *points.columns).withColumnsRenamed(
        {"_q_x": "query_x", "_q_y": "query_y", "_q_radius": "radius"}
    )


def nearest_within(
    points: DataFrame, queries: DataFrame, selected: DataFrame | None = None
) -> DataFrame:
    """The closest point strictly nearer than the query's radius, null where there is none.

    Equal distances go to the lowest id. Candidates are reduced to one per task before the shuffle.
    """
    if selected is not None:
        points = points.join(selected.select("cluster_id").distinct(), "cluster_id", "left_semi")
    q = _prefixed(queries.select("query_id", "x", "y", "radius"), "_q_", ["x", "y", "radius"])
    reach = F.col("_q_radius") + F.lit(1e-9) * (
        1 + F.abs(F.col("_q_x")) + F.abs(F.col("_q_y")) + F.col("_q_radius")
    )
    q = q.withColumns(
        {
            "_min_x": F.col("_q_x") - reach,
            "_max_x": F.col("_q_x") + reach,
            "_min_y": F.col("_q_y") - reach,
            "_max_y": F.col("_q_y") + reach,
        }
    )
    dx, dy = F.col("x") - F.col("_q_x"), F.col("y") - F.col("_q_y")
    near = (
        overlap_join(
            points.select("id", "x", "y"), q, ["x", "x", "y", "y"], ["_min_x", "_max_x", "_min_y", "_max_y"]
        )
        .withColumn("_d2", dx * dx + dy * dy)
        .where(F.col("_d2") < F.col("_q_radius") * F.col("_q_radius"))
        .groupBy("query_id")
        .agg(F.min(F.struct("_d2", "id")).alias("_best"))
        .select(
            "query_id",
            F.col("_best.id").alias("nearest_id"),
            F.sqrt("_best._d2").alias("distance"),
        )
    )
    return queries.select("query_id").join(near, "query_id", "left")


def label_limit(zoom: Column, mobile: Column) -> Column:
    """How many labels a viewport shows: none below zoom 4."""
    return (
        F.when(zoom < 4, 0)
        .when(mobile, 25)
        .when(zoom < 7, 20)
        .when(zoom < 20, 30)
        .otherwise(50)
    )


def label_top_k(
    points: DataFrame, views: DataFrame, selected: DataFrame | None = None
) -> DataFrame:
    """Per viewport, the most used visible points that get a label.

    Viewports meet the points in the order of their use, a tier at a time, until they have all their labels: what comes later
    cannot get one. So a viewport meets few of its points however many it shows, and all of them only if they are few.
    """
    space = Workspace(points.sparkSession)
    if selected is not None:
        points = points.join(selected.select("cluster_id").distinct(), "cluster_id", "left_semi")
    ranked = global_dense_id(points, [F.col("weekly_downloads").desc_nulls_last(), F.col("id").asc()], out="_place")
    ranked = space.write(ranked, "ranked")
    n = ranked.count()
    views = views.withColumn("_limit", label_limit(F.col("zoom"), F.col("mobile"))).where(F.col("_limit") > 0)
    waiting = space.write(views, "waiting")
    most_used = Window.partitionBy("view_id").orderBy("_place")

    def first(df: DataFrame) -> DataFrame:
        # The literal bound lets Spark drop the rest before the shuffle.
        return df.withColumn("label_rank", F.row_number().over(most_used)).where(F.col("label_rank") <= MOST_LABELS)

    found, low, high = None, 0, TIER
    while True:
        tier = ranked.where((F.col("_place") >= low) & (F.col("_place") < high))
        near = space.write(first(viewport_points(tier, waiting)).drop("label_rank"), "found")
        found = near if found is None else found.unionByName(near)
        if high >= n:
            break
        have = found.groupBy(F.col("view_id").alias("_id")).agg(F.count("*").alias("_have"))
        need = waiting.groupBy("view_id").agg(F.max("_limit").alias("_need"))
        full = need.join(have, F.col("view_id").eqNullSafe(F.col("_id"))).where("_have >= _need").select("_id")
        waiting = space.write(waiting.join(full, F.col("view_id").eqNullSafe(F.col("_id")), "left_anti"), "waiting")
        if waiting.isEmpty():
            break
        low, high = high, high * TIER_GROWTH
    return first(found).where(F.col("label_rank") <= F.col("_limit")).drop("_limit", "_place")


def cluster_label_limit(zoom: Column, mobile: Column) -> Column:
    """On mobile 30 labels below zoom 2 and 80 below zoom 3; else no limit (null)."""
    return F.when(mobile & (zoom < 2), 30).when(mobile & (zoom < 3), 80)


def cluster_label_top_k(clusters: DataFrame, views: DataFrame) -> DataFrame:
    """Per view, the clusters that get a label: all of them, or the most used up to the limit.

    The rank of a cluster is the same in every view, and no limited view shows more than 80: only
    the top 80 rows are ranked, and only unlimited views see the whole cluster table.
    """
    limit = cluster_label_limit(F.col("zoom"), F.col("mobile"))
    views = views.select("view_id", limit.alias("_limit"))
    top = clusters.orderBy(F.col("total_weekly_downloads").desc_nulls_last(), "cluster_id").limit(80)
    ranked = top.withColumn(
        "_rank",
        F.row_number().over(
            Window.orderBy(F.col("total_weekly_downloads").desc_nulls_last(), "cluster_id")
        ),
    )
    limited = (
        views.where(F.col("_limit").isNotNull())
        .withColumn("_rank", F.explode(F.sequence(F.lit(1), F.col("_limit"))))
        .join(ranked, "_rank")
    )
    # Every cluster for every other view: both sides meet on a salt, so the product is spread out.
    salts = 16
    unlimited = (
        views.where(F.col("_limit").isNull())
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .join(clusters.withColumn("_salt", F.pmod(F.hash("cluster_id"), F.lit(salts))), "_salt")
    )
    columns = ["view_id", *clusters.columns]
    return limited.select(*columns).unionByName(unlimited.select(*columns))


def cluster_list(clusters: DataFrame) -> DataFrame:
    """Clusters by label in the Unicode order of a locale, not of bytes."""
    return clusters.orderBy(F.collate(F.col("label"), "UNICODE"), "cluster_id")


def detail_lookup(points: DataFrame, clusters: DataFrame, point_id: int) -> DataFrame:
    """One point with the label of its cluster and a text in place of an empty summary."""
    found = points.where(F.col("id") == point_id)
    summary = F.coalesce(
        F.when(F.col("summary") != "", F.col("summary")), F.lit("No description available")
    )
    return found.join(clusters.select("cluster_id", "label"), "cluster_id", "left").select(
        "id", "name", F.col("label").alias("cluster_label"), "weekly_downloads", summary.alias("summary")
    )
