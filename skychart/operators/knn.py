"""Nearest neighbours of vectors by Euclidean distance: exact, and approximate for very large tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.functions.vectors import distance
from skychart.operators.ranking import running_total
from skychart.sources.workspace import Workspace

# Rows of one task: queries times candidates. At least so many, and up to ``LARGEST_BLOCK`` a share of the table, so that
# every vector is sent to the same number of tasks whatever the table's size.
QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
BLOCKS, LARGEST_BLOCK = 12, 65_536
# Entries of a distance matrix, and strips of the candidates whose least entries bound the search.
MATRIX, STRIPS = 1 << 21, 64
POINTS_PER_PIVOT = 2048
MAX_PIVOTS = 1024


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype("float64")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a @ (-2.0 * b.T)
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)[None, :]
    return out


def _nearest(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k members of the candidates nearest to each query, ties by id."""
    q, c = _matrix(queries["vec"]), _matrix(candidates["vec"])
    return _nearest_rows(queries["rep"].to_numpy(), q, c, candidates["members"].to_numpy(), k)


def _kth(rough: np.ndarray, k: int) -> np.ndarray:
    """At least the k-th least entry of each row: of many entries, that of the strips' least ones."""
    if rough.shape[1] >= 8 * STRIPS and k < STRIPS:
        whole = rough.shape[1] // STRIPS * STRIPS
        rough = rough[:, :whole].reshape(len(rough), -1, STRIPS).min(axis=1)
    at = min(k, rough.shape[1]) - 1
    return np.partition(rough, at, axis=1)[:, at]


def _nearest_rows(reps: np.ndarray, q: np.ndarray, c: np.ndarray, members: np.ndarray, k: int) -> pd.DataFrame:
    """The same for matrices, some queries at a time.

    The matrix product only preselects; the kept distances are summed from the differences.
    """
    found, ids, lengths = [], [], []
    step = max(1, MATRIX // len(c))
    for start in range(0, len(q), step):
        rough = _squares(q[start : start + step], c)
        limit = _kth(rough, k) + 1e-7 * (1.0 + np.maximum(rough.max(axis=1), -rough.min(axis=1)))
        row, close = np.nonzero(rough <= limit[:, None])
        ends = np.searchsorted(row, np.arange(len(rough) + 1))
        exact = np.sqrt(((c[close] - q[start + row]) ** 2).sum(axis=1))
        for i in range(len(rough)):
            part = slice(ends[i], ends[i + 1])
            listed = [members[j] for j in close[part]]
            neighbor = np.concatenate(listed)
            length = np.repeat(exact[part], [len(m) for m in listed])
            best = np.lexsort((neighbor, length))[:k]
            found.append(np.full(len(best), reps[start + i]))
            ids.append(neighbor[best])
            lengths.append(length[best])
    return pd.DataFrame(
        {"rep": np.concatenate(found), "neighbor": np.concatenate(ids), "distance": np.concatenate(lengths)}
    )


_FOUND = "rep bigint, neighbor bigint, distance double"


def _best(found: DataFrame, key: str, k: int) -> DataFrame:
    nearest_first = Window.partitionBy(key).orderBy("distance", "neighbor")
    return found.withColumn("_rn", F.row_number().over(nearest_first)).where(F.col("_rn") <= k).drop("_rn")


def _values(vectors: DataFrame) -> Column:
    """Vectors as they travel: floats stay floats, which are half as long; tasks compute in double precision."""
    single = vectors.schema["vec"].dataType.simpleString() == "array<float>"
    return F.col("vec") if single else F.col("vec").cast("array<double>").alias("vec")


def _copies(vectors: DataFrame, k: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Vectors without their copies: (id, rep) for all, and (rep, vec, members) per distinct vector.

    Of copies only the k + 1 with the lowest ids can be anyone's neighbours, so a vector that is
    copied a billion times is compared once.
    """
    # Written first: the join then sees a table of known size and can split a much copied vector.
    distinct = space.write(vectors.groupBy("vec").agg(F.min("id").alias("rep")), "distinct")
    owners = space.write(vectors.join(distinct, "vec").select("id", "rep"), "owners")
    lowest = Window.partitionBy("rep").orderBy("id")
    members = (
        owners.withColumn("_rn", F.row_number().over(lowest))
        .where(F.col("_rn") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list("id")).alias("members"))
    )
    reps = members.join(vectors.withColumnRenamed("id", "rep"), "rep")
    return owners, reps


def _for_every_owner(found: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """Neighbours of a distinct vector (k + 1 with itself) handed to all its copies."""
    ranked = Window.partitionBy("rep").orderBy("distance", "neighbor")
    lists = (
        found.withColumn("_rn", F.row_number().over(ranked))
        .where(F.col("_rn") <= k + 1)
        .groupBy("rep")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "neighbor"))).alias("list"))
    )
    # Written first, so that the join can split the owners of a much copied vector.
    lists = Workspace(owners.sparkSession).write(lists, "lists")
    others = F.filter("list", lambda e: e["neighbor"] != F.col("id"))
    return (
        owners.join(lists, "rep")
        .select("id", F.posexplode(F.slice(others, 1, k)).alias("rank", "_e"))
        .select("id", "rank", F.col("_e.neighbor").alias("neighbor"), F.col("_e.distance").alias("distance"))
    )


def knn_exact(vectors: DataFrame, k: int) -> DataFrame:
    """(id, rank, neighbor, distance): the k nearest other vectors of each of (id, vec), ties by id.

    Vectors are assigned to their nearest pivot. The pivots' distances bound how far the neighbours
    of a cell's points can lie, and the triangle inequality rules out every vector beyond; only the
    rest is sent to the cell. Near cells share their candidates, and large cells and candidate sets are cut into blocks, so a
    vector travels to few tasks and one task holds a bounded distance matrix and emits k + 1 rows per query.
    """
    spark = vectors.sparkSession
    space = Workspace(spark)
    owners, reps = _copies(vectors, k, space)
    reps = space.write(reps, "reps")
    n = reps.count()
    if n == 0:
        return _for_every_owner(spark.createDataFrame([], _FOUND), owners, k)

    n_pivots = int(min(MAX_PIVOTS, max(1, n // POINTS_PER_PIVOT)))
    chosen = reps.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(n_pivots).toPandas()
    pivots = _matrix(chosen["vec"])
    shared = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                v = _matrix(batch["vec"])
                cell = _squares(v, shared.value).argmin(axis=1)
                gap = np.sqrt(((v - shared.value[cell]) ** 2).sum(axis=1))
                yield batch.assign(cell=cell.astype("int32"), gap=gap)

    placed = reps.select("rep", "members", _values(reps))
    columns = f"rep bigint, members array<bigint>, vec {placed.schema['vec'].dataType.simpleString()}, cell int, gap double"
    placed = space.write(placed.mapInPandas(assign, columns), "placed")

    # At most MAX_PIVOTS cells, k + 1 gaps each: small enough for the driver.
    lowest_gaps = Window.partitionBy("cell").orderBy("gap")
    nearest_gaps = (
        placed.select("cell", "gap")
        .withColumn("_rn", F.row_number().over(lowest_gaps))
        .where(F.col("_rn") <= k + 1)
        .select("cell", "gap")
        .toPandas()
    )
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).toPandas()
    plan = _reachable_cells(pivots, stats, nearest_gaps, k)
    sizes = stats.set_index("cell")["n"].to_dict()
    share = min(LARGEST_BLOCK, -(-n // BLOCKS))
    query_size, candidate_size = max(QUERY_BLOCK, share), max(CANDIDATE_BLOCK, share)
    groups = _cell_groups(plan, sizes, query_size)
    least_gaps = np.full((len(pivots), len(pivots)), np.inf)
    least_gaps[plan["cell"], plan["other"]] = plan["least_gap"]
    shared_gaps = spark.sparkContext.broadcast(least_gaps)
    plan = plan.assign(group=plan["cell"].map(groups))
    plan = plan.groupby(["group", "other"]).agg(least_gap=("least_gap", "min"), n=("n", "first")).reset_index()
    members = pd.DataFrame({"cell": list(groups), "group": list(groups.values())})
    blocks = pd.DataFrame(
        {
            "candidate_blocks": -(-plan.groupby("group")["n"].sum() // candidate_size),
            "query_blocks": -(-members["cell"].map(sizes).groupby(members["group"]).sum() // query_size),
        }
    ).rename_axis("group").reset_index()
    counts = "candidate_blocks int, query_blocks int"
    plan = plan.merge(blocks, on="group")[["group", "other", "least_gap", "candidate_blocks", "query_blocks"]]
    reach = spark.createDataFrame(plan, f"group int, other int, least_gap double, {counts}")
    own = members.merge(blocks, on="group")[["cell", "group", "candidate_blocks", "query_blocks"]]
    own = spark.createDataFrame(own, f"cell int, group int, {counts}")

    def block(count: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(count) - 1).cast("int")))

    queries = (
        placed.join(F.broadcast(own), "cell")
        .select("group", "cell", "rep", "vec", block("query_blocks").alias("qb"), every("candidate_blocks").alias("cb"))
    )
    candidates = (
        placed.withColumnRenamed("cell", "other")
        .join(F.broadcast(reach), "other")
        .where(F.col("gap") >= F.col("least_gap"))
        .select(
            "group", "other", "gap", "members", "vec", every("query_blocks").alias("qb"), block("candidate_blocks").alias("cb")
        )
    )

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"rep": [], "neighbor": [], "distance": []}).astype({"rep": "int64", "neighbor": "int64"})]
        if len(q) and len(c):
            x, y = _matrix(q["vec"]), _matrix(c["vec"])
            reps, ids, cells = q["rep"].to_numpy(), c["members"].to_numpy(), q["cell"].to_numpy()
            for cell in np.unique(cells):
                at, near = cells == cell, c["gap"].to_numpy() >= shared_gaps.value[cell, c["other"].to_numpy()]
                if near.all():
                    found.append(_nearest_rows(reps[at], x[at], y, ids, k + 1))
                elif near.any():
                    found.append(_nearest_rows(reps[at], x[at], y[near], ids[near], k + 1))
        return pd.concat(found[1:] or found)

    # Both sides come from one table: fresh names keep their columns apart.
    candidates = candidates.select(*[F.col(c).alias(c) for c in candidates.columns])
    key = ["group", "qb", "cb"]
    found = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(compare, _FOUND)
    return _for_every_owner(found, owners, k)


def _reachable_cells(
    pivots: np.ndarray, stats: pd.DataFrame, nearest_gaps: pd.DataFrame, k: int
) -> pd.DataFrame:
    """Which cells can hold neighbours of which, and from what distance to their own pivot on.

    ``cell`` receives the vectors of ``other`` that lie at least ``least_gap`` from other's pivot.
    """
    between = np.sqrt(np.maximum(_squares(pivots, pivots), 0.0))
    gaps = nearest_gaps["gap"].to_numpy()
    of_cell = nearest_gaps["cell"].to_numpy()
    cells, counts = stats["cell"].to_numpy(), stats["n"].to_numpy()
    radius = np.zeros(len(pivots))
    radius[cells] = stats["radius"].to_numpy()
    rows = []
    for cell in cells:
        upper = np.sort(between[cell, of_cell] + gaps)
        # Fewer vectors than neighbours wanted: everything is a neighbour.
        bound = upper[k] + radius[cell] if len(upper) > k else np.inf
        least = between[cell, cells] - radius[cell] - bound
        least = least - 1e-6 * (1.0 + np.abs(between[cell, cells]))
        for other, gap, n in zip(cells, least, counts, strict=True):
            if radius[other] >= gap:
                rows.append((int(cell), int(other), float(gap), int(n)))
    return pd.DataFrame(rows, columns=["cell", "other", "least_gap", "n"])


def _cell_groups(plan: pd.DataFrame, sizes: dict[int, int], most: int) -> dict[int, int]:
    """A group for each cell: near cells that can hold each other's neighbours, of at most so many vectors or a single cell."""
    groups: dict[int, int] = {}
    for cell, part in plan.sort_values(["cell", "least_gap", "other"]).groupby("cell"):
        if cell in groups:
            continue
        groups[cell], left = cell, most - sizes[cell]
        for other in part["other"]:
            if other not in groups and sizes[other] <= left:
                groups[other], left = cell, left - sizes[other]
    return groups


def projection_leaves(reps: DataFrame, trees: int, leaf: int, seed: int) -> DataFrame:
    """(tree, rep, leaf): (rep, vec) sorted by the sides of random planes and cut into leaves of a fixed size, per tree."""

    def codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch["vec"])
            for tree in range(trees):
                planes = np.random.default_rng([seed, tree]).standard_normal((v.shape[1], 17))
                side = v @ planes
                code = (side[:, :16] > 0) @ (1 << np.arange(15, -1, -1))
                yield pd.DataFrame(
                    {"tree": tree, "rep": batch["rep"], "code": code, "along": side[:, 16]}
                )

    placed = reps.select("rep", "vec").mapInPandas(codes, "tree int, rep bigint, code bigint, along double")
    order = [F.col("code").asc(), F.col("along").asc(), F.col("rep").asc()]
    return running_total(placed, order, ["tree"], out="position").select(
        "tree", "rep", F.floor(F.col("position") / leaf).alias("leaf")
    )


def knn_approximate(
    vectors: DataFrame, k: int, trees: int = 6, leaf: int = 512, refine: int = 1, seed: int = 0
) -> DataFrame:
    """Like :func:`knn_exact`, near-linear in the table: most but not all true neighbours are found.

    Each tree sorts the vectors by the sides of random planes they lie on and cuts the order into
    leaves of a fixed size, so a leaf stays bounded even for identical vectors; neighbours are
    searched inside leaves. ``refine`` rounds then try the neighbours of neighbours.
    """
    spark = vectors.sparkSession
    space = Workspace(spark)
    owners, reps = _copies(vectors, k, space)
    reps = space.write(
        reps.select("rep", "members", F.col("vec").cast("array<double>").alias("vec")), "reps"
    )

    placed = projection_leaves(reps, trees, leaf, seed)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return _nearest(pdf, pdf, k + 1)

    found = placed.join(reps, "rep").groupBy("tree", "leaf").applyInPandas(search, _FOUND)
    found = space.replace(_best(found.distinct(), "rep", k + 1), "found")
    for _ in range(refine):
        found = space.replace(_best(_neighbors_of_neighbors(found, reps), "rep", k + 1), "found")
    return _for_every_owner(found, owners, k)


def _neighbors_of_neighbors(found: DataFrame, reps: DataFrame) -> DataFrame:
    """Known neighbours and theirs; at most k squared candidates per vector."""
    vecs = reps.select(F.explode("members").alias("member"), F.col("rep").alias("of"), "vec")
    first = found.select("rep", F.col("neighbor").alias("via"))
    # Only a representative has its own list, and its copies share it.
    via = first.join(vecs.select(F.col("member").alias("via"), "of"), "via").select("rep", "of").distinct()
    second = found.select(F.col("rep").alias("of"), "neighbor")
    fresh = (
        via.join(second, "of")
        .select("rep", "neighbor")
        .distinct()
        .join(found.select("rep", "neighbor"), ["rep", "neighbor"], "left_anti")
    )
    measured = (
        fresh.join(vecs.select(F.col("member").alias("neighbor"), F.col("vec").alias("vec_b")), "neighbor")
        .join(reps.select("rep", "vec"), "rep")
        .select("rep", "neighbor", distance(F.col("vec"), F.col("vec_b")).alias("distance"))
    )
    return found.unionByName(measured)
