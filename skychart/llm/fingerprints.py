"""Homomorphic multiset hashes of documents: sums of wide vectors hashed from paragraphs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skychart.functions.bind import let

# Lanes that tell texts apart: each paragraph adds 32 pseudo-random bits to each, modulo 2^32. The number of the lane goes in
# before the paragraph's two digests, so lanes collide one by one, all of them only where both digests do.
WIDE_LANES = 16
# Lanes that measure likeness: each run of words in a paragraph adds one hashed bit to each, modulo 2^31.
# One 64-bit hash gives 62 bits: two lanes, 31 bits apart, share a sum.
PAIRS = 31
LIKE_LANES = 2 * PAIRS
RUN_WORDS = 3
LOW = (1 << 31) - 1
# Bounds between the ranges of ids; one row of the driver's plan each.
MAX_RANGES = 8192


def paragraphs(text: Column) -> Column:
    """The lines of a text; an empty text is one empty line."""
    return F.split(text, "\n")


def word_runs(paragraph: Column) -> Column:
    """A hash of every run of three words of a paragraph; with one or two words, of all; without words, none."""
    words = F.transform(
        F.filter(F.split(paragraph, "[ \\t\\x0B\\f\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)
    )

    def runs(w: Column) -> Column:
        last = F.size(w) - RUN_WORDS + 1
        many = F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)),
        )
        few = F.transform(F.filter(F.array(F.xxhash64(w)), lambda _: F.size(w) > 0), lambda h: h)
        return F.when(last >= 1, many).otherwise(few)

    # Binds the words once: an expression used twice in a lambda body would be computed twice.
    return F.flatten(F.transform(F.array(words), runs))


def lanes() -> dict[str, Column]:
    """Aggregates over rows (_d1, _d2, _pos, _h): position 0 of a paragraph stands for the paragraph itself."""
    is_paragraph = F.col("_pos") == 0
    out = {
        f"_w{j}": F.sum(
            F.when(is_paragraph, F.shiftrightunsigned(F.xxhash64(F.lit(j), "_d1", "_d2"), 32)).otherwise(F.lit(0))
        )
        for j in range(WIDE_LANES)
    }
    mask = (1 << 31) | 1
    out["_runs"] = F.sum(F.when(is_paragraph, F.lit(0)).otherwise(F.lit(1)))
    for j in range(PAIRS):
        bits = F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(mask))
        out[f"_l{j}"] = F.sum(F.when(is_paragraph, F.lit(0)).otherwise(bits))
    return out


def vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wide, runs, like): the summed vectors of the rows (keys, _text) that share their keys.

    ``wide`` are sums modulo 2^32; ``like`` counts set bits over ``runs`` word runs, modulo 2^31. Both are
    additive: the vectors of two multisets of paragraphs add up to the vector of their union, and
    subtracting a paragraph's vector deletes it. One row per key and task is exchanged at most.
    """
    lines = texts.select(*keys, F.explode(paragraphs(F.col("_text"))).alias("_p"))
    hashed = lines.select(
        *keys,
        F.xxhash64("_p").alias("_d1"),
        F.xxhash64(F.lit("second"), "_p").alias("_d2"),
        F.posexplode(F.concat(F.array(F.lit(0).cast("bigint")), word_runs(F.col("_p")))).alias("_pos", "_h"),
    )
    sums = lanes()
    summed = hashed.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    low = F.lit(LOW).cast("bigint")
    wide = F.array(*[F.col(f"_w{j}").bitwiseAND(F.lit((1 << 32) - 1)) for j in range(WIDE_LANES)])
    like = F.array(
        *[F.col(f"_l{j}").bitwiseAND(low) for j in range(PAIRS)],
        *[F.shiftrightunsigned(f"_l{j}", 31).bitwiseAND(low) for j in range(PAIRS)],
    )
    return summed.select(*keys, wide.alias("wide"), F.col("_runs").alias("runs"), like.alias("like"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The wide lanes after adding (sign 1) or deleting (sign -1) the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def printed(wide: Column, runs: Column, like: Column) -> Column:
    """The whole vector in hexadecimal digits."""
    return F.concat_ws(
        "",
        F.transform(wide, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")),
        F.transform(F.concat(F.array(runs), like), lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")),
    )


def likeness(wide: Column, runs: Column, like: Column, wide2: Column, runs2: Column, like2: Column) -> Column:
    """0 to 1: 1 for equal vectors, else the estimated cosine of the two multisets of word runs.

    A lane's count minus half of the runs is a sum of random signs, and such sums keep inner products.
    """
    a = F.transform(like, lambda v: (2 * v - runs).cast("double"))
    b = F.transform(like2, lambda v: (2 * v - runs2).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    length = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.when(wide == wide2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _ranges(docs: DataFrame) -> list[int]:
    """Bounds that cut the ids into ranges of about equal counts; their number follows the exchange's partitions."""
    wanted = min(MAX_RANGES, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / wanted for i in range(1, wanted)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted).alias("b")).first()["b"]
    return sorted(set(found or []))


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of (doc_id, text) rows, of their edited texts, and how like they are.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or
    all) of the next row's text, in the order of doc_id (null first), after the last row the first; rows
    that repeat an id stand in the order of a hash of their text. A null text counts as empty; an
    empty text has one empty paragraph. A single row is its own next row. Columns other than
    doc_id and text are left out. An empty table gives no rows.

    Ids are cut into ranges, and the first row of a range is copied to the range before, so that one exchange of
    the texts brings every row next to its successor; the sums then need no further exchange.
    """
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("_text")
    ).withColumn("_tie", F.xxhash64("_text"))
    bounds = _ranges(docs)
    position = F.lit(0)
    if bounds:
        cut = F.lit(bounds).cast("array<bigint>")
        position = F.coalesce(_place(cut, F.col("doc_id"), len(bounds)), F.lit(0))
    rows = rows.withColumn("_range", position)
    # One row per range that has rows: its first key, and the range before it.
    firsts = rows.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "_tie")).alias("_f"))
    around = Window.orderBy("_range")
    whole = Window.partitionBy()
    firsts = firsts.select(
        "_range",
        "_f",
        F.coalesce(F.lag("_range").over(around), F.max("_range").over(whole)).alias("_to"),
    )
    copies = (
        rows.join(F.broadcast(firsts), "_range")
        .where(F.col("doc_id").eqNullSafe(F.col("_f.doc_id")) & (F.col("_tie") == F.col("_f._tie")))
        .select("doc_id", "_text", "_tie", F.col("_to").alias("_range"), F.lit(1).alias("_extra"))
    )
    both = rows.withColumn("_extra", F.lit(0)).unionByName(copies)
    order = Window.partitionBy("_range").orderBy("_extra", "doc_id", "_tie")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    placed = (
        both.withColumns({"_row": F.row_number().over(order), "_next": F.lead("_text").over(order)})
        .withColumn("n_chars", F.length("_text").cast("bigint"))
        .withColumn(
            "_edited",
            F.concat(
                F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half),
                F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half),
            ),
        )
        .withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    )
    keys = ["_range", "_row", "_extra", "doc_id", "n_chars", "edited_sha256", "_which"]
    texts = placed.select(
        *keys[:-1],
        F.posexplode(F.array("_text", "_edited")).alias("_which", "_text"),
    )
    summed = vectors(texts, keys)
    steps = Window.partitionBy("_range").orderBy("_row", "_which")
    names = ("wide", "runs", "like")
    lead = {f"{n}_e": F.lead(n, 1).over(steps) for n in names} | {f"{n}_n": F.lead(n, 2).over(steps) for n in names}
    own = [F.col(n) for n in names]
    return (
        summed.withColumns(lead)
        .where("_which = 0 and _extra = 0")
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            printed(*own).alias("fingerprint"),
            printed(*[F.col(f"{n}_e") for n in names]).alias("edited_fingerprint"),
            likeness(*own, *[F.col(f"{n}_e") for n in names]).alias("near_edited"),
            likeness(*own, *[F.col(f"{n}_n") for n in names]).alias("near_next"),
        )
    )


def _place(cut: Column, value: Column, size: int) -> Column:
    """How many of the ascending numbers in ``cut`` are at most ``value``: a binary search of fixed depth."""
    found = F.lit(0)
    step = 1 << (size.bit_length() - 1)
    while step:
        found = let(found, partial(_ahead, cut, value, size, step))
        step //= 2
    return found


def _ahead(cut: Column, value: Column, size: int, step: int, found: Column) -> Column:
    inside = (found + step <= size) & (F.get(cut, found + (step - 1)) <= value)
    return F.when(inside, found + step).otherwise(found)
