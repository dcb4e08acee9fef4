"""Sizes, colours and number formats of the map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour wheel step in degrees, the noise colour and the fallback point size.
GOLDEN_ANGLE = 137.508
NOISE_COLOR = "#808080"
DEFAULT_SIZE = 16.0


def log_size(
    downloads: Column,
    lowest: Column,
    highest: Column,
    min_size: float,
    max_size: float,
    gamma: float = 1.0,
) -> Column:
    """``log10(d + 1)`` scaled from [lowest, highest] to [min_size, max_size], clipped."""
    low, high = F.log10(lowest + 1.0), F.log10(highest + 1.0)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    norm = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log10(downloads + 1.0) - low) / span))
    # Greatest and least pass over nulls, so an unknown count needs its own case.
    norm = F.when(downloads.isNotNull(), norm)
    return F.lit(float(min_size)) + F.lit(float(max_size - min_size)) * F.pow(norm, F.lit(float(gamma)))


def visible_size(size: Column, selected: Column) -> Column:
    """The base size, 16 where it is missing or 0; hidden points get 0."""
    shown = F.coalesce(F.when(size != 0, size.cast("double")), F.lit(DEFAULT_SIZE))
    return F.when(selected, shown).otherwise(F.lit(0.0))


def cluster_color(cluster_id: Column) -> Column:
    """A hex colour per cluster: hues a golden angle apart at 70 % saturation, 50 % lightness."""
    hue = (cluster_id * F.lit(GOLDEN_ANGLE)) % F.lit(360.0)
    chroma, base = F.lit(0.7), F.lit(0.15)
    ramp = chroma * (1 - F.abs((hue / 60.0) % F.lit(2.0) - 1))
    zero = F.lit(0.0)
    sector = F.floor(hue / 60.0)

    def channel(by_sector: list[Column]) -> Column:
        level = F.lit(None).cast("double")
        for i, value in enumerate(by_sector):
            level = F.when(sector == i, value).otherwise(level)
        byte = F.floor((F.coalesce(level, zero) + base) * 255 + 0.5)
        return F.lpad(F.lower(F.hex(byte)), 2, "0")

    red = channel([chroma, ramp, zero, zero, ramp, chroma])
    green = channel([ramp, chroma, chroma, ramp, zero, zero])
    blue = channel([zero, zero, ramp, chroma, chroma, ramp])
    return F.when(cluster_id == -1, NOISE_COLOR).otherwise(F.concat(F.lit("#"), red, green, blue))


def format_downloads(downloads: Column) -> Column:
    """Compact English form with at most one decimal, ties away from zero: 1250 is 1.3K.

    A count that rounds up to 1000 of its unit moves to the next unit: 999950 is 1M.
    """

    def compact(exponent: int, suffix: str) -> Column:
        tenth = 10 ** (exponent - 1)
        shifted = downloads + tenth // 2
        tenths = F.round((shifted - shifted % tenth) / tenth).cast("bigint")
        whole, rest = F.round((tenths - tenths % 10) / 10).cast("bigint"), tenths % 10
        digits = F.when(whole < 10_000, whole.cast("string")).otherwise(F.format_number(whole, 0))
        decimal = F.when(rest == 0, "").otherwise(F.concat(F.lit("."), rest.cast("string")))
        return F.concat(digits, decimal, F.lit(suffix))

    return (
        F.when(downloads < 1_000, downloads.cast("string"))
        .when(downloads < 999_950, compact(3, "K"))
        .when(downloads < 999_950_000, compact(6, "M"))
        .when(downloads < 999_950_000_000, compact(9, "B"))
        .when(downloads.isNotNull(), compact(12, "T"))
    )
