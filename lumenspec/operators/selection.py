"""Selection of spectra and consistent filtering of every facet that hangs on them."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_range(text: str) -> tuple[float, float]:
    """``lo-hi`` with either side open; a missing hyphen or a falling range is an error."""
    low, sep, high = text.partition("-")
    if not sep:
        raise ValueError(f"a range needs a hyphen: {text!r}")
    a, b = float(low) if low.strip() else -math.inf, float(high) if high.strip() else math.inf
    if a > b:
        raise ValueError(f"the range falls: {text!r}")
    return a, b


def rt_window(time: Column, low: float = -math.inf, high: float = math.inf) -> Column:
    """Inclusive at both ends; null and NaN times are out."""
    return F.coalesce(~F.isnan(time) & (time >= low) & (time <= high), F.lit(False))


def level_in(level: Column, levels: Iterable[int]) -> Column:
    """An empty set filters nothing; a null level counts as 0."""
    wanted = sorted(set(levels))
    return F.coalesce(level, F.lit(0)).isin(wanted) if wanted else F.lit(True)


def survivors(spectra: DataFrame, rt: tuple[float, float] | None = None, levels: Iterable[int] = (), mz: tuple[float, float] | None = None) -> DataFrame:
    """Spectra that pass the time window and the level set; m/z is a filter of points, not of spectra."""
    if mz is not None:
        raise NotImplementedError("select points by m/z with points_in_range")
    keep = level_in(F.col("ms_level"), levels)
    return spectra.where(keep & rt_window(F.col("time"), *rt) if rt else keep)


def facet_rows(facet: DataFrame, chosen: DataFrame, key: str, keep_null: bool = False) -> DataFrame:
    """Rows of a facet whose key survives; metadata facets also keep rows without a key.

    Which side is broadcast, if any, is Spark's choice by measured size; for
    facets sorted by key, with_key_range also skips row groups.
    """
    keys = chosen.select(F.col("index").alias(key))
    met = facet.join(keys, key, "left_semi")
    return met.unionByName(facet.where(F.col(key).isNull())) if keep_null else met


def with_key_range(facet: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The facet cut to the survivors' smallest and largest index, for sorted facets; one row comes to the driver."""
    low, high = chosen.agg(F.min("index"), F.max("index")).first()
    return facet.where(F.lit(False)) if low is None else facet.where(F.col(key).between(low, high))


def points_in_range(points: DataFrame, low: float, high: float) -> DataFrame:
    """An m/z slice; the predicate reaches the scan."""
    return points.where(F.col("mz").between(low, high))


def index_range(c0: float, c1: float, low: float, high: float) -> tuple[int, int]:
    """The lattice indexes of an m/z range, so that a slice of a gridded facet compares integers."""
    a, b = sorted(((math.sqrt(max(low, 0)) - c0) / c1, (math.sqrt(max(high, 0)) - c0) / c1))
    return math.ceil(a), math.floor(b)


def truncate_points(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.where(rt_window(F.col("time"), low, high))


def truncate_chunks(chunks: DataFrame, low: float, high: float) -> DataFrame:
    """Chunks that overlap the window stay whole; null bounds are out."""
    return chunks.where(F.coalesce((F.col("time_end") >= low) & (F.col("time_start") <= high), F.lit(False)))


def refreshed_counts(chromatograms: DataFrame, points: DataFrame) -> DataFrame:
    """Numbers of points counted anew; none is 0."""
    n = points.groupBy(F.col("chromatogram_index").alias("index")).agg(F.count("*").alias("number_of_points"))
    return chromatograms.drop("number_of_points").join(n, "index", "left").fillna(0, ["number_of_points"])


def first_spectra(spectra: DataFrame, n: int) -> DataFrame:
    return spectra.orderBy("index").limit(n)


def every_nth(spectra: DataFrame, n: int, count: int) -> DataFrame:
    """Spectra at even steps: positions 0, step, 2 * step and so on, ``n`` at most; positions are 0-based and dense."""
    step = max(count // n, 1)
    return spectra.where((F.col("index") % step == 0) & (F.floor(F.col("index") / step) < n))


def nonzero(points: DataFrame) -> DataFrame:
    return points.where(F.col("intensity") != 0)


def fine_mz(points: DataFrame) -> DataFrame:
    """Positive finite m/z only; NaN sorts above all in Spark, so it must go before minima and maxima."""
    return points.where((F.col("mz") > 0) & ~F.isnan("mz") & (F.col("mz") < float("inf")))


def filled(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Defaults only where a value is missing."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def dropped_members(members: DataFrame, globs: Iterable[str]) -> DataFrame:
    from lumenspec.functions.text import member_matches

    hit = F.lit(False)
    for g in globs:
        hit = hit | member_matches(F.col("name"), g)
    return members.withColumn("dropped", hit)
