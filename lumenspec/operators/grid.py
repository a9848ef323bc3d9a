"""Flight-time lattices: fitting, evaluation and routing of spectra."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.functions.scalar import MAX_INDEX, PPM_TOLERANCE, grid_index, grid_mz, ppm

#: Dense spectra that must agree; their points; the largest median step that refinement may end at; how often it halves.
MIN_PROBES, MIN_POINTS, MAX_STEP, HALVINGS = 2, 16, 4, 14
#: Of one spectrum: points and gaps that a step estimate needs.
STEP_POINTS, STEP_GAPS, GAP = 8, 4, 1e-10
NO_STEP = 2**63 - 1
#: Parts in which values are counted to find one by its rank, and how many values are fetched once they are so few.
BUCKETS, FETCHED = 4096, 10_000


@dataclass(frozen=True)
class Fit:
    c0: float
    c1: float
    max_ppm: float
    median_ppm: float
    max_k: int
    median_dk: int


def gaps(points: DataFrame) -> DataFrame:
    """Differences of neighbouring square roots of m/z within each spectrum."""
    roots = points.where("mz > 0").select("spectrum_index", F.sqrt("mz").alias("y"))
    return roots.withColumn("gap", F.col("y") - F.lag("y").over(Window.partitionBy("spectrum_index").orderBy("y")))


def base_steps(points: DataFrame) -> DataFrame:
    """(spectrum_index, step): the gap at three tenths of the sorted gaps, for spectra with enough points and gaps."""
    g = gaps(points).groupBy("spectrum_index").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("gap") > GAP, F.col("gap")))).alias("g"))
    fine = g.where((F.col("n") >= STEP_POINTS) & (F.size("g") >= STEP_GAPS))
    return fine.select("spectrum_index", F.element_at("g", F.floor(F.size("g") * 30 / 100).cast("int") + 1).alias("step"))


def least_squares(points: DataFrame, step: float, low: float | None = None) -> DataFrame:
    """(c0, c1) of sqrt(mz) = c0 + c1 * k with k rounded from ``step``; (low, step) if that has no solution. Partial sums only."""
    y = points.where("mz > 0").select(F.sqrt("mz").alias("y"))
    base = F.lit(low) if low is not None else F.lit(y.agg(F.min("y")).first()[0])
    k = F.round((F.col("y") - base) / step)
    s = y.select("y", k.alias("k")).agg(F.count("*").cast("double").alias("n"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("y").alias("y"), F.sum(F.col("k") * F.col("y")).alias("ky"))
    det = F.col("n") * F.col("kk") - F.col("k") * F.col("k")
    flat = F.abs(det) < 1e-30
    safe = F.when(~flat, det)
    return s.select(F.when(flat, base).otherwise((F.col("kk") * F.col("y") - F.col("k") * F.col("ky")) / safe).alias("c0"), F.when(flat, F.lit(step)).otherwise((F.col("n") * F.col("ky") - F.col("k") * F.col("y")) / safe).alias("c1"))


def _errors(points: DataFrame, c0: float, c1: float) -> DataFrame:
    k = F.round((F.sqrt("mz") - c0) / c1)
    return points.where("mz > 0").select("mz", k.alias("k")).select("k", ppm(grid_mz(F.lit(c0), F.lit(c1), F.col("k")), F.col("mz")).alias("e"))


def worst(points: DataFrame, c0: float, c1: float) -> DataFrame:
    """(max_ppm, max_k, n) of a grid over all points, by partial sums; infinity without points."""
    s = _errors(points, c0, c1).agg(F.max("e").alias("max_ppm"), F.max("k").alias("k"), F.count("*").alias("n"))
    return s.select(F.coalesce("max_ppm", F.lit(float("inf"))).alias("max_ppm"), F.coalesce(F.greatest(F.col("k"), F.lit(0.0)), F.lit(0.0)).cast("long").alias("max_k"), "n")


def value_at_rank(values: DataFrame, column: str, rank: int) -> float | None:
    """The value at a 0-based rank in rising order, infinity and then NaN last, nulls left out; none beyond the end.

    Values are counted in BUCKETS equal parts of their range, by partial sums,
    and the part that holds the rank is counted again in as many, until all of
    it is one value or few enough to be fetched. Nothing is sorted or shuffled
    but counts.
    """
    v = F.col(column)
    held, infinity = values.select(v.cast("double").alias("v")), float("inf")
    low, high, n, n_high = held.agg(F.min(F.when(F.col("v") < infinity, F.col("v"))), F.max(F.when(F.col("v") < infinity, F.col("v"))), F.count_if(F.col("v") < infinity), F.count_if(F.col("v") == infinity)).first()
    if rank >= n:
        return infinity if rank < n + n_high else None if rank >= n + n_high + held.where(F.isnan("v")).count() else float("nan")
    while low < high and n > FETCHED:
        part = F.least(F.floor((F.col("v") - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1))
        counted = held.where(F.col("v").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        for row in sorted(counted.collect()):  # BUCKETS rows at most
            if rank < row["n"]:
                low, high, n = row["low"], row["high"], row["n"]
                break
            rank -= row["n"]
    if low == high:
        return low
    return sorted(r["v"] for r in held.where(F.col("v").between(low, high)).collect())[rank]  # FETCHED rows at most


def evaluated(points: DataFrame, c0: float, c1: float) -> DataFrame:
    """(max_ppm, median_ppm, max_k) of a grid over all points; the upper median is found by counting."""
    total = worst(points, c0, c1)
    n = total.first()["n"]
    if not n:
        return total.select("max_ppm", F.col("max_ppm").alias("median_ppm"), "max_k")
    median = value_at_rank(_errors(points, c0, c1), "e", n // 2)
    return total.select("max_ppm", F.lit(median).alias("median_ppm"), "max_k")


def median_steps(points: DataFrame, c0: float, c1: float) -> DataFrame:
    """(spectrum_index, dk): the upper median of the positive steps between neighbouring lattice indexes; NO_STEP without any."""
    k = F.round((F.sqrt("mz") - c0) / c1).cast("long")
    rows = points.select("spectrum_index", F.when(F.col("mz") > 0, k).alias("k"))
    d = rows.withColumn("d", F.col("k") - F.lag("k").over(Window.partitionBy("spectrum_index").orderBy(F.col("k").asc_nulls_first())))
    s = d.groupBy("spectrum_index").agg(F.array_sort(F.collect_list(F.when(F.col("d") > 0, F.col("d")))).alias("d"))
    return s.select("spectrum_index", F.when(F.size("d") > 0, F.try_element_at("d", F.floor(F.size("d") / 2).cast("int") + 1)).otherwise(F.lit(NO_STEP)).alias("dk"))


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The upper median of a few rows: one for each sampled spectrum."""
    s = df.agg(F.array_sort(F.collect_list(column)).alias("v"))
    return s.select(F.try_element_at("v", F.floor(F.size("v") / 2).cast("int") + 1).alias("median"))


def sampled(spectra: DataFrame, points: DataFrame, n: int = 16, least: int = 64) -> DataFrame:
    """Points of up to ``n`` evenly spread spectra that have at least ``least`` points each."""
    from lumenspec.operators.selection import every_nth

    chosen = every_nth(spectra, n, spectra.count()).select(F.col("index").alias("spectrum_index"))
    few = points.join(chosen, "spectrum_index", "left_semi")
    big = few.groupBy("spectrum_index").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    return few.join(big.select("spectrum_index"), "spectrum_index", "left_semi")


def fit(sample: DataFrame, min_probes: int = MIN_PROBES) -> Fit | None:
    """A lattice that all sampled spectra share, or none.

    The sample is a few spectra; each trial is a fixed number of aggregates
    over it and returns a row. The first dense spectrum gives the step. Four
    times, twice and once the step are tried for a lattice whose neighbours
    are one step apart; failing that, the step is halved until the error is
    within tolerance, and that grid holds if it is still dense.
    """
    pts = sample.where("mz > 0").select("spectrum_index", "mz").cache()
    try:
        steps = base_steps(pts).orderBy("spectrum_index").collect()
        low, n = pts.agg(F.min(F.sqrt("mz")), F.count("*")).first()
        if len(steps) < max(min_probes, 1) or n < MIN_POINTS:
            return None
        dense = pts.join(pts.sparkSession.createDataFrame([(r["spectrum_index"],) for r in steps], "spectrum_index long"), "spectrum_index", "left_semi")

        def trial(step: float) -> Fit | None:
            c0, c1 = least_squares(pts, step, low).first()
            if not c1 > 0:
                return None
            most, k, _ = worst(pts, c0, c1).first()
            return Fit(c0, c1, most, float("nan"), k, upper_median(median_steps(dense, c0, c1), "dk").first()[0])

        def finished(got: Fit) -> Fit:
            return replace(got, median_ppm=evaluated(pts, got.c0, got.c1).first()["median_ppm"])

        base = steps[0]["step"]
        for times in (4, 2, 1):
            got = trial(base * times)
            if got and got.median_dk == 1 and got.max_ppm <= PPM_TOLERANCE and got.max_k <= MAX_INDEX:
                return finished(got)
        for halving in range(HALVINGS):
            got = trial(base / 2**halving)
            if got and got.max_k > MAX_INDEX:
                return None
            if got and got.max_ppm <= PPM_TOLERANCE:
                return finished(got) if got.median_dk <= MAX_STEP else None
        return None
    finally:
        pts.unpersist()


def fixed_clock(points: DataFrame, c1: float, least: int = 4) -> DataFrame:
    """(spectrum_index, c0, max_ppm) of spectra that a known clock fits: c0 is the mean offset; every point must be within tolerance, and none may be zero, negative or beyond the largest index."""
    y = points.where("mz > 0").select("spectrum_index", "mz", F.sqrt("mz").alias("y"))
    low = y.groupBy("spectrum_index").agg(F.min("y").alias("low"), F.count("*").alias("n")).where(F.col("n") >= least)
    k = y.join(low, "spectrum_index").withColumn("k", F.round((F.col("y") - F.col("low")) / c1))
    c0 = k.groupBy("spectrum_index").agg(F.avg(F.col("y") - c1 * F.col("k")).alias("c0"))
    e = k.join(c0, "spectrum_index").groupBy("spectrum_index", "c0").agg(F.max(ppm(grid_mz(F.col("c0"), F.lit(c1), F.round((F.col("y") - F.col("c0")) / c1)), F.col("mz"))).alias("max_ppm"))
    return _lossless(e, points, k.join(c0, "spectrum_index"), F.col("c0"), F.lit(c1))


def _lossless(fits: DataFrame, points: DataFrame, y: DataFrame, c0, c1) -> DataFrame:
    """The fits within tolerance of spectra all of whose points have an index."""
    k = F.round((F.col("y") - c0) / c1)
    beyond = y.groupBy("spectrum_index").agg(F.min(k).alias("least"), F.max(k).alias("most")).where((F.col("least") < 0) | (F.col("most") > MAX_INDEX)).select("spectrum_index")
    without = points.where("mz is null or isnan(mz) or mz <= 0").select("spectrum_index").unionByName(beyond).distinct()
    return fits.where(F.col("max_ppm") <= PPM_TOLERANCE).join(without, "spectrum_index", "left_anti")


def per_spectrum(points: DataFrame) -> DataFrame:
    """(spectrum_index, c0, c1, max_ppm): each spectrum's own grid at its step or a half, quarter or eighth of it, the coarsest within tolerance whose indexes all fit; none for a spectrum with a point that is zero or negative."""
    y = points.where("mz > 0").select("spectrum_index", "mz", F.sqrt("mz").alias("y"))
    low = y.groupBy("spectrum_index").agg(F.min("y").alias("low"))
    tries = base_steps(points).join(low, "spectrum_index").select("spectrum_index", "low", F.posexplode(F.array(*(F.col("step") / 2**i for i in range(4)))).alias("t", "s"))
    k = y.join(tries, "spectrum_index").withColumn("k", F.round((F.col("y") - F.col("low")) / F.col("s")))
    s = k.groupBy("spectrum_index", "t", "s", "low").agg(F.count("*").cast("double").alias("n"), F.sum("k").alias("sk"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.sum("y").alias("sy"), F.sum(F.col("k") * F.col("y")).alias("ky"))
    det = F.col("n") * F.col("kk") - F.col("sk") * F.col("sk")
    safe = F.when(F.abs(det) >= 1e-30, det)
    grids = s.select("spectrum_index", "t", F.coalesce((F.col("kk") * F.col("sy") - F.col("sk") * F.col("ky")) / safe, F.col("low")).alias("c0"), F.coalesce((F.col("n") * F.col("ky") - F.col("sk") * F.col("sy")) / safe, F.col("s")).alias("c1")).where("c1 > 0")
    at = F.round((F.col("y") - F.col("c0")) / F.col("c1"))
    e = y.join(grids, "spectrum_index").groupBy("spectrum_index", "t", "c0", "c1").agg(F.min(at).alias("least"), F.max(at).alias("most"), F.max(ppm(grid_mz(F.col("c0"), F.col("c1"), F.round((F.col("y") - F.col("c0")) / F.col("c1"))), F.col("mz"))).alias("max_ppm"))
    fine = (F.col("max_ppm") <= PPM_TOLERANCE) & (F.col("least") >= 0) & (F.col("most") <= MAX_INDEX)
    without = points.where("mz is null or isnan(mz) or mz <= 0").select("spectrum_index").distinct()
    return e.where(fine).join(without, "spectrum_index", "left_anti").groupBy("spectrum_index").agg(F.min_by(F.struct("c0", "c1", "max_ppm"), "t").alias("g")).select("spectrum_index", "g.*")


def routed(points: DataFrame, c0: float, c1: float) -> DataFrame:
    """``points`` with tof_index and on_grid: one point off the lattice sends its whole spectrum to the exact facet.

    Points are judged and reduced to a flag per spectrum before the flag meets
    them again; the flags are one row per spectrum.
    """
    k = grid_index(F.col("mz"), F.lit(c0), F.lit(c1))
    near = F.coalesce(ppm(grid_mz(F.lit(c0), F.lit(c1), k), F.col("mz")) <= PPM_TOLERANCE, F.lit(False))
    flags = points.groupBy("spectrum_index").agg(F.bool_and(near).alias("on_grid"))
    return points.withColumn("tof_index", k).join(flags, "spectrum_index")
