"""Chromatograms and per-spectrum aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tic_bpc(spectra: DataFrame, points: DataFrame) -> DataFrame:
    """(index, time, tic, bpc) of each first-level spectrum, 0 where it has no points.

    Points are summed per spectrum before they meet the spectra, so the join
    moves one row per spectrum.
    """
    sums = points.groupBy(F.col("spectrum_index").alias("index")).agg(F.sum("intensity").alias("tic"), F.max("intensity").alias("bpc"))
    met = spectra.where(F.col("ms_level") == 1).select("index", "time").join(sums, "index", "left")
    return met.select("index", "time", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("tic", "bpc")))


def chromatogram_points(curves: DataFrame) -> DataFrame:
    """TIC (chromatogram 0) and BPC (1) in long form, intensities in single precision."""
    both = F.array(*(F.struct(F.lit(k).cast("long").alias("chromatogram_index"), F.col(c).cast("float").alias("intensity")) for k, c in enumerate(("tic", "bpc"))))
    return curves.select("index", "time", F.explode(both).alias("x")).select("x.chromatogram_index", "time", "x.intensity", F.col("index").alias("ordinal"))


def united(synthesized: DataFrame, source: DataFrame) -> DataFrame:
    """Synthesized chromatograms and those of the source that they don't supersede; types are compared."""
    return synthesized.unionByName(source.join(synthesized.select("type").distinct(), "type", "left_anti").select(synthesized.columns))


def or_empty(chromatograms: DataFrame) -> DataFrame:
    """One empty chromatogram where there is none."""
    spark = chromatograms.sparkSession
    none = spark.createDataFrame([(0, "TIC", "total ion current chromatogram", 0)], "index long, id string, type string, number_of_points long")
    return chromatograms if chromatograms.limit(1).count() else none


def observed_range(points: DataFrame) -> DataFrame:
    """Smallest and largest m/z of each spectrum, from positive finite values."""
    from lumenspec.operators.selection import fine_mz

    return fine_mz(points).groupBy("spectrum_index").agg(F.min("mz").alias("mz_low"), F.max("mz").alias("mz_high"))


def observed_range_of_grid(points: DataFrame, c0: float, c1: float) -> DataFrame:
    """The same for gridded points: the model rises, so only two indexes per spectrum are turned to m/z."""
    from lumenspec.functions.scalar import grid_mz

    k = points.groupBy("spectrum_index").agg(F.min("tof").alias("a"), F.max("tof").alias("b"))
    return k.select("spectrum_index", grid_mz(F.lit(c0), F.lit(c1), F.col("a")).alias("mz_low"), grid_mz(F.lit(c0), F.lit(c1), F.col("b")).alias("mz_high"))


def facet_counts(points: DataFrame) -> DataFrame:
    return points.agg(F.count("*").alias("n_points"), F.count_distinct("spectrum_index").alias("n_spectra"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunk layout: points are the lengths of the lists."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.sum(F.size("intensity")).cast("long").alias("n_points"), F.count_distinct("spectrum_index").alias("n_spectra"))


def scan_statistics(points: DataFrame) -> DataFrame:
    """Sum, non-zero count, first and last non-zero position and largest intensity of each profile scan."""
    some = F.when(F.col("intensity") != 0, F.col("ordinal"))
    return points.groupBy("spectrum_index").agg(F.count_if(F.col("intensity") != 0).alias("nnz"), F.sum("intensity").alias("total"), F.min(some).alias("first_nonzero"), F.max(some).alias("last_nonzero"), F.max("intensity").alias("most"))


def sorted_points(points: DataFrame) -> DataFrame:
    """Points by spectrum and m/z, the old order breaking ties; a range partitioning and a sort within it."""
    return points.repartitionByRange("spectrum_index").sortWithinPartitions("spectrum_index", "mz", "ordinal")
