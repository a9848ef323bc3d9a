"""Side tables of time-of-flight runs in SQLite: frames, isolation windows and line spectra.

Which tables a run has tells how it was acquired, so their names are looked up
before anything is read. Rows are read in tasks and meet in Spark joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.functions.scalar import level, polarity
from lumenspec.operators import calibration
from lumenspec.sources import sqlite

# Tables of data-dependent and of data-independent runs, and the columns of a window.
DEPENDENT = {"PasefFrameMsMsInfo", "Precursors"}
INDEPENDENT = {"DiaFrameMsMsInfo", "DiaFrameMsMsWindows"}
WINDOW = "ScanNumBegin long, ScanNumEnd long, IsolationMz double, IsolationWidth double, CollisionEnergy double"
PRECURSOR = {"MonoisotopicMz": ("mono_mz", "double"), "AverageMz": ("average_mz", "double"), "Charge": ("charge", "int"), "Intensity": ("intensity", "double")}


def isolation_windows(spark: SparkSession, file: str) -> DataFrame | None:
    """(frame, scan_begin, scan_end, isolation_mz, isolation_width, collision_energy, mono_mz, average_mz, charge, intensity) of a run's fragment frames.

    A data-dependent run keeps a window whose precursor is unknown; a
    data-independent one has all windows of each frame's group and no
    precursors. Other runs, such as targeted ones, have none, as have runs
    of the first level. Scans below 0 count as 0.
    """
    held = sqlite.tables(file)
    if DEPENDENT <= held:
        windows = sqlite.read(spark, file, "PasefFrameMsMsInfo", f"Frame long, {WINDOW}, Precursor long")
        known = sqlite.read(spark, file, "Precursors", "Id long, " + ", ".join(f"{c} {t}" for c, (_, t) in PRECURSOR.items()))
        rows = calibration.dda_windows(windows.withColumnRenamed("Precursor", "precursor"), known.withColumnRenamed("Id", "precursor"))
    elif INDEPENDENT <= held:
        frames = sqlite.read(spark, file, "DiaFrameMsMsInfo", "Frame long, WindowGroup long").withColumnRenamed("WindowGroup", "window_group")
        groups = sqlite.read(spark, file, "DiaFrameMsMsWindows", f"WindowGroup long, {WINDOW}").withColumnRenamed("WindowGroup", "window_group")
        rows = calibration.dia_windows(frames, groups).select("*", *(F.lit(None).cast(t).alias(c) for c, (_, t) in PRECURSOR.items()))
    else:
        return None
    scan = lambda c: F.greatest(F.col(c), F.lit(0))
    return rows.select(
        F.col("Frame").alias("frame"), scan("ScanNumBegin").alias("scan_begin"), scan("ScanNumEnd").alias("scan_end"), F.col("IsolationMz").alias("isolation_mz"),
        F.col("IsolationWidth").alias("isolation_width"), F.col("CollisionEnergy").alias("collision_energy"), *(F.col(c).alias(n) for c, (n, _) in PRECURSOR.items()),
    )


def frame_table(spark: SparkSession, file: str, frames: int | None = None) -> DataFrame | None:
    """(frame, n_points, num_scans, time, ms_level, polarity) of each frame; none if the file lacks it, or if ``frames`` says that the signal has another number of them."""
    if "Frames" not in sqlite.tables(file):
        return None
    rows = sqlite.read(spark, file, "Frames", "Id long, NumPeaks long, NumScans long, Time double, MsMsType int, Polarity string")
    if frames is not None and rows.count() != frames:
        return None  # places would not be ids
    return rows.select(F.col("Id").alias("frame"), F.greatest("NumPeaks", F.lit(0)).alias("n_points"), F.col("NumScans").alias("num_scans"), F.col("Time").alias("time"), level("frame", F.col("MsMsType")).alias("ms_level"), polarity(F.col("Polarity")).alias("polarity"))


def line_spectra(spark: SparkSession, file: str) -> DataFrame:
    """(index, time, line_mz, line_intensity, profile_mz, profile_intensity, ms_level, polarity, continuity) from the tables of spectra and acquisition keys.

    Numbers of arrays are null where a spectrum lacks one. A spectrum without a
    whole key, a number below 1 or one array of a pair is an error when the rows
    are read; a join that changes the number of spectra is one at once.
    """
    arrays = {"LineMzId": "line_mz", "LineIntensityId": "line_intensity", "ProfileMzId": "profile_mz", "ProfileIntensityId": "profile_intensity"}
    stored = sqlite.read(spark, file, "Spectra", "Id long, Rt double, AcquisitionKey long, " + ", ".join(f"{c} long" for c in arrays))
    spectra = stored.select(F.col("Id").alias("index"), F.coalesce("Rt", F.lit(0.0)).alias("time"), F.col("AcquisitionKey").alias("acquisition_key"), *(F.col(c).alias(n) for c, n in arrays.items()))
    sign = F.when(F.col("Polarity") == 0, "Positive").when(F.col("Polarity") == 1, "Negative").otherwise("Unknown")
    keys = sqlite.read(spark, file, "AcquisitionKeys", "Id long, MsLevel int, Polarity int").where("MsLevel is not null and Polarity is not null")
    keys = keys.select(F.col("Id").alias("acquisition_key"), level("rising", F.col("MsLevel")).alias("ms_level"), sign.alias("polarity"))
    if not keys.groupBy("acquisition_key").count().where("count > 1").isEmpty():
        raise ValueError(f"an acquisition key occurs twice: {file}")
    one_only = F.col("profile_mz").isNull() != F.col("profile_intensity").isNull()
    bad = one_only | (F.coalesce(F.least("profile_mz", "profile_intensity"), F.lit(1)) <= 0)
    met = calibration.line_spectra(spectra, keys).withColumn("ms_level", F.when(bad, F.raise_error(F.lit("arrays of a spectrum are damaged"))).otherwise(F.col("ms_level")))
    return met.drop("acquisition_key")
