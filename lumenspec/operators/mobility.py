"""Diagnostics of ion mobility: what a run's scans stand for under each model, beside what lies in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.functions.scalar import inverse_mobility, linear_mobility, mobility_voltage
from lumenspec.operators.calibration import frame_extent, mobility_model


def scan_statistics(points: DataFrame) -> DataFrame:
    """(scan, n_points, total, most) of points (scan, intensity); points without a scan are left out."""
    return points.where("scan is not null").groupBy("scan").agg(F.count("*").alias("n_points"), F.sum("intensity").alias("total"), F.max("intensity").alias("most"))


def mobility_table(frames: DataFrame, low: float, high: float, models: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """(scan, linear, recalibrated, abs_diff) of every scan of the longest frame, with the columns of ``statistics`` (by scan) if given.

    ``linear`` falls from ``high`` to ``low``; ``recalibrated`` follows the
    rational model of ``models`` (id, model_type, c0, c1, c2, c3, c6, c7), null
    where there is none of type 2. Without frames there are no scans.
    """
    scans = frame_extent(frames).where("max_scans > 0").select("max_scans", F.explode(F.sequence(F.lit(0).cast("long"), F.col("max_scans").cast("long") - 1)).alias("scan"))
    linear = linear_mobility(F.col("scan"), F.col("max_scans"), F.lit(low), F.lit(high))
    c = {k: F.col(f"_{k}") for k in ("c0", "c1", "c2", "c3", "c6", "c7")}
    if models is None:
        out = scans.select("scan", linear.alias("linear"), F.lit(None).cast("double").alias("recalibrated"))
    else:
        one = mobility_model(models).select(F.lit(1).alias("_one"), *(F.col(k).cast("double").alias(f"_{k}") for k in c))
        met = scans.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one", "left")  # one row is broadcast
        voltage = mobility_voltage(F.col("scan").cast("double"), c["c0"], c["c1"], c["c2"], c["c3"])
        out = met.select("scan", linear.alias("linear"), inverse_mobility(voltage, c["c3"], c["c6"], c["c7"], F.lit(low)).alias("recalibrated"))
    out = out.withColumn("abs_diff", F.abs(F.col("linear") - F.col("recalibrated")))
    return out if statistics is None else out.join(statistics, "scan", "left")


def write_table(table: DataFrame, path: str, force: bool = False) -> None:
    """A table as CSV files with a header, written by tasks in order of scans."""
    table.repartitionByRange("scan").sortWithinPartitions("scan").write.mode("overwrite" if force else "error").csv(path, header=True)
