"""Reports over conversion results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concatenated(*results: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results)


def size_ratios(results: DataFrame) -> DataFrame:
    """Per format and over all: number of good files, pooled ratio (sums), median ratio (middle values averaged)."""
    ok = results.where("status = 'ok'").withColumn("ratio", F.col("out_bytes") / F.col("raw_bytes"))
    agg = ok.rollup("format").agg(F.count("*").alias("n"), (F.sum("out_bytes") / F.sum("raw_bytes")).alias("pooled"), F.percentile("ratio", F.lit(0.5)).alias("median"), F.grouping("format").alias("total"))
    return agg.select(F.when(F.col("total") == 1, "all").otherwise(F.col("format")).alias("format"), "n", "pooled", "median")


def large_ratio(results: DataFrame, least: int = 20_000_000, per_point: str | None = None) -> DataFrame:
    """The same for files of at least ``least`` bytes that are no fixtures; mean ratio beside the pooled one."""
    rows = results.where((F.col("raw_bytes") >= least) & (F.col("format") != "fixture"))
    out = [F.count("*").alias("n"), (F.sum("out_bytes") / F.sum("raw_bytes")).alias("pooled"), F.avg(F.col("out_bytes") / F.col("raw_bytes")).alias("mean")]
    if per_point:
        out.append((F.sum("out_bytes") / F.nullif(F.sum(per_point), F.lit(0))).alias("bytes_per_point"))
    return rows.agg(*out)


def status_matrix(results: DataFrame) -> DataFrame:
    return results.groupBy("format").agg(F.count("*").alias("files"), *(F.count_if(F.col("status") == s).alias(s) for s in ("ok", "failed", "skipped")))


def model_histogram(calibrations: DataFrame) -> DataFrame:
    """How many files hold each model type."""
    return calibrations.select("file", F.explode("model_types").alias("model_type")).groupBy("model_type").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


def inspected(members: DataFrame, spectra: DataFrame, chromatograms: DataFrame) -> DataFrame:
    """Member, spectrum and chromatogram counts; plain counts of Parquet facets read footers only."""
    counts = [df.agg(F.count("*").alias(n)) for df, n in ((members, "members"), (spectra, "spectra"), (chromatograms, "chromatograms"))]
    return reduce(lambda a, b: a.join(b), counts)


def lossless_report(original: DataFrame, decoded: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Points that are missing, added, changed in intensity or farther than the tolerance, and the largest distance."""
    keys = ["spectrum_index", "ordinal"]
    met = original.select(*keys, F.col("mz").alias("a"), F.col("intensity").alias("ia")).join(decoded.select(*keys, F.col("mz").alias("b"), F.col("intensity").alias("ib")), keys, "full")
    e = F.abs(F.col("a") - F.col("b")) / F.col("a") * 1e6
    return met.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("ia") != F.col("ib")).alias("changed"), F.count_if(e > tolerance).alias("far"), F.max(e).alias("max_ppm"))
