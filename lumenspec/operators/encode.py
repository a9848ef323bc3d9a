"""Layouts of signal data: points and chunks, deltas, scans, routing between facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.functions.scalar import grid_mz
from lumenspec.storage import saved

#: Chunks of a row group: some hundreds of thousand points, so that its bounds exclude much.
GROUP_CHUNKS = 8192


def delta_encoded(points: DataFrame, keys: list[str], value: str = "tof", order: str = "ordinal") -> DataFrame:
    """delta: the value less the one before it in its scan; the first of each scan stays absolute."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumn("delta", F.col(value) - F.lag(value, 1, 0).over(w))


def delta_decoded(points: DataFrame, keys: list[str], delta: str = "delta", order: str = "ordinal", out: str = "tof") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumn(out, F.sum(delta).over(w))


def chunked(points: DataFrame, width: float = 50.0) -> DataFrame:
    """One row per spectrum and m/z bin, lists in m/z order; bounds are the first and last m/z held.

    Points are combined map-side into lists, then sorted inside each list, so
    only one shuffle on (spectrum, bin) moves them.
    """
    held = points.groupBy("spectrum_index", F.floor(F.col("mz") / width).cast("int").alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("mz", "ordinal", "intensity"))).alias("p"))
    return held.select("spectrum_index", "chunk_no", F.element_at("p", 1)["mz"].alias("chunk_start"), F.element_at("p", -1)["mz"].alias("chunk_end"), F.col("p.mz").alias("mz_values"), F.col("p.intensity").alias("intensity"), F.col("p.ordinal").alias("ordinals"))


def unchunked(chunks: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("mz_values").alias("mz"), F.col("intensity"), F.col("ordinals").alias("ordinal"))
    return chunks.select("spectrum_index", F.explode(zipped).alias("x")).select("spectrum_index", "x.ordinal", "x.mz", "x.intensity")


def tof_chunks(points: DataFrame, c0: float, c1: float, width: float = 50.0) -> DataFrame:
    """Chunks by m/z range of points that hold lattice indexes (``tof``): bounds in m/z, indexes in rising order, as the file format packs their steps."""
    mz = grid_mz(F.lit(c0), F.lit(c1), F.col("tof"))
    bins = points.select("spectrum_index", "ordinal", "tof", "intensity", mz.alias("mz"), F.floor(mz / width).cast("int").alias("chunk_no"))
    held = bins.groupBy("spectrum_index", "chunk_no").agg(F.min("mz").alias("chunk_start"), F.max("mz").alias("chunk_end"), F.array_sort(F.collect_list(F.struct("tof", "ordinal", "intensity"))).alias("p"))
    return held.select("spectrum_index", "chunk_no", "chunk_start", "chunk_end", F.col("p.tof").alias("tof_values"), F.col("p.intensity").alias("intensity"), F.col("p.ordinal").alias("ordinals"))


def write_chunks(chunks: DataFrame, path: str, rows: int = GROUP_CHUNKS) -> None:
    """Writes chunks by m/z range and then spectrum, in row groups of so many: the bounds in their statistics are the zone map of a slice."""
    order = ["chunk_no", "spectrum_index"]
    chunks.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", rows).parquet(path)


def chunk_slice(chunks: DataFrame, low: float, high: float, values: str = "mz_values", inside: tuple[int, int] | None = None) -> DataFrame:
    """(spectrum_index, ordinal, value, intensity) of the points in a range of m/z, both ends included.

    Bounds go to the scan, so row groups outside the range are not read.
    Points are then held against the range itself, or, where ``values`` are
    lattice indexes, against the range of indexes ``inside``.
    """
    # Bounds of lattice chunks are computed: a little slack loses no point, as each is judged by itself.
    slack = 1e-9 if inside else 0.0
    near = chunks.where((F.col("chunk_end") >= low * (1 - slack)) & (F.col("chunk_start") <= high * (1 + slack)))
    zipped = F.arrays_zip(F.col(values).alias("value"), F.col("intensity"), F.col("ordinals").alias("ordinal"))
    each = near.select("spectrum_index", F.explode(zipped).alias("x")).select("spectrum_index", "x.ordinal", "x.value", "x.intensity")
    return each.where(F.col("value").between(*(inside or (low, high))))


def rising(points: DataFrame) -> DataFrame:
    """``points`` with ``place``: their order within each spectrum, turned round where the last m/z is below the first. Nothing is sorted by m/z: a profile's axis runs one way or the other."""
    w = Window.partitionBy("spectrum_index").orderBy("ordinal")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.row_number().over(w)
    falls = F.first("mz").over(all_) > F.last("mz").over(all_)
    return points.withColumn("place", F.when(falls, F.count("*").over(all_) - at).otherwise(at - 1).cast("long"))


def scans_of_offsets(frames: DataFrame) -> DataFrame:
    """The scan of each peak from an array of offsets: scan s holds peaks offsets[s] to offsets[s + 1] - 1."""
    spans = F.transform(F.sequence(F.lit(0), F.size("offsets") - 2), lambda s: F.struct(s.alias("scan"), F.element_at("offsets", s + 1).alias("a"), F.element_at("offsets", s + 2).alias("b")))
    each = frames.select("frame", F.explode(F.filter(spans, lambda x: x["b"] > x["a"])).alias("x"))
    return each.select("frame", F.col("x.scan").alias("scan"), F.explode(F.sequence(F.col("x.a"), F.col("x.b") - 1)).alias("ordinal"))


def reindexed(rows: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """A dense 0-based index in order of ``keys`` (per group of ``within``).

    Without groups the rows are range-partitioned, numbered where they lie
    and written once; the sizes of the partitions, one small row each, give
    every one its offset, so no task sees all rows.
    """
    if within:
        return rows.withColumn("index", (F.row_number().over(Window.partitionBy(*within).orderBy(*keys)) - 1).cast("long"))
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's number there
    ordered = saved(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", place), "ordered")
    part, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    before = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("index", F.col("_before") + row).drop("_p", "_before", "_at")  # a row for each partition


def integer_intensity(points: DataFrame, column: str = "intensity") -> DataFrame:
    """``points`` with counts as 32-bit integers where every one is whole and fits, else as they are."""
    v = F.col(column)
    whole = points.agg(F.coalesce(F.bool_and((v == F.floor(v)) & (F.abs(v) < 2**31)), F.lit(True))).first()[0]
    return points.withColumn(column, v.cast("int")) if whole else points


def partition_faults(whole: DataFrame, *facets: DataFrame, key: str = "spectrum_index") -> DataFrame:
    """Keys that are not in exactly one facet, with the number of facets that hold them."""
    held = facets[0].select(key).distinct()
    for f in facets[1:]:
        held = held.unionByName(f.select(key).distinct())
    n = held.groupBy(key).agg(F.count("*").alias("facets"))
    return whole.select(key).distinct().join(n, key, "full").fillna(0, ["facets"]).where(F.col("facets") != 1)
