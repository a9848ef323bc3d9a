"""Archives back to spectra: points, chunks, deltas and lattice indexes become m/z and intensity arrays."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspec.functions.scalar import grid_mz
from lumenspec.operators.encode import delta_decoded
from lumenspec.plans.facets import classify
from lumenspec.sources import archive
from lumenspec.sources.mzml import SCHEMA

ROW = archive.ROW
LISTS = ("mz", "intensity")


def child(df: DataFrame, outer: str, end: str) -> str | None:
    """The child of a struct column that is named so, or whose name ends so after a term's accession."""
    names = df.schema[outer].dataType.names
    return next((f"{outer}.{n}" for n in names if n == end or n.endswith(f"_{end}")), None)


def metadata(df: DataFrame) -> DataFrame:
    """The mzML source's columns without arrays, and the lattice of each spectrum; what a facet lacks is null."""
    kinds = {f.name: f.dataType for f in T.StructType.fromDDL(SCHEMA)}
    held = df.where("spectrum.index is not null")
    pick = lambda c, k: (F.col(found) if (found := child(df, "spectrum", c)) else F.lit(None)).cast(k).alias(c)
    return held.select(*(pick(c, k) for c, k in kinds.items() if c not in LISTS), pick("tof_c0", "double"), pick("tof_c1", "double"))


def signal(df: DataFrame) -> DataFrame:
    """(spectrum_index, place, mz, k, intensity) of a signal facet that has its rows' numbers: k is a lattice index where it stores those instead of m/z.

    Values come from a column or list of m/z, of ``tof`` or ``tof_index``, or of ``delta``, whose first in each scan is absolute;
    a chunk whose ``chunk_encoding`` is delta holds a first absolute value and steps.
    """
    _, key = classify(df)
    outer = key.rpartition(".")[0]
    flat = df.select(ROW, f"{outer}.*") if outer else df
    flat = flat.withColumn("spectrum_index", F.col("spectrum_index").cast("long"))
    names = flat.columns
    listed = next((n for n in names if n.endswith("_values")), None)
    if listed:
        steps = F.col("chunk_encoding") == "delta" if "chunk_encoding" in names else F.lit(False)
        each = flat.select("spectrum_index", ROW, steps.alias("_steps"), F.posexplode(F.arrays_zip(F.col(listed).alias("v"), F.col("intensity").alias("i"))).alias("_at", "x"))
        each = each.select("spectrum_index", ROW, "_at", F.coalesce("_steps", F.lit(False)).alias("_steps"), F.col("x.v").cast("double").alias("v"), F.col("x.i").cast("double").alias("intensity"))
        if "chunk_encoding" in names:
            summed = delta_decoded(each.where("_steps"), ["spectrum_index", ROW], "v", "_at", "v")
            each = each.where("not _steps").unionByName(summed)
        gridded = listed.startswith("tof")
    else:
        source = next(n for n in ("mz", "tof_index", "tof", "delta") if n in names)
        each = flat.withColumn("_at", F.lit(0))
        if source == "delta":
            each = delta_decoded(each, [c for c in ("spectrum_index", "scan") if c in names], "delta", ROW, "delta")
        each = each.select("spectrum_index", ROW, "_at", F.col(source).cast("double").alias("v"), F.col("intensity").cast("double").alias("intensity"))
        gridded = source != "mz"
    value, none = F.col("v"), F.lit(None).cast("double")
    return each.select("spectrum_index", F.struct(ROW, "_at").alias("place"), (none if gridded else value).alias("mz"), (value if gridded else none).alias("k"), "intensity")


def spectra(facets: dict[str, DataFrame], lattice: tuple[float, float] | None = None) -> DataFrame:
    """One row per spectrum with its arrays, as the mzML source gives them.

    Facets carry their rows' numbers as ``_row``. Points stand in the order of their facet, facets in the order of their names;
    ``lattice`` (c0, c1) serves spectra without coefficients of their own. A lattice index without any is an error, as its m/z is unknown.
    """
    kinds = {n: classify(f)[0] for n, f in sorted(facets.items())}
    meta = next((metadata(facets[n]) for n, k in kinds.items() if k == "spectrum_metadata"), None)
    if meta is None:
        raise ValueError("no spectrum metadata")
    parts = [signal(facets[n]).withColumn("place", F.struct(F.lit(i).alias("part"), "place")) for i, n in enumerate(kinds) if kinds[n] == "spectrum_data"]
    columns = [c for c in meta.columns if c not in ("tof_c0", "tof_c1")]
    if not parts:
        return meta.select(*columns, *(F.array().cast("array<double>").alias(c) for c in LISTS))
    rows = reduce(DataFrame.unionByName, parts)
    held = rows.groupBy(F.col("spectrum_index").alias("index")).agg(F.array_sort(F.collect_list(F.struct("place", "mz", "k", "intensity"))).alias("p"))
    c0, c1 = (F.coalesce(f"tof_c{i}", F.lit(lattice[i] if lattice else None).cast("double")) for i in (0, 1))
    unknown = F.raise_error(F.lit("a lattice index without its coefficients")).cast("double")

    def mz(p):
        return F.when(p["k"].isNull(), p["mz"]).when((c0 + c1).isNull(), unknown).otherwise(grid_mz(c0, c1, p["k"]))

    empty = F.array().cast("array<double>")
    lists = (F.coalesce(F.transform("p", mz), empty).alias("mz"), F.coalesce(F.col("p.intensity"), empty).alias("intensity"))
    return meta.join(held, "index", "left").select(*columns, *lists)


def read_spectra(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """The spectra of an archive; members that a glob of ``drop`` names are left out."""
    facets = {n: f for n, f in archive.read_archive(spark, path, row=ROW).items() if not any(fnmatch.fnmatchcase(n, g) for g in drop)}
    block = archive.read_index(path).get("metadata", {}).get("calibration") or {}
    return spectra(facets, (block["c0"], block["c1"]) if {"c0", "c1"} <= block.keys() else None)
