"""Classification of facets by their schema, and what a filter does to each class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspec.operators import selection

#: Structs that hold signal rows.
SIGNAL = ("point", "chunk", "peak")
# Counts in a facet's footer, the count in a chromatogram's row.
COUNTS = ("spectrum_count", "spectrum_data_point_count", "chromatogram_count", "chromatogram_data_point_count")
N_POINTS = "MS_1003060_number_of_data_points"


def _field(df: DataFrame, outer: str, inner: str) -> str | None:
    for f in df.schema:
        if f.name == outer and isinstance(f.dataType, T.StructType) and inner in f.dataType.names:
            return f"{outer}.{inner}"
    return None


def classify(df: DataFrame) -> tuple[str, str | None]:
    """(class, key): spectrum data, chromatogram data, spectrum metadata, chromatogram metadata, ordinal rows, or global; a signal facet without a key is an error."""
    for kind, key in (("spectrum_data", "spectrum_index"), ("chromatogram_data", "chromatogram_index")):
        if key in df.columns:
            return kind, key
        for s in SIGNAL:
            if found := _field(df, s, key):
                return kind, found
    for kind in ("spectrum", "chromatogram"):
        if found := _field(df, kind, "index"):
            return f"{kind}_metadata", found
    if "ordinal" in df.columns:
        return "ordinal", "ordinal"
    if any(s in df.columns for s in SIGNAL):
        raise ValueError(f"a signal facet without a key: {df.columns}")
    return "global", None


def with_child(df: DataFrame, outer: str, inner: str, value) -> DataFrame:
    """``df`` with one child of a struct column replaced; a null struct stays null."""
    return df.withColumn(outer, F.when(F.col(outer).isNotNull(), F.col(outer).withField(inner, value)))


def point_counts(data: DataFrame) -> DataFrame:
    """(key, n): points of each spectrum or chromatogram of a signal facet; a chunk counts the length of its intensity list."""
    _, key = classify(data)
    outer = key.rpartition(".")[0]
    names = data.schema[outer].dataType.names if outer else data.columns
    kinds = {f.name: f.dataType for f in (data.schema[outer].dataType if outer else data.schema)}
    at = f"{outer}.intensity" if outer else "intensity"
    listed = "intensity" in names and isinstance(kinds["intensity"], T.ArrayType)
    return data.groupBy(F.col(key).cast("long").alias("key")).agg((F.sum(F.size(at)) if listed else F.count("*")).cast("long").alias("n"))


def counts_of(kind: str, rows: DataFrame) -> dict[str, str]:
    """Footer entries of a facet of this class: its spectra or chromatograms, and its points if it is a signal facet."""
    what = kind.partition("_")[0]
    if kind.endswith("_data"):
        n, total = point_counts(rows).where("key is not null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return {f"{what}_count": str(n), f"{what}_data_point_count": str(total)}
    if kind == "ordinal":
        return {"spectrum_count": str(rows.agg(F.count_distinct("ordinal")).first()[0])}
    return {f"{what}_count": str(rows.where(F.col(f"{what}.index").isNotNull()).count())}


def recounted(df: DataFrame, facets: dict[str, DataFrame], rt: tuple[float, float]) -> tuple[str, DataFrame]:
    """(class, rows): chromatogram metadata with the points that their cut curves keep, none being 0; other facets are global."""
    if classify(df)[0] != "chromatogram_metadata" or not _field(df, "chromatogram", N_POINTS):
        return "global", df
    cut = [point_counts(apply_filter(f, None, rt)[1]) for f in facets.values() if classify(f)[0] == "chromatogram_data"]
    if not cut:
        return "global", df
    n = reduce(DataFrame.unionByName, cut).groupBy("key").agg(F.sum("n").alias("_n"))
    kind = df.schema["chromatogram"].dataType[N_POINTS].dataType
    met = df.withColumn("_key", F.col("chromatogram.index").cast("long")).join(n.withColumnRenamed("key", "_key"), "_key", "left")
    return "chromatogram_metadata", with_child(met, "chromatogram", N_POINTS, F.coalesce("_n", F.lit(0)).cast(kind)).drop("_key", "_n").select(df.columns)


def survivors_of(facets: dict[str, DataFrame], rt: tuple[float, float] | None, levels: tuple[int, ...]) -> DataFrame | None:
    """The chosen spectra from the metadata facet, narrow columns only; none without a spectral filter."""
    if rt is None and not levels:
        return None
    for df in facets.values():
        if classify(df)[0] == "spectrum_metadata":
            names = df.schema["spectrum"].dataType.names
            level = next((n for n in names if n.endswith("ms_level")), None)
            time = F.col("spectrum.time").cast("double") if "time" in names else F.lit(None).cast("double")
            narrow = df.select(F.col("spectrum.index").cast("long").alias("index"), time.alias("time"), (F.col(f"spectrum.{level}").cast("int") if level else F.lit(0)).alias("ms_level"))
            return selection.survivors(narrow.where("index is not null"), rt, levels).select("index")
    raise ValueError("no spectrum metadata")


def apply_filter(df: DataFrame, chosen: DataFrame | None, rt: tuple[float, float] | None) -> tuple[str, DataFrame, list[str]]:
    """(class, rows, order) of a facet under a filter; classes without a spectrum key pass through."""
    kind, key = classify(df)
    order = [key] if key else []
    if kind == "global" or (chosen is None and rt is None):
        return "global", df, order
    if kind in ("spectrum_data", "spectrum_metadata", "ordinal") and chosen is not None:
        keyed = df.withColumn("_key", F.col(key).cast("long"))
        return kind, selection.facet_rows(keyed, chosen, "_key", keep_null=kind == "spectrum_metadata").drop("_key"), order
    if kind == "chromatogram_data" and rt is not None:
        flat = {"time": "time", "start": "time_chunk_start", "end": "time_chunk_end"}
        outer = key.rpartition(".")[0]
        at = lambda c: f"{outer}.{c}" if outer else c
        names = df.schema[outer].dataType.names if outer else df.columns
        if flat["time"] in names:
            return kind, df.where(selection.rt_window(F.col(at("time")), *rt)), order
        if flat["start"] in names:
            return kind, df.where(F.coalesce((F.col(at(flat["end"])) >= rt[0]) & (F.col(at(flat["start"])) <= rt[1]), F.lit(False))), order
    return "global", df, order
