"""Archives: an uncompressed ZIP of Parquet facets and a JSON index."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspec.sources.detect import index_member
from lumenspec.sources.members import Member, members, scan, whole
from lumenspec.storage import saved

#: Footer entries that are made anew.
OWN_KEYS = (b"ARROW:schema",)
#: Column for the row numbers of a facet's file, the order that a filtered copy keeps.
ROW = "_row"


def read_index(path: str) -> dict:
    with zipfile.ZipFile(path) as z:
        return json.loads(z.read(index_member(z)))


def extract(path: str, folder: str) -> dict[str, str]:
    """Parquet members as files, for tools that need them so; nothing here reads an archive this way."""
    out = {}
    for name, member in members(path).items():
        target = Path(folder) / name
        target.parent.mkdir(parents=True, exist_ok=True)
        with target.open("wb") as b:
            member.copy_to(b)
        out[name] = str(target)
    return out


def facet(spark: SparkSession, file: str, row: str | None = None) -> DataFrame:
    """A facet in a file of its own, with 64-bit signed keys, and the file's row numbers as ``row``; whatever its encodings, tasks read it by row groups."""
    return scan(spark, whole(file), row=row)


def read_archive(spark: SparkSession, path: str, row: str | None = None) -> dict[str, DataFrame]:
    """The facets of an archive that executors see, scanned in place."""
    return {name: scan(spark, m, row=row) for name, m in members(path).items()}


def write_facet(df: DataFrame, file: str, order: list[str], footer: dict[str, str] | None = None, level: int = 5, rows: int = 1 << 17, leave: tuple[str, ...] = ()) -> None:
    """One Parquet file in a given order, without the columns ``leave``: delta for whole-number indexes, byte-stream split for tof and intensity, plain if a column refuses.

    Tasks encode the row groups; the driver joins them and their footers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from lumenspec.sources import rowgroups

    ordered = df.orderBy(*order).drop(*leave)
    kinds = {f.name: f.dataType for f in ordered.schema}
    coded = {c: "DELTA_BINARY_PACKED" for c, k in kinds.items() if isinstance(k, (T.LongType, T.IntegerType)) and (c.endswith("_index") or c == "ordinal")}
    coded |= {c: "BYTE_STREAM_SPLIT" for c, k in kinds.items() if c in ("tof", "intensity") and isinstance(k, (T.FloatType, T.DoubleType, T.IntegerType))}
    schema = to_arrow_schema(ordered.schema)
    meta = {k.encode(): v.encode() for k, v in (footer or {}).items() if k.encode() not in OWN_KEYS}
    rowgroups.write(ordered, file, schema.with_metadata({**(schema.metadata or {}), **meta}), coded, level, rows)


class ArchiveWriter:
    """Members stored uncompressed, the index last, the whole moved into place when done."""

    def __init__(self, path: str, force: bool = False, source: str | None = None, index_name: str = "run_index.json"):
        if source and os.path.exists(path) and os.path.samefile(path, source):
            raise ValueError("an archive can't be written over its source")
        if os.path.exists(path) and not force:
            raise FileExistsError(path)
        self.index_name, self.path, self.temp = index_name, path, f"{path}.tmp"
        self.zip = zipfile.ZipFile(self.temp, "w", zipfile.ZIP_STORED)
        self.index: dict = {"files": [], "metadata": {}}

    def add(self, name: str, file: str, entity_type: str = "other", data_kind: str = "other") -> None:
        self.zip.write(file, name)
        self.index["files"].append({"name": name, "entity_type": entity_type, "data_kind": data_kind})

    def copy(self, name: str, member: Member, entity_type: str = "other", data_kind: str = "other") -> None:
        """A member of another archive, byte by byte."""
        with self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=True) as b:
            member.copy_to(b)
        self.index["files"].append({"name": name, "entity_type": entity_type, "data_kind": data_kind})

    def add_bytes(self, name: str, data: bytes, **entry) -> dict:
        """A side file, with its digest and size in the index."""
        self.zip.writestr(name, data)
        info = {"name": name, **entry, "sha256": hashlib.sha256(data).hexdigest(), "size": len(data)}
        self.index["files"].append(info)
        return info

    def close(self) -> None:
        self.zip.writestr(self.index_name, json.dumps(self.index, indent=1))
        self.zip.close()
        os.replace(self.temp, self.path)

    def abort(self) -> None:
        self.zip.close()
        os.unlink(self.temp)


def calibration_block(c0: float, c1: float) -> dict:
    """The index entry that tells how a gridded facet's m/z come back."""
    return {"model": "sqrt", "formula": "mz = (c0 + c1 * tof_index)^2", "c0": c0, "c1": c1}


def write_archive(spectra: DataFrame, path: str, force: bool = False, chromatograms: DataFrame | None = None, extra=None, layout: str = "point", width: float = 50.0, lattice: bool | str = "off") -> None:
    """Spectra (the columns of the mzML source) as an archive of metadata and signal, with TIC and BPC of the first level.

    The layout ``chunk`` stores lists for each spectrum and m/z range of ``width``, in m/z order. With the ``lattice`` auto (or true) or
    on, spectra all of whose points lie on a lattice that the run shares go to a facet of lattice indexes, whose m/z come
    back within its tolerance; where there is no such lattice, auto changes nothing and on is an error.

    Chromatograms (the columns of the mzML source) of other types follow them.
    ``extra`` gets the writer before it is closed, to add side files.
    """
    from lumenspec.operators import chrom
    from lumenspec.operators import grid
    from lumenspec.operators.encode import GROUP_CHUNKS, chunked, reindexed
    from lumenspec.plans.facets import N_POINTS
    from lumenspec.sources.mzml import BPC, TIC, TRACES, points

    read = saved(spectra, "spectra")  # a run is decoded once for all facets
    flat = points(read)
    renamed = {"ms_level": "MS_1000511_ms_level"}
    meta = read.select(F.struct(*(F.col(c).alias(renamed.get(c, c)) for c in read.columns if c not in ("mz", "intensity"))).alias("spectrum"))
    found = grid.fit(grid.sampled(read.select("index"), flat)) if lattice not in (False, "off") else None
    if lattice == "on" and not found:
        raise ValueError(f"no lattice within {grid.PPM_TOLERANCE} ppm is shared by the spectra; auto keeps their m/z as they are")
    exact, gridded = flat, None
    if found:
        dealt = saved(grid.routed(flat, found.c0, found.c1), "routed")
        exact = dealt.where("not on_grid").select(flat.columns)
        gridded = dealt.where("on_grid").select(F.struct("spectrum_index", F.col("tof_index").cast("int").alias("tof_index"), "intensity").alias("point"), "ordinal")
    if layout == "chunk":
        lists = chunked(exact, width)
        data = lists.select(F.struct("spectrum_index", "chunk_start", "chunk_end", F.lit("plain").alias("chunk_encoding"), F.col("mz_values").alias("mz_chunk_values"), "intensity").alias("chunk"), F.col("chunk_no").alias("ordinal"))
    else:
        data = exact.select(F.struct("spectrum_index", "mz", "intensity").alias("point"), "ordinal")
    curves = chrom.chromatogram_points(chrom.tic_bpc(read, flat))
    n = curves.groupBy("chromatogram_index").agg(F.count("*").alias("n"))
    made = F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("index"), F.lit(k).alias("id"), F.lit(TRACES[t]).alias("type")) for i, k, t in ((0, "TIC", TIC), (1, "BPC", BPC)))))
    named = read.sparkSession.range(1).select(made).join(n, F.col("index") == F.col("chromatogram_index"), "left").select("index", "id", "type", F.coalesce("n", F.lit(0)).alias(N_POINTS))
    if chromatograms is not None:
        kept = saved(chromatograms.where(F.col("type").isNull() | ~F.col("type").isin(TRACES[TIC], TRACES[BPC])), "chromatograms")
        numbers = reindexed(kept.select(F.col("index").alias("_source"), "id", "type", F.size("time").cast("long").alias(N_POINTS)), ["_source"]).withColumn("index", F.col("index") + 2)
        named = named.unionByName(numbers.drop("_source"))
        each = kept.select(F.col("index").alias("_source"), F.posexplode(F.arrays_zip("time", "intensity")).alias("ordinal", "x")).join(numbers.select("_source", "index"), "_source")
        curves = curves.unionByName(each.select(F.col("index").alias("chromatogram_index"), "x.time", F.col("x.intensity").cast("float").alias("intensity"), F.col("ordinal").cast("long").alias("ordinal")))
    curve_rows = curves.select(F.struct("chromatogram_index", "time", "intensity").alias("point"), "ordinal")
    chroms = named.select(F.struct("index", "id", "type", N_POINTS).alias("chromatogram"))
    facets = (
        ("spectra_metadata.parquet", meta, ["spectrum.index"], "spectrum", "metadata"),
        ("spectra_data.parquet", data, [f"{layout}.spectrum_index", "ordinal"], "spectrum", "data arrays"),
        *((("spectra_grid.parquet", gridded, ["point.spectrum_index", "ordinal"], "spectrum", "data arrays"),) if found else ()),
        ("chromatograms_metadata.parquet", chroms, ["chromatogram.index"], "chromatogram", "metadata"),
        ("chromatograms_data.parquet", curve_rows, ["point.chromatogram_index", "ordinal"], "chromatogram", "data arrays"),
    )
    out = ArchiveWriter(path, force)
    if found:
        out.index["metadata"]["calibration"] = calibration_block(found.c0, found.c1)
    try:
        folder = Path(tempfile.mkdtemp(prefix="facets-"))  # the driver's own: only it makes the archive
        for name, df, order, entity, kind in facets:
            write_facet(df, str(folder / name), order, leave=("ordinal",), **({"rows": GROUP_CHUNKS} if layout == "chunk" and name == "spectra_data.parquet" else {}))
            out.add(name, str(folder / name), entity, kind)
        if extra:
            extra(out)
        out.close()
    except BaseException:
        out.abort()
        raise


def _selected(spark: SparkSession, found: dict[str, Member], rt: tuple[float, float] | None, levels: tuple[int, ...]):
    """(facets, chosen spectra): metadata of the time range only, then signal of the range of chosen spectra only, by the statistics of their row groups."""
    from lumenspec.plans.facets import classify, survivors_of

    facets = {n: scan(spark, m, row=ROW) for n, m in found.items()}
    kinds = {n: classify(df) for n, df in facets.items()}
    if rt:
        times = {"spectrum_metadata": "spectrum.time"}
        facets |= {n: scan(spark, found[n], ranges={times[k]: rt}, row=ROW) for n, (k, _) in kinds.items() if k in times}
    chosen = survivors_of(facets, rt, levels)
    if chosen is not None:
        chosen = saved(chosen, "chosen")
        low, high = chosen.agg(F.min("index"), F.max("index")).first()
        bounds = (1, 0) if low is None else (low, high)
        facets |= {n: scan(spark, found[n], ranges={key: bounds}, row=ROW) for n, (k, key) in kinds.items() if k in ("spectrum_data", "ordinal")}
    return facets, chosen


def filter_archive(spark: SparkSession, source: str, target: str, rt: tuple[float, float] | None = None, levels: tuple[int, ...] = (), drop: tuple[str, ...] = (), force: bool = False) -> dict:
    """A filtered copy: every facet is classified by its schema and cut to the surviving spectra. Indexes and the order of rows stay as they are, counts in footers and chromatograms are made anew.

    Members are scanned in place, and only the row groups that can hold a
    survivor; those that no filter touches are copied as they are.
    """
    from lumenspec.plans.facets import COUNTS, apply_filter, counts_of, recounted

    found = {n: m for n, m in members(source).items() if not any(fnmatch.fnmatchcase(n, g) for g in drop)}
    facets, chosen = _selected(spark, found, rt, levels)
    with zipfile.ZipFile(source) as z:
        out = ArchiveWriter(target, force, source, index_member(z) or "run_index.json")
    try:
        old = read_index(source)
        known = {f["name"]: f for f in old.get("files", [])}
        dropped, folder = [], Path(tempfile.mkdtemp(prefix="facets-"))  # the driver's own: only it makes the archive
        with zipfile.ZipFile(source) as z:
            for name in z.namelist():
                if name == index_member(z):
                    continue
                if any(fnmatch.fnmatchcase(name, g) for g in drop):
                    dropped.append(name)
                    continue
                entry = {k: v for k, v in known.get(name, {"entity_type": "other", "data_kind": "other"}).items() if k in ("entity_type", "data_kind")}
                if name in facets:
                    kind, rows, _ = apply_filter(facets[name], chosen, rt)
                    if kind == "global" and rt is not None:
                        kind, rows = recounted(facets[name], facets, rt)
                    if kind == "global":
                        out.copy(name, found[name], **entry)
                    else:
                        footer = {k: v for k, v in found[name].footer().items() if k not in COUNTS} | counts_of(kind, rows)
                        file = str(folder / name.replace("/", "_"))
                        write_facet(rows, file, [ROW], footer, leave=(ROW,))
                        out.add(name, file, **entry)
                else:
                    out.add_bytes(name, z.read(name), **entry)
        out.index["metadata"] = {**old.get("metadata", {}), "filter": {"rt": list(rt) if rt else None, "ms_levels": sorted(levels), "dropped": dropped}}
        out.index["metadata"].setdefault("processing", []).append({"software": "lumenspec", "action": "filtered"})
        out.close()
    except BaseException:
        out.abort()
        raise
    return out.index
