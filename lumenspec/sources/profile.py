"""Profile runs of a time-of-flight instrument: fixed-length scan records that an XML schema describes, and compressed segments, read by ranges in tasks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.functions.binary import profile_segment
from lumenspec.functions.scalar import grid_mz, native_id, polynomial_mz, profile_coefficients, refined_or_grid
from lumenspec.sources.mzml import SCHEMA

#: Names and sizes of the schema's simple types, its record types and fields, the byte that holds where records begin, and place and stride of the calibration rows.
SIMPLE = {"byte": "i1", "short": "<i2", "int": "<i4", "long": "<i8", "float": "<f4", "double": "<f8"}
RECORD, BLOCK, BLOCKS = "ScanRecordType", "SpectrumParamsType", "SpectrumParamValues"
START, MOST_BLOCKS = 0x58, 8
CALIBRATION_START, CALIBRATION_STRIDE, CALIBRATION_VALUES = 0x4C, 84, 10
#: Scans for each task, at least.
SCANS = 2000


@dataclass(frozen=True)
class Layout:
    """Where the fields of a record lie: those of the record itself, then those of its first block."""

    fields: dict[str, tuple[int, str]]
    scalar: int
    block: int

    def dtype(self, length: int) -> np.dtype:
        names = list(self.fields)
        return np.dtype({"names": names, "formats": [self.fields[n][1] for n in names], "offsets": [self.fields[n][0] for n in names], "itemsize": length})


def layout(schema: str) -> Layout:
    """The layout by the text of an XML schema; comments don't count, as what they hold isn't stored."""
    local = lambda x: x.rsplit("}", 1)[-1].rsplit(":", 1)[-1]
    kinds = {t.get("name"): [(e.get("name"), local(e.get("type"))) for e in t.iter() if local(e.tag) == "element" and e.get("name") and e.get("type")] for t in ET.fromstring(schema).iter() if local(t.tag) == "complexType" and t.get("name")}
    if not {RECORD, BLOCK} <= set(kinds):
        raise ValueError("the schema has no scan records")

    def size(kind: str, above: tuple[str, ...] = ()) -> int:
        if kind in SIMPLE:
            return np.dtype(SIMPLE[kind]).itemsize
        if kind not in kinds or kind in above:
            raise ValueError(f"unknown type {kind}")
        return sum(size(k, (*above, kind)) for _, k in kinds[kind])

    block = size(BLOCK)
    fields, at = {}, 0
    members = [name for name, _ in kinds[RECORD]]
    before = kinds[RECORD][: members.index(BLOCKS)] if BLOCKS in members else kinds[RECORD]
    scalar = size(RECORD) - block
    for base, group in ((0, before), (scalar, kinds[BLOCK])):
        at = base
        for name, kind in group:
            if kind in SIMPLE:
                fields.setdefault(name, (at, SIMPLE[kind]))
            at += size(kind)
    missing = {"ScanTime", "SpectrumOffset", "ByteCount", "PointCount"} - set(fields)
    if missing:
        raise ValueError(f"the schema lacks {sorted(missing)}")
    return Layout(fields, scalar, block)


def record_length(shape: Layout, body: int, scans: int | None) -> int:
    """Bytes of a record of one to eight blocks that tiles the ``body``: the one whose number of records is nearest to ``scans``, else the shortest."""
    fits = [n for n in (shape.scalar + k * shape.block for k in range(1, MOST_BLOCKS + 1)) if n > 0 and body % n == 0]
    if not fits:
        raise ValueError(f"no record tiles {body} bytes")
    return min(fits, key=lambda n: abs(body // n - scans) if scans else n)


def _elements(file: Path, name: str):
    if not file.exists():
        return []
    return [e for e in ET.parse(file).iter() if e.tag.rsplit("}", 1)[-1] == name]


def _texts(node, name: str) -> list[str]:
    return [(e.text or "").strip() for e in node.iter() if e.tag.rsplit("}", 1)[-1] == name]


def default_calibrations(file: Path) -> dict[int, tuple[list[float], int]]:
    """Row (coefficient, base, bounds and polynomial) and used powers of each calibration in a file of defaults; an empty row where a traditional step is missing."""
    out = {}
    for node in _elements(file, "DefaultCalibration"):
        number = node.get("DefaultCalibrationID") or ""
        if not number.lstrip("-").isdigit():
            continue
        steps = {}
        for step in (e for e in node.iter() if e.tag.rsplit("}", 1)[-1] == "Step"):
            for formula in _texts(step, "CalibrationFormula"):
                steps.setdefault(formula, step)
        values = {k: [float(v) for v in _texts(s, "Value")] for k, s in steps.items()}
        flags = _texts(steps["Polynomial"], "ValueUseFlags") if "Polynomial" in steps else []
        first = values.get("Traditional", [])[:2]
        row = [*first, *values.get("Polynomial", [])[: CALIBRATION_VALUES - 2]] if len(first) == 2 else []
        out[int(number)] = (row + [0.0] * (CALIBRATION_VALUES - len(row)) if row else [], int(flags[0]) if flags and flags[0].isdigit() else 0)
    return out


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(index, time, ms_level, calibration_id, offset, byte_count, point_count, row, flags) of all scan records of a run's folder, which executors see.

    The driver reads the schema and the file's start; tasks read ranges of
    records. A level of 0 or none is 1. Calibration rows come from the file
    that has one for each scan, which must be long enough, else from the
    defaults by id, with the first of them where an id is unknown.
    """
    data = Path(folder) / "AcqData"
    file, rows_file = data / "MSScan.bin", data / "MSMassCal.bin"
    shape = layout((data / "MSScan.xsd").read_text(encoding="utf-8-sig"))
    total = file.stat().st_size
    with file.open("rb") as f:
        head = f.read(START + 4)
    if len(head) < START + 4:
        raise ValueError("the scan file is too short")
    start = int.from_bytes(head[START:], "little")
    if start > total:
        raise ValueError("records begin past the end of the scan file")
    counts = [int(e.text) for e in _elements(data / "MSTS.xml", "NumOfScans") if (e.text or "").strip().isdigit()]
    length = record_length(shape, total - start, sum(counts) or None)
    n = (total - start) // length
    if not n:
        raise ValueError("no scan records")
    defaults = default_calibrations(data / "DefaultMassCal.xml")
    rows = {k: r for k, (r, _) in defaults.items() if r}
    flags = {k: f for k, (_, f) in defaults.items()}
    each = rows_file.exists()
    if each and rows_file.stat().st_size < CALIBRATION_START + (n - 1) * CALIBRATION_STRIDE + 8 * CALIBRATION_VALUES:
        raise ValueError("the calibration file is too short")
    if not each and not rows:
        raise ValueError("a run without calibration")
    kind, named, cal_named = shape.dtype(length), str(file), str(rows_file)
    stride = np.dtype({"names": ["row"], "formats": [("<f8", CALIBRATION_VALUES)], "itemsize": CALIBRATION_STRIDE})

    def span(path: str, at: int, size: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(size)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            first, k = int(ids[0]), len(ids)
            found = np.frombuffer(span(named, start + first * length, k * length), kind)
            zero = np.zeros(k, np.int64)
            level = found["MSLevel"].astype(np.int64) if "MSLevel" in kind.names else zero
            calibration = found["CalibrationID"].astype(np.int64) if "CalibrationID" in kind.names else zero
            if each:
                block = span(cal_named, CALIBRATION_START + first * CALIBRATION_STRIDE, k * CALIBRATION_STRIDE)
                row = np.frombuffer(block.ljust(k * CALIBRATION_STRIDE, b"\0"), stride)["row"].tolist()
            else:
                row = [rows.get(c, next(iter(rows.values()))) for c in calibration.tolist()]
            cols = [ids, found["ScanTime"].astype(np.float64), np.where((level < 1), 1, np.minimum(level, 255)), calibration, *(found[c].astype(np.int64) for c in ("SpectrumOffset", "ByteCount", "PointCount")), row, [flags.get(c, 0) for c in calibration.tolist()]]
            kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["index", "time", "ms_level", "calibration_id", "offset", "byte_count", "point_count", "row", "flags"])

    return spark.range(0, n, 1, max(1, min(-(-n // SCANS), 10_000))).mapInArrow(run, "index long, time double, ms_level int, calibration_id int, offset long, byte_count long, point_count long, row array<double>, flags long")


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Spectra (index, id, time, ms_level, calibration_id, c0, c1, t0, delta, row, flags, tof_index, intensity) of a profile run.

    Only points with an intensity are kept; m/z is (c0 + c1 * tof_index)^2.
    Scans without points or bytes, and those without any intensity, have no
    row. The first scan whose segment passes the end of the file ends the run,
    as acquisition was interrupted there.
    """
    data = Path(folder) / "AcqData" / "MSProfile.bin"
    size, named = data.stat().st_size, str(data)
    found = records(spark, folder)
    held = found.where("point_count > 0 and byte_count > 0")
    past = held.where(F.col("offset") + F.col("byte_count") > size).agg(F.min("index").alias("past"))
    whole = held.join(F.broadcast(past), F.col("past").isNull() | (F.col("index") < F.col("past"))).drop("past")  # one row is broadcast

    kept = ["index", "time", "ms_level", "calibration_id", "row", "flags"]

    def run(batches):
        with open(named, "rb") as f:
            for batch in batches:
                first, step, index, intensity = [], [], [], []
                for scan, offset, count, n in zip(*(batch.column(c).to_pylist() for c in ("index", "offset", "byte_count", "point_count")), strict=True):
                    f.seek(offset)
                    try:
                        t0, delta, values = profile_segment(f.read(count), n)
                    except ValueError as e:
                        raise ValueError(f"scan {scan}: {e}") from e
                    at = np.flatnonzero(values)
                    first.append(t0)
                    step.append(delta)
                    index.append(at.astype(np.int32))
                    intensity.append(values[at].astype(np.float64))
                made = [pa.array(first, pa.float64()), pa.array(step, pa.float64()), pa.array(index, pa.list_(pa.int32())), pa.array(intensity, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *made], [*kept, "t0", "delta", "tof_index", "intensity"])

    spectra = whole.mapInArrow(run, "index long, time double, ms_level int, calibration_id int, row array<double>, flags long, t0 double, delta double, tof_index array<int>, intensity array<double>").where("size(tof_index) > 0")
    c0, c1 = profile_coefficients(F.col("t0"), F.col("delta"), F.col("row")[0], F.col("row")[1])
    return spectra.select("index", native_id("scan_id", F.col("index") + 1).alias("id"), "time", "ms_level", "calibration_id", c0.alias("c0"), c1.alias("c1"), "t0", "delta", "row", "flags", "tof_index", "intensity")


def _mz(k) -> tuple:
    """m/z of a lattice index by the grid, and by the calibration's polynomial where it gives one."""
    row, grid = F.col("row"), grid_mz(F.col("c0"), F.col("c1"), k)
    poly = polynomial_mz(F.col("t0") + F.col("delta") * k, row[0], row[1], row[2], row[3], F.slice(row, 5, 6), F.col("flags"))
    return grid, refined_or_grid(poly, row[0], grid)


def refined(profiles: DataFrame) -> DataFrame:
    """(spectrum_index, ordinal, tof_index, mz, refined_mz, intensity): a row for each point."""
    each = profiles.select(F.col("index").alias("spectrum_index"), "c0", "c1", "t0", "delta", "row", "flags", F.posexplode(F.arrays_zip("tof_index", "intensity")).alias("ordinal", "x"))
    grid, poly = _mz(F.col("x.tof_index"))
    return each.select("spectrum_index", F.col("ordinal").cast("long").alias("ordinal"), "x.tof_index", grid.alias("mz"), poly.alias("refined_mz"), "x.intensity")


def spectra_of(profiles: DataFrame, exact: bool = True) -> DataFrame:
    """The columns of the mzML source, for the writers: m/z by the polynomial, or by the grid alone, in rising order. Nothing is shuffled."""
    points = F.array_sort(F.transform(F.arrays_zip("tof_index", "intensity"), lambda x: F.struct(_mz(x["tof_index"])[exact].alias("mz"), x["intensity"].alias("intensity"))))
    kinds = dict(c.split(" ") for c in SCHEMA.split(", "))
    read = profiles.select("index", "id", "time", "ms_level", F.lit("Profile").alias("continuity"), points.alias("p"))
    made = {"mz": F.col("p.mz"), "intensity": F.col("p.intensity")} | {c: F.col(c) for c in ("index", "id", "time", "ms_level", "continuity")}
    return read.select(*(made.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def calibrations(profiles: DataFrame) -> DataFrame:
    """(calibration_id, first_index, coeff, base, left, right, poly, use_flags) of each calibration, by the spectrum that uses it first."""
    first = profiles.groupBy("calibration_id").agg(F.min_by(F.struct("index", "row", "flags"), "index").alias("f"))
    row = F.col("f.row")
    return first.select("calibration_id", F.col("f.index").alias("first_index"), *(row[k].alias(c) for k, c in enumerate(("coeff", "base", "left", "right"))), F.slice(row, 5, 6).alias("poly"), F.col("f.flags").alias("use_flags"))
