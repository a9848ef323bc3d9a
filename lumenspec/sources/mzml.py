"""mzML as Spark data sources: ``spark.read.format("mzml").load(path)``.

One row per spectrum with its arrays (``mzml``), per selected ion of a
spectrum (``mzml_precursors``), per further array of a spectrum
(``mzml_arrays``) or per chromatogram (``mzml_chromatograms``). A plain file
is cut into byte ranges of fixed size, one per task, that read the elements
which begin there to their ends; a gzip file is one range.
"""

from __future__ import annotations

import gzip
import mmap
import re
import zlib
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenspec.functions.binary import array_of
from lumenspec.sources.xmltext import HEAD, sniffed, to_utf8, with_open_groups

SCHEMA = "index bigint, id string, time double, ms_level int, polarity string, continuity string, precursor_id string, isolation_mz double, selected_mz double, charge int, mz array<double>, intensity array<double>"
PRECURSORS = "spectrum_index bigint, ordinal int, precursor_id string, isolation_mz double, isolation_lower double, isolation_upper double, selected_mz double, selected_intensity double, charge int, activation string, collision_energy double"
ARRAYS = "spectrum_index bigint, accession string, name string, unit string, values array<double>"
CHROMATOGRAMS = "index bigint, id string, type string, accession string, isolation_mz double, product_mz double, time array<double>, intensity array<double>"
RANGE = 8 << 20
BODY = re.compile(rb"<(spectrumList|chromatogramList|spectrum|chromatogram)[\s>]")
# Accessions of the controlled vocabulary.
LEVEL, POSITIVE, NEGATIVE, CENTROID, PROFILE = "MS:1000511", "MS:1000130", "MS:1000129", "MS:1000127", "MS:1000128"
START, MINUTE, MZ, INTENSITY = "MS:1000016", "UO:0000031", "MS:1000514", "MS:1000515"
DOUBLE, FLOAT, LONG, INT, ZLIB = "MS:1000523", "MS:1000521", "MS:1000522", "MS:1000519", "MS:1000574"
X, Y, OFFSET, COUNT, ENCODED = "IMS:1000050", "IMS:1000051", "IMS:1000102", "IMS:1000103", "IMS:1000104"
TARGET, SELECTED, CHARGE = "MS:1000827", "MS:1000744", "MS:1000041"
BELOW, ABOVE, PEAK, ENERGY, TIMES = "MS:1000828", "MS:1000829", "MS:1000042", "MS:1000045", "MS:1000595"
TIC, BPC = "MS:1000235", "MS:1000628"
ACTIVATIONS = {"MS:1000133": "collision-induced dissociation", "MS:1000422": "beam-type collision-induced dissociation", "MS:1000598": "electron transfer dissociation", "MS:1000250": "electron capture dissociation", "MS:1000599": "pulsed q dissociation", "MS:1000435": "photodissociation", "MS:1000433": "low-energy collision-induced dissociation"}
TRACES = {TIC: "total ion current chromatogram", BPC: "basepeak chromatogram", "MS:1000627": "selected ion current chromatogram", "MS:1001472": "selected ion monitoring chromatogram", "MS:1001473": "selected reaction monitoring chromatogram", "MS:1000810": "ion current chromatogram", "MS:1000812": "absorption chromatogram", "MS:1000811": "electromagnetic radiation chromatogram", "MS:1000813": "emission chromatogram"}
OTHERS = {"MS:1000516": "charge array", "MS:1000517": "signal to noise array", "MS:1000786": "non-standard data array", "MS:1000820": "flow rate array", "MS:1000821": "pressure array", "MS:1000822": "temperature array", "MS:1002477": "mean drift time array", "MS:1002816": "mean ion mobility array", "MS:1003006": "mean inverse reduced ion mobility array", "MS:1003007": "raw ion mobility array", "MS:1003008": "raw inverse reduced ion mobility array", "MS:1003153": "raw ion mobility drift time array"}


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, groups: str):
        super().__init__((path, start, end))
        self.path, self.start, self.end, self.groups = path, start, end, groups


def _content(path: str) -> bytes:
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        return with_open_groups(to_utf8(f.read()).decode("utf-8", "replace")).encode()


def _params(node, groups: dict) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for ref in node.findall("referenceableParamGroupRef"):
        out |= groups.get(ref.get("ref"), {})
    return out | {p.get("accession"): (p.get("value", ""), p.get("unitAccession", "")) for p in node.findall("cvParam")}


def _array(q: dict, text: str, outside) -> list[float]:
    """An array from its base64 text, or from the place in the binary companion that its parameters name."""
    bits, whole = 64 if DOUBLE in q or LONG in q else 32, LONG in q or INT in q
    if outside is None or OFFSET not in q:
        return array_of(text, bits, whole, ZLIB in q and bool(text.strip())).tolist()
    n = int(q[COUNT][0])
    outside.seek(int(q[OFFSET][0]))
    data = zlib.decompress(outside.read(int(q[ENCODED][0]))) if ZLIB in q else outside.read(n * bits // 8)
    return np.frombuffer(data, f"<{'i' if whole else 'f'}{bits // 8}").astype(np.float64).tolist()


def _pixel(node, groups: dict) -> tuple[int | None, int | None]:
    scan = node.find("scanList/scan")
    p = _params(scan, groups) if scan is not None else {}
    return tuple(int(p[k][0]) if k in p and p[k][0] else None for k in (X, Y))


def _row(node, groups: dict, outside=None) -> tuple:
    p = _params(node, groups)
    scan = node.find("scanList/scan")
    start = _params(scan, groups).get(START) if scan is not None else None
    time = float(start[0]) / (1 if start[1] == MINUTE else 60) if start else None
    arrays = {}
    for a in node.findall("binaryDataArrayList/binaryDataArray"):
        q = _params(a, groups)
        arrays[MZ if MZ in q else INTENSITY if INTENSITY in q else None] = _array(q, a.findtext("binary") or "", outside)
    pre = node.find("precursorList/precursor")
    iso = _window(pre, groups)
    ion = pre.find("selectedIonList/selectedIon") if pre is not None else None
    sel = _params(ion, groups) if ion is not None else {}
    charge = _number(sel, CHARGE)
    return (
        int(node.get("index")), node.get("id"), time, int(p[LEVEL][0]) if LEVEL in p and p[LEVEL][0] else 1,
        "Positive" if POSITIVE in p else "Negative" if NEGATIVE in p else "Unknown",
        "Centroid" if CENTROID in p else "Profile" if PROFILE in p else None,
        pre.get("spectrumRef") if pre is not None else None, _number(iso, TARGET), _number(sel, SELECTED), int(charge) if charge else None,
        arrays.get(MZ, []), arrays.get(INTENSITY, []),
    )


def _number(d: dict, k: str) -> float | None:
    return float(d[k][0]) if k in d and d[k][0] else None


def _minutes(values: list[float], unit: str) -> list[float]:
    return values if unit == MINUTE else [v / 60 for v in values]


def _window(node, groups: dict) -> dict:
    at = node.find("isolationWindow") if node is not None else None
    return _params(at, groups) if at is not None else {}


def _precursors(node, groups: dict):
    """Every precursor's selected ions, or the precursor alone where it names none; numbered within the spectrum."""
    n = 0
    for pre in node.findall("precursorList/precursor"):
        iso, how = _window(pre, groups), pre.find("activation")
        act = _params(how, groups) if how is not None else {}
        kinds = "; ".join(v for k, v in ACTIVATIONS.items() if k in act) or None
        for ion in pre.findall("selectedIonList/selectedIon") or [None]:
            sel = _params(ion, groups) if ion is not None else {}
            charge = _number(sel, CHARGE)
            yield (int(node.get("index")), n, pre.get("spectrumRef"), _number(iso, TARGET), _number(iso, BELOW), _number(iso, ABOVE), _number(sel, SELECTED), _number(sel, PEAK), int(charge) if charge else None, kinds, _number(act, ENERGY))
            n += 1


def _arrays(node, groups: dict):
    """The arrays besides m/z and intensity; one of no known kind has neither accession nor name, unless it brings its own."""
    for a in node.findall("binaryDataArrayList/binaryDataArray"):
        q = _params(a, groups)
        if MZ in q or INTENSITY in q:
            continue
        kind = next((k for k in OTHERS if k in q), None)
        own, unit = q.get(kind, ("", ""))
        yield int(node.get("index")), kind, own or OTHERS.get(kind), unit or None, _array(q, a.findtext("binary") or "", None)


def _chromatogram(node, groups: dict) -> tuple:
    """Times in minutes, as those of spectra."""
    p, time, intensity = _params(node, groups), [], []
    for a in node.findall("binaryDataArrayList/binaryDataArray"):
        q = _params(a, groups)
        if TIMES in q:
            time = _minutes(_array(q, a.findtext("binary") or "", None), q[TIMES][1])
        elif INTENSITY in q:
            intensity = _array(q, a.findtext("binary") or "", None)
    kind = next((k for k in TRACES if k in p), None)
    return int(node.get("index")), node.get("id"), TRACES.get(kind), kind, _number(_window(node.find("precursor"), groups), TARGET), _number(_window(node.find("product"), groups), TARGET), time, intensity


def _groups(header: str) -> dict:
    bare = re.sub(r"\sxmlns(:\w+)?=\"[^\"]*\"", "", header)
    m = re.search(r"<referenceableParamGroupList.*?</referenceableParamGroupList>", bare, re.DOTALL)
    return {g.get("id"): _params(g, {}) for g in ElementTree.fromstring(m[0]).findall("referenceableParamGroup")} if m else {}


def _header(data) -> str:
    """What stands before the lists of spectra and chromatograms."""
    first = BODY.search(data)
    return with_open_groups(data[: first.start() if first else len(data)].decode("utf-8", "replace"))


def _elements(data, name: str, start: int, end: int):
    """The elements of a name that begin from ``start`` to before ``end``, each whole; one that never ends is an error."""
    begin, close = re.compile(b"<%b[\\s/>]" % name.encode()), re.compile(b"</%b\\s*>" % name.encode())
    for m in begin.finditer(data, start, min(len(data), end + len(name) + 1)):
        tag = data.find(b">", m.start())
        last = close.search(data, tag) if tag >= 0 and data[tag - 1 : tag] != b"/" else None
        if tag < 0 or (last is None and data[tag - 1 : tag] != b"/"):
            raise ValueError(f"{name} at byte {m.start()} has no end")
        yield ElementTree.fromstring(data[m.start() : last.end() if last else tag + 1].decode("utf-8", "replace"))


class MzmlReader(DataSourceReader):
    """Rows of the elements of a name, each made by ``rows``."""

    element = "spectrum"

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        """A UTF-8 file is cut into byte ranges and the driver reads its header alone; others are decoded whole in one task."""
        with (gzip.open if self.path.endswith(".gz") else open)(self.path, "rb") as f:
            head = f.read(HEAD)
        if not head:  # no partition at all would be read as one without a range
            return [Range(self.path, 0, 0, "")]
        if self.path.endswith(".gz") or sniffed(head) not in ("utf-8", "utf8", "us-ascii", "ascii"):
            return [Range(self.path, 0, -1, "")]
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            header, size = _header(data), len(data)
        return [Range(self.path, a, min(a + RANGE, size), header) for a in range(0, size, RANGE)]

    def nodes(self, partition):
        if partition.end < 0:
            data = _content(partition.path)
            groups = _groups(_header(data))
            for node in _elements(data, self.element, 0, len(data)):
                yield node, groups
            return
        if partition.start == partition.end:
            return
        groups = _groups(partition.groups)
        with open(partition.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            for node in _elements(data, self.element, partition.start, partition.end):
                yield node, groups

    def rows(self, node, groups):
        yield _row(node, groups)

    def read(self, partition):
        for node, groups in self.nodes(partition):
            yield from self.rows(node, groups)


class PrecursorReader(MzmlReader):
    def rows(self, node, groups):
        yield from _precursors(node, groups)


class ArrayReader(MzmlReader):
    def rows(self, node, groups):
        yield from _arrays(node, groups)


class ChromatogramReader(MzmlReader):
    element = "chromatogram"

    def rows(self, node, groups):
        yield _chromatogram(node, groups)


class ImzmlReader(MzmlReader):
    """Imaging runs: arrays lie in the ``.ibd`` beside the file, each spectrum has a pixel."""

    def read(self, partition):
        with open(re.sub(r"(?i)\.imzml$", ".ibd", partition.path), "rb") as outside:
            for node, groups in self.nodes(partition):
                yield (*_row(node, groups, outside), *_pixel(node, groups))


class MzmlSource(DataSource):
    kind, columns, made = "mzml", SCHEMA, MzmlReader

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return self.columns

    def reader(self, schema):
        return self.made(self.options["path"])


class ImzmlSource(MzmlSource):
    kind, columns, made = "imzml", SCHEMA + ", x int, y int", ImzmlReader


class PrecursorSource(MzmlSource):
    kind, columns, made = "mzml_precursors", PRECURSORS, PrecursorReader


class ArraySource(MzmlSource):
    kind, columns, made = "mzml_arrays", ARRAYS, ArrayReader


class ChromatogramSource(MzmlSource):
    kind, columns, made = "mzml_chromatograms", CHROMATOGRAMS, ChromatogramReader


def _read(spark: SparkSession, source: type[MzmlSource], path: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.kind).load(path)


def read_imzml(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, ImzmlSource, path)


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, MzmlSource, path)


def read_precursors(spark: SparkSession, path: str) -> DataFrame:
    """Selected ions with their isolation windows (offsets below and above the target) and activation."""
    return _read(spark, PrecursorSource, path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Arrays besides m/z and intensity, such as ion mobility or charge."""
    return _read(spark, ArraySource, path)


def read_chromatograms(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, ChromatogramSource, path)


def points(spectra: DataFrame) -> DataFrame:
    """The arrays as rows, in file order."""
    each = spectra.select(F.col("index").alias("spectrum_index"), F.posexplode(F.arrays_zip("mz", "intensity")).alias("ordinal", "x"))
    return each.select("spectrum_index", F.col("ordinal").cast("long").alias("ordinal"), "x.mz", "x.intensity")
