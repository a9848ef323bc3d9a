import base64
import gzip
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspec.functions import binary
from lumenspec.plans import facets
from lumenspec.sources import archive, decode, detect, mzml, sinks, xmltext


def packed_runs(values):
    """A writer for the run-length form: every stretch without zeros is one run of the width that its largest value needs; only the first can have eight bytes."""
    stretches, zeros = [], 0
    for v in values:
        if v == 0:
            zeros += 1
        elif zeros or not stretches:
            stretches.append((zeros, [v]))
            zeros = 0
        else:
            stretches[-1][1].append(v)
    codes = [1 if max(s) < 2**7 else 2 if max(s) < 2**15 else 3 if max(s) < 2**31 else 4 for _, s in stretches] or [1]
    out = struct.pack("<Iii", len(values) | 0x90 << 24, -(stretches[0][0] if stretches else 0), -codes[0])
    for k, (_, s) in enumerate(stretches):
        form = {1: "b", 2: "h", 3: "i", 4: "q"}[codes[k]]
        out += struct.pack(f"<{len(s)}{form}", *s)
        if k + 1 < len(stretches):
            gap, code = stretches[k + 1][0], codes[k + 1]
            while form == "b" and 4 * gap + code > 128:  # a narrow mark holds few zeros: widen first
                out += struct.pack("<b", -3)
                form = "i"
            out += struct.pack(f"<{form}", -(4 * gap + code))
    return out


def test_run_lengths():
    rng = np.random.default_rng(3)
    for top in (100, 30_000, 2**31 - 1):
        for share in (0.02, 0.5, 1.0):
            values = np.where(rng.random(700) < share, rng.integers(1, top, 700, endpoint=True), 0)
            assert binary.run_lengths(packed_runs(values.tolist()), 700).tolist() == values.tolist()
    assert binary.run_lengths(packed_runs([0, 2**32 - 1, 5, 0, 0, 9]), 6).tolist() == [0, 2**32 - 1, 5, 0, 0, 9]
    long_run = [17] * 5000
    body = packed_runs(long_run)
    assert binary.run_lengths(body, 5001).tolist() == [*long_run, 0]
    assert binary.run_lengths(packed_runs([0] * 4), 4).tolist() == [0] * 4
    for bad in (body[:11], struct.pack("<iii", 0, 3, -1), struct.pack("<iii", 0, 0, -7), packed_runs([70_000, 1])[:-1]):
        with pytest.raises(ValueError):
            binary.run_lengths(bad, 5000)
    with pytest.raises(ValueError):
        binary.run_lengths(body, 4999)


def packed_lzf(data):
    """A writer for LZF: greedy references to the last place of a three-byte word, overlapping ones included."""
    out, loose, seen, i = bytearray(), bytearray(), {}, 0

    def spill():
        for k in range(0, len(loose), 32):
            out.append(min(32, len(loose) - k) - 1)
            out.extend(loose[k : k + 32])
        loose.clear()

    while i < len(data):
        at = seen.get(bytes(data[i : i + 3]))
        n = 0
        if at is not None and i - at <= 8192:
            while i + n < len(data) and n < 264 and data[at + n] == data[i + n]:
                n += 1
        if n >= 3:
            spill()
            far, size = i - at - 1, n - 2
            out.append(min(size, 7) << 5 | far >> 8)
            if size >= 7:
                out.append(size - 7)
            out.append(far & 255)
        else:
            n = 1
            loose.append(data[i])
        for k in range(i, i + n):
            seen[bytes(data[k : k + 3])] = k
        i += n
    spill()
    return bytes(out)


def test_lzf():
    rng = np.random.default_rng(4)
    for data in (b"", b"xyxyxyxyxyxyxyxyxy", b"q" * 3000, rng.integers(0, 4, 5000, np.uint8).tobytes(), rng.bytes(500)):
        assert binary.lzf(packed_lzf(data), len(data)) == data
    whole = packed_lzf(b"hello hello hello")
    for bad, size in ((whole[:-1], 17), (whole, 16), (bytes([5, 1]), 6), (bytes([32, 9]), 3), (bytes([224]), 9)):
        with pytest.raises(ValueError):
            binary.lzf(bad, size)


SCHEMA_XML = """<?xml version="1.0"?><xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
<xs:complexType name="SpectrumParamsType"><xs:sequence><xs:element name="SpectrumFormatID" type="xs:int"/><xs:element name="SpectrumOffset" type="xs:long"/>
<xs:element name="ByteCount" type="xs:int"/><xs:element name="PointCount" type="xs:int"/><!-- <xs:element name="Gone" type="xs:double"/> --></xs:sequence></xs:complexType>
<xs:complexType name="ScanRecordType"><xs:sequence><xs:element name="ScanID" type="xs:int"/><xs:element name="ScanTime" type="xs:double"/><xs:element name="MSLevel" type="xs:int"/>
<xs:element name="CalibrationID" type="xs:int"/><xs:element name="SpectrumParamValues" type="SpectrumParamsType"/></xs:sequence></xs:complexType></xs:schema>"""
CALIBRATION_XML = """<Root><DefaultCalibration DefaultCalibrationID="1"><Step><CalibrationFormula>Traditional</CalibrationFormula><Value Number="1">0.001</Value><Value Number="2">100</Value></Step>
<Step><CalibrationFormula>Polynomial</CalibrationFormula><ValueUseFlags>3</ValueUseFlags><Value Number="1">20000</Value><Value Number="2">60000</Value><Value Number="3">0.002</Value><Value Number="4">1e-7</Value></Step></DefaultCalibration>
<DefaultCalibration DefaultCalibrationID="2"><Step><CalibrationFormula>Traditional</CalibrationFormula><Value Number="1">0.002</Value><Value Number="2">50</Value></Step></DefaultCalibration></Root>"""


def profile_run(folder, scans, blocks=2, rows=None, cut=0):
    """Scans of (time, level, calibration, first, step, intensities, LZF or not), None for a scan without points."""
    acq = folder / "AcqData"
    acq.mkdir(parents=True)
    (acq / "MSScan.xsd").write_text(SCHEMA_XML)
    (acq / "DefaultMassCal.xml").write_text(CALIBRATION_XML)
    (acq / "MSTS.xml").write_text(f"<T><Segment><NumOfScans>{len(scans)}</NumOfScans></Segment></T>")
    body, records = b"", b""
    for k, (time, level, cal, first, step, values, packed) in enumerate(scans):
        head = struct.pack("<dd", first, step)
        segment = b"" if values is None else packed_lzf(head + np.array(values, "<u4").tobytes()) if packed else head + packed_runs(values)
        records += struct.pack("<idii", k, time, level, cal) + struct.pack("<iqii", 1, len(body), len(segment), len(values or [])) + b"\0" * 20 * (blocks - 1)
        body += segment
    (acq / "MSScan.bin").write_bytes(b"\0" * 0x58 + struct.pack("<I", 0x60) + b"\0" * 4 + records)
    (acq / "MSProfile.bin").write_bytes(body[: len(body) - cut])
    if rows:
        (acq / "MSMassCal.bin").write_bytes(b"\0" * 0x4C + b"".join(struct.pack("<10d", *r) + b"\0" * 4 for r in rows))
    return str(folder)


SCANS = [
    (0.1, 1, 1, 20_000.0, 0.5, [0, 3, 0, 0, 70_000, 5, 0], False),
    (0.2, 0, 2, 30_000.0, 0.25, [9, 0, 2**32 - 1], True),
    (0.3, 2, 1, 1.0, 1.0, None, False),
    (0.4, 2, 9, 20_000.0, 0.5, [0, 0, 0], False),
    (0.5, 2, 9, 40_000.0, -0.5, [1, 2, 3] * 50, True),
]


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_profile_run(spark, tmp_path, blocks):
    from lumenspec.sources import profile
    from lumenspec.sources.detect import guard

    folder = profile_run(tmp_path / "run.d", SCANS, blocks)
    assert guard(folder) == "agilent_profile"
    assert profile.records(spark, folder).count() == 5
    got = {r["index"]: r for r in profile.read_profiles(spark, folder).collect()}
    assert set(got) == {0, 1, 4}  # no points, no intensity: no row
    assert [got[i]["ms_level"] for i in (0, 1, 4)] == [1, 1, 2] and got[0]["time"] == 0.1
    assert (got[0]["tof_index"], got[0]["intensity"]) == ([1, 4, 5], [3.0, 70_000.0, 5.0])
    assert (got[1]["tof_index"], got[1]["intensity"]) == ([0, 2], [9.0, 2.0**32 - 1])
    coeff = {0: (0.001, 100), 1: (0.002, 50), 4: (0.001, 100)}  # an unknown id takes the first row
    for i, (a, b) in coeff.items():
        t0, delta = SCANS[i][3:5]
        assert got[i]["c0"] == pytest.approx(a * (t0 - b)) and got[i]["c1"] == pytest.approx(a * delta)


def test_profile_masses_and_writers(spark, tmp_path):
    from lumenspec.sources import archive, decode, profile

    folder = profile_run(tmp_path / "run.d", SCANS)
    read = profile.read_profiles(spark, folder)
    for r in profile.refined(read).collect():
        _, _, cal, t0, delta, _, _ = SCANS[r["spectrum_index"]]
        a, b = (0.002, 50) if cal == 2 else (0.001, 100)
        t = t0 + delta * r["tof_index"]
        grid = (a * (t - b)) ** 2
        fit = 0.002 + 1e-7 * max(20_000, min(60_000, t)) if cal == 1 else 0.0  # flags are by id, so an unknown one has none
        assert r["mz"] == pytest.approx(grid, rel=1e-12) and r["refined_mz"] == pytest.approx(grid - fit, rel=1e-12)
    assert {(r["calibration_id"], r["first_index"], r["use_flags"]) for r in profile.calibrations(read).collect()} == {(1, 0, 3), (2, 1, 0), (9, 4, 0)}
    spectra = profile.spectra_of(read)
    falling = next(r for r in spectra.collect() if r["index"] == 4)
    assert falling["mz"] == sorted(falling["mz"]) and falling["intensity"][:2] == [3.0, 2.0]
    archive.write_archive(spectra, str(tmp_path / "run.zip"))
    back = {r["index"]: r for r in decode.read_spectra(spark, str(tmp_path / "run.zip")).collect()}
    assert back[4]["mz"] == falling["mz"] and set(back) == {0, 1, 4}


def test_profile_run_that_was_interrupted(spark, tmp_path):
    from lumenspec.sources import profile

    rows = [[0.001, 10.0, 0, 0, 0, 0, 0, 0, 0, 0]] * 3 + [[0.003, 20.0, 0, 0, 0, 0, 0, 0, 0, 0]] * 2
    long_scans = [*SCANS[:2], (0.3, 1, 1, 5.0, 1.0, [4] * 4000, False), (0.4, 1, 1, 5.0, 1.0, [7], False), SCANS[4]]
    folder = profile_run(tmp_path / "a.d", long_scans, rows=rows)
    got = {r["index"]: r for r in profile.read_profiles(spark, folder).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and got[4]["row"][:2] == [0.003, 20.0] and got[0]["row"][1] == 10.0
    after = sum(len(struct.pack("<dd", 0, 0) + packed_runs([7])) for _ in range(1)) + len(packed_lzf(struct.pack("<dd", 40_000.0, -0.5) + np.array([1, 2, 3] * 50, "<u4").tobytes()))
    cut = profile_run(tmp_path / "b.d", long_scans, cut=after + 1)
    assert {r["index"] for r in profile.read_profiles(spark, cut).collect()} == {0, 1}
    short = profile_run(tmp_path / "c.d", SCANS, rows=rows[:3])
    with pytest.raises(ValueError, match="too short"):
        profile.records(spark, short)
    (tmp_path / "c.d" / "AcqData" / "MSMassCal.bin").unlink()
    (tmp_path / "c.d" / "AcqData" / "DefaultMassCal.xml").unlink()
    with pytest.raises(ValueError, match="calibration"):
        profile.records(spark, short)


def frame(n):
    import zstandard

    z = zstandard.ZstdCompressor().compress(np.arange(n, dtype="<f8").tobytes() + np.ones(n, "<f4").tobytes())
    return struct.pack("<II", len(z) + 8, len(z)) + z


def test_line_frame():
    tof, inten = binary.line_frame(frame(3), 3)
    assert tof.tolist() == [0, 1, 2] and inten.tolist() == [1, 1, 1]
    with pytest.raises(ValueError):
        binary.line_frame(frame(3), 2)


def test_line_run(spark, tmp_path):
    import sqlite3

    from lumenspec.sources import lineframes

    with sqlite3.connect(tmp_path / "analysis.tsf") as db:
        db.execute("CREATE TABLE GlobalMetadata (Key TEXT, Value TEXT)")
        db.executemany("INSERT INTO GlobalMetadata VALUES (?, ?)", [("MzAcqRangeLower", "100"), ("MzAcqRangeUpper", "400"), ("DigitizerNumSamples", "10")])
        db.execute("CREATE TABLE Frames (Id INT, Time REAL, MsMsType INT, Polarity TEXT, NumPeaks INT, TimsId INT)")
        db.executemany("INSERT INTO Frames VALUES (?, ?, ?, ?, ?, ?)", [(1, 60.0, 0, "+", 3, 0), (2, 90.0, 3, "-", 0, 0)])
    (tmp_path / "analysis.tsf_bin").write_bytes(frame(3))
    assert detect.detect(str(tmp_path)) == "tsf"
    rows = lineframes.read_lines(spark, str(tmp_path)).orderBy("index").collect()
    assert rows[0]["mz"] == pytest.approx([100, 121, 144]) and (rows[0]["time"], rows[0]["ms_level"], rows[0]["polarity"]) == (1.0, 1, "Positive")
    assert (rows[1]["mz"], rows[1]["ms_level"], rows[1]["id"]) == ([], 3, "frame=2")


def test_images():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 5, 8)
    assert binary.image_shape(png) == ("png", 5, 8)
    assert binary.image_shape(b"GIF89a") is None


def test_arrays_in_spark(spark):
    text = base64.b64encode(struct.pack("<2d", 1.5, 2.5)).decode()
    assert spark.createDataFrame([(text,), (None,)], "t string").select(binary.base64_doubles("t")).collect() == [([1.5, 2.5],), (None,)]


def test_charsets():
    for name, raw, want in (("ISO-8859-1", b"\xe9", "é"), ("windows-1252", b"\x80", "€"), ("windows-1252", b"\x81", "\ufffd"), ("koi8-r", b"\xe9", "é")):
        out = xmltext.to_utf8(b'<?xml version="1.0" encoding="' + name.encode() + b'"?><a>' + raw + b"</a>")
        assert want in out.decode() and b'"UTF-8"' in out


def test_groups_open():
    x = '<referenceableParamGroup id="a"/><run><referenceableParamGroup id="b"/></run>'
    assert xmltext.with_open_groups(x) == '<referenceableParamGroup id="a"></referenceableParamGroup><run><referenceableParamGroup id="b"/></run>'


def test_detect(tmp_path):
    (tmp_path / "x.raw").mkdir()
    (tmp_path / "x.raw" / "_FUNC001.DAT").touch()
    (tmp_path / "y.raw").touch()
    assert detect.detect(str(tmp_path / "x.raw")) == "waters" and detect.detect(str(tmp_path / "y.raw")) == "thermo"
    with pytest.raises(detect.UnsupportedFormat):
        detect.guard(str(tmp_path / "y.raw"))
    with pytest.raises(ValueError):
        detect.detect(str(tmp_path / "none.txt"))


SPECTRA = [(0, "scan=1", 0.5, 1, "Positive", "Centroid", None, None, None, None, [1.0, 2.0], [3.0, 4.0]), (1, "scan=2", None, 2, "Negative", "Profile", "scan=1", 445.3, 445.34, 2, [], [])]


@pytest.mark.parametrize("end", [".mzML", ".mzML.gz"])
def test_mzml_round_trip(spark, tmp_path, end):
    path = str(tmp_path / "a.mzML")
    df = spark.createDataFrame(SPECTRA, mzml.SCHEMA)
    assert sinks.write_mzml(df, path) == 2
    if end.endswith("gz"):
        with open(path, "rb") as f, gzip.open(path + ".gz", "wb") as g:
            g.write(f.read())
        path += ".gz"
    got = mzml.read_mzml(spark, path)
    assert [tuple(r) for r in got.orderBy("index").collect()] == SPECTRA
    assert mzml.points(got).count() == 2


def test_seconds_become_minutes(spark, tmp_path):
    path = tmp_path / "s.mzML"
    path.write_text('<mzML xmlns="x"><referenceableParamGroupList count="1"><referenceableParamGroup id="g"><cvParam accession="MS:1000511" value="2"/></referenceableParamGroup></referenceableParamGroupList><run><spectrumList><spectrum index="0" id="a"><referenceableParamGroupRef ref="g"/><scanList><scan><cvParam accession="MS:1000016" value="90" unitAccession="UO:0000010"/></scan></scanList></spectrum></spectrumList></run></mzML>')
    row = mzml.read_mzml(spark, str(path)).first()
    assert (row["time"], row["ms_level"], row["mz"]) == (1.5, 2, [])


def test_archive_filter(spark, tmp_path):
    meta = spark.range(4).select(F.struct(F.col("id").alias("index"), F.concat(F.lit("s"), "id").alias("id"), (F.col("id") * 10.0).alias("time"), (F.col("id") % 2 + 1).cast("short").alias("MS_1000511_ms_level")).alias("spectrum"))
    pts = spark.range(12).select(F.struct((F.col("id") % 4).alias("spectrum_index"), (F.col("id") * 1.0).alias("mz"), F.col("id").cast("float").alias("intensity")).alias("point"))
    a = str(tmp_path / "a.zip")
    w = archive.ArchiveWriter(a)
    for name, df, order in (("spectra_metadata.parquet", meta, "spectrum.index"), ("spectra_data.parquet", pts, "point.spectrum_index")):
        archive.write_facet(df, str(tmp_path / name), [order], {"note": "kept"})
        w.add(name, str(tmp_path / name))
    w.add_bytes("vendor/x_bin", b"abc")
    w.close()
    assert detect.detect(a) == "archive"
    b = str(tmp_path / "b.zip")
    index = archive.filter_archive(spark, a, b, rt=(10, 30), levels=(2,), drop=("vendor*",))
    assert index["metadata"]["filter"]["dropped"] == ["vendor/x_bin"]
    got = archive.read_archive(spark, b)
    assert sorted(r[0] for r in got["spectra_metadata.parquet"].select("spectrum.index").collect()) == [1, 3]
    assert got["spectra_data.parquet"].count() == 6
    assert all(i.compress_type == zipfile.ZIP_STORED for i in zipfile.ZipFile(b).infolist())
    assert json.loads(zipfile.ZipFile(b).read("run_index.json"))["metadata"]["processing"]
    with pytest.raises(FileExistsError):
        archive.ArchiveWriter(b)
    with pytest.raises(ValueError):
        archive.ArchiveWriter(a, force=True, source=a)


def test_byte_split_and_unsigned(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    f = str(tmp_path / "x.parquet")
    pq.write_table(pa.table({"spectrum_index": pa.array([1, 2], pa.uint64()), "intensity": pa.array([1.0, 2.0], pa.float32())}), f, use_dictionary=False, column_encoding={"intensity": "BYTE_STREAM_SPLIT", "spectrum_index": "PLAIN"})
    df = archive.facet(spark, f)
    assert dict(df.dtypes)["spectrum_index"] == "bigint" and df.agg(F.sum("intensity")).first()[0] == 3.0


def test_classes(spark):
    assert facets.classify(spark.createDataFrame([(1,)], "ordinal long")) == ("ordinal", "ordinal")
    assert facets.classify(spark.createDataFrame([("a",)], "x string")) == ("global", None)
    with pytest.raises(ValueError):
        facets.classify(spark.range(1).select(F.struct(F.lit(1.0).alias("mz")).alias("point")))


def test_side_files(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m.method").write_text("x")
    (tmp_path / "d" / "t_bin").write_bytes(b"y")
    w = archive.ArchiveWriter(str(tmp_path / "a.zip"))
    out = sinks.embed(w, str(tmp_path / "d"), lambda p: "drop" if p.endswith("_bin") else "embed")
    w.close()
    assert [(x["path"], x["action"]) for x in out] == [("m.method", "embed"), ("t_bin", "drop")]
    assert gzip.decompress(zipfile.ZipFile(tmp_path / "a.zip").read("vendor/m.method.gz")) == b"x"


def test_stream(spark, tmp_path):
    from lumenspec.streaming import watch

    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, 100.0, 2.0), (1, 1, 101.0, 5.0)], "spectrum_index long, ordinal long, mz double, intensity double").write.parquet(folder)
    q = watch.start(watch.arriving_points(spark, folder), "tic", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("tic").collect()] == [(1, 7.0, 5.0, 2)]


def test_imzml(spark, tmp_path):
    (tmp_path / "a.ibd").write_bytes(b"\0" * 16 + struct.pack("<2d", 100.0, 101.5) + struct.pack("<2f", 7.0, 8.0))
    arrays = "".join(f'<binaryDataArray><cvParam accession="{kind}" value=""/><cvParam accession="{size}" value=""/><cvParam accession="IMS:1000102" value="{at}"/><cvParam accession="IMS:1000103" value="2"/><binary/></binaryDataArray>' for kind, size, at in (("MS:1000514", "MS:1000523", 16), ("MS:1000515", "MS:1000521", 32)))
    (tmp_path / "a.imzML").write_text(f'<mzML><run><spectrumList><spectrum index="0" id="a"><scanList><scan><cvParam accession="IMS:1000050" value="3"/><cvParam accession="IMS:1000051" value="4"/></scan></scanList><binaryDataArrayList>{arrays}</binaryDataArrayList></spectrum></spectrumList></run></mzML>')
    row = mzml.read_imzml(spark, str(tmp_path / "a.imzML")).first()
    assert (row["x"], row["y"], row["mz"], row["intensity"]) == (3, 4, [100.0, 101.5], [7.0, 8.0])


def test_cli(spark, tmp_path, capsys):
    from lumenspec import cli

    path = str(tmp_path / "a.mzML")
    sinks.write_mzml(spark.createDataFrame(SPECTRA, mzml.SCHEMA), path)
    assert cli.main([path, "--inspect"]) == 0 and "2" in capsys.readouterr().out
    assert cli.main([path, "--rt", "1-2", "-o", "x"]) == 1
    (tmp_path / "y.raw").touch()
    assert cli.main([str(tmp_path / "y.raw"), "--inspect"]) == 3
    assert cli.main([path, "-o", str(tmp_path / "b.zip")]) == 0
    assert archive.read_archive(spark, str(tmp_path / "b.zip"))["spectra_data.parquet"].count() == 2
    assert cli.main([str(tmp_path / "b.zip"), "-o", str(tmp_path / "c.mzML")]) == 0
    assert [tuple(r) for r in mzml.read_mzml(spark, str(tmp_path / "c.mzML")).orderBy("index").collect()] == SPECTRA
    assert cli.main([str(tmp_path / "b.zip"), "--ms-level", "2", "-o", str(tmp_path / "d.zip")]) == 0
    assert [r["id"] for r in decode.read_spectra(spark, str(tmp_path / "d.zip")).collect()] == ["scan=2"]


def test_filtered_archive_keeps_order_and_counts(spark, tmp_path):
    import pyarrow.parquet as pq

    runs = [(i, f"s{i}", i * 1.0, 1, "Positive", "Centroid", None, None, None, None, [5.0, 3.0, 4.0, 3.0][: i % 5], [1.0, 2.0, 3.0, 4.0][: i % 5]) for i in range(300)]
    a, b = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    archive.write_archive(spark.createDataFrame(runs, mzml.SCHEMA).repartition(7), a)
    assert [tuple(r) for r in decode.read_spectra(spark, a).orderBy("index").collect()] == runs
    archive.filter_archive(spark, a, b, rt=(10, 109))
    assert [tuple(r) for r in decode.read_spectra(spark, b).orderBy("index").collect()] == runs[10:110]
    files = archive.extract(b, str(tmp_path / "x"))
    footer = lambda n: {k.decode(): v.decode() for k, v in pq.ParquetFile(files[n]).metadata.metadata.items()}
    data = footer("spectra_data.parquet")
    assert (data["spectrum_count"], data["spectrum_data_point_count"]) == ("80", "200")
    assert footer("spectra_metadata.parquet")["spectrum_count"] == "100"
    assert footer("chromatograms_data.parquet")["chromatogram_data_point_count"] == "200"
    named = archive.facet(spark, files["chromatograms_metadata.parquet"]).select("chromatogram.*").orderBy("index").collect()
    assert [tuple(r) for r in named] == [(0, "TIC", "total ion current chromatogram", 100), (1, "BPC", "basepeak chromatogram", 100)]


def test_decoded_layouts(spark):
    meta = spark.createDataFrame([(((0, "a", 0.5, 1.0)),), ((1, "b", None, None),)], "spectrum struct<index long, id string, tof_c0 double, tof_c1 double>").withColumn("_row", F.col("spectrum.index"))
    grid = spark.createDataFrame([((0, 2, 7.0), 0), ((1, 3, 8.0), 1)], "point struct<spectrum_index long, tof_index int, intensity double>, _row long")
    chunk = spark.createDataFrame([((0, "delta", [10.0, 1.0, 2.0], [1.0, 2.0, 3.0]), 0), ((0, "plain", [50.0], [4.0]), 1)], "chunk struct<spectrum_index long, chunk_encoding string, mz_chunk_values array<double>, intensity array<double>>, _row long")
    got = decode.spectra({"m": meta, "a": grid, "b": chunk}, (0.0, 2.0)).orderBy("index").collect()
    assert [(r["id"], r["mz"], r["intensity"]) for r in got] == [("a", [6.25, 10.0, 11.0, 13.0, 50.0], [7.0, 1.0, 2.0, 3.0, 4.0]), ("b", [36.0], [8.0])]
    with pytest.raises(Exception, match="coefficients"):
        decode.spectra({"m": meta, "a": grid}).collect()
    steps = spark.createDataFrame([((1, 5, 1.0), 0), ((1, 2, 1.0), 1)], "point struct<spectrum_index long, delta int, intensity double>, _row long")
    assert decode.spectra({"m": meta, "a": steps}, (0.0, 1.0)).where("index = 1").first()["mz"] == [25.0, 49.0]


def many_groups(spark, folder):
    """An archive of 1,000 spectra of ten points, metadata in ten row groups and points in twenty."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 1000
    kind = pa.struct([("index", pa.uint64()), ("time", pa.float64()), ("ms_level", pa.uint8())])
    meta = pa.table({"spectrum": pa.array([{"index": i, "time": i / 100, "ms_level": 1 + i % 2} for i in range(n)], kind), "note": pa.array([f"s{i}" for i in range(n)], pa.large_string())})
    at = np.repeat(np.arange(n), 10)
    points = pa.table({"point": pa.StructArray.from_arrays([pa.array(at, pa.uint64()), pa.array(100.0 + np.arange(10 * n) % 10), pa.array(np.ones(10 * n), pa.float32())], ["spectrum_index", "mz", "intensity"])})
    other = pa.table({"x": pa.array([1, 2, 3])})
    out = archive.ArchiveWriter(str(folder / "groups.zip"))
    for name, table, rows in (("spectra_metadata.parquet", meta, 100), ("spectra_data.parquet", points, 500), ("vendor/other.parquet", other, 3)):
        file = str(folder / name.replace("/", "_"))
        pq.write_table(table, file, row_group_size=rows)
        out.add(name, file)
    out.close()
    return str(folder / "groups.zip")


def test_members_are_scanned_in_place(spark, tmp_path, monkeypatch):
    from lumenspec.sources import members

    monkeypatch.chdir(tmp_path)
    path = many_groups(spark, tmp_path)
    before = sorted(p.name for p in tmp_path.rglob("*"))
    found = members.members(path)
    assert {k: m.rows() for k, m in found.items()} == {"spectra_metadata.parquet": 1000, "spectra_data.parquet": 10_000, "vendor/other.parquet": 3}
    data = members.scan(spark, found["spectra_data.parquet"], row="_row")
    assert data.rdd.getNumPartitions() == 20 and data.where("_row div 10 <> point.spectrum_index").count() == 0
    assert dict(members.scan(spark, found["spectra_metadata.parquet"]).dtypes) == {"spectrum": "struct<index:bigint,time:double,ms_level:smallint>", "note": "string"}
    part = members.scan(spark, found["spectra_data.parquet"], columns=["point.mz", "point.spectrum_index"], ranges={"point.spectrum_index": (250, 299)}, row="_row")
    assert part.rdd.getNumPartitions() == 1 and set(part.schema["point"].dataType.names) == {"mz", "spectrum_index"}
    assert (part.agg(F.min("_row"), F.max("_row"), F.count("*")).first()) == (2500, 2999, 500)
    none = members.scan(spark, found["spectra_data.parquet"], ranges={"point.spectrum_index": (5000, None)})
    assert none.count() == 0
    assert sorted(p.name for p in tmp_path.rglob("*")) == before  # nothing was extracted
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.parquet", b"x" * 100)
    with pytest.raises(ValueError, match="compressed"):
        members.members(str(tmp_path / "c.zip"))


def test_groups_with_nulls_are_kept(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lumenspec.sources import members

    file = str(tmp_path / "n.parquet")
    pq.write_table(pa.table({"k": pa.array([1, 2, None, 4, 5, 6])}), file, row_group_size=2)
    got = members.scan(spark, members.whole(file), ranges={"k": (5, 9), "absent": (1, 2)})
    assert [r["k"] for r in got.collect()] == [None, 4, 5, 6]


def test_filter_reads_few_groups(spark, tmp_path):
    from lumenspec.sources import members

    path = many_groups(spark, tmp_path)
    found = members.members(path)
    facets, chosen = archive._selected(spark, found, (2.5, 2.99), ())
    assert chosen.count() == 50
    assert facets["spectra_metadata.parquet"].rdd.getNumPartitions() == 1 and facets["spectra_data.parquet"].rdd.getNumPartitions() == 1
    out = str(tmp_path / "cut.zip")
    archive.filter_archive(spark, path, out, (2.5, 2.99), (2,))
    cut = members.members(out)
    assert {k: m.rows() for k, m in cut.items()} == {"spectra_metadata.parquet": 25, "spectra_data.parquet": 250, "vendor/other.parquet": 3}
    assert {r[0] for r in members.scan(spark, cut["spectra_data.parquet"]).select("point.spectrum_index").collect()} == set(range(251, 300, 2))
    archive.filter_archive(spark, path, out, (900.0, 901.0), force=True)
    assert members.members(out)["spectra_data.parquet"].rows() == 0


def test_joined_row_groups(tmp_path):
    """Joined files hold the rows, statistics and metadata of all, as another reader sees them."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lumenspec.sources import rowgroups

    parts = [pa.table({"i_index": pa.array(range(k * 100, k * 100 + 70), pa.int64()), "intensity": pa.array([float(k)] * 70, pa.float32()), "s": pa.array([f"é{k}"] * 69 + [None]), "l": pa.array([[k, k + 1]] * 70), "p": pa.array([{"a": k, "b": k > 3}] * 70)}).replace_schema_metadata({"note": "kept"}) for k in range(40)]
    files = [rowgroups.encode(t, {"i_index": "DELTA_BINARY_PACKED", "intensity": "BYTE_STREAM_SPLIT"}, 5) for t in parts]
    file = str(tmp_path / "joined.parquet")
    assert rowgroups.join(files, file) == 2800
    meta = pq.ParquetFile(file).metadata
    assert (meta.num_row_groups, meta.num_rows, meta.metadata[b"note"]) == (40, 2800, b"kept")
    assert [meta.row_group(g).column(0).statistics.min for g in range(40)] == [k * 100 for k in range(40)]
    assert pq.read_table(file).equals(pa.concat_tables(parts))
    assert duckdb.sql(f"select count(*), sum(i_index), sum(intensity), count(s), sum(p.a), count(*) filter (where p.b), sum(list_sum(l)) from '{file}'").fetchall()[0] == (2800, sum(k * 100 * 70 + 69 * 35 for k in range(40)), 70 * 780.0, 69 * 40, 70 * 780, 70 * 36, 70 * (780 * 2 + 40))
    with pytest.raises(ValueError):
        rowgroups.join([], file)


def test_facets_are_encoded_in_tasks(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(0, 50_000, 1, 8).select((F.col("id") * 7 % 50_000).alias("ordinal"), F.struct(F.col("id").alias("spectrum_index"), F.lit(1.5).alias("mz")).alias("point"), F.rand(3).cast("float").alias("intensity"), F.lit(None).cast("string").alias("gone"))
    file = str(tmp_path / "f.parquet")
    archive.write_facet(df, file, ["ordinal"], {"note": "x"}, rows=3000, leave=("gone",))
    read = pq.ParquetFile(file)
    assert read.metadata.num_rows == 50_000 and read.metadata.metadata[b"note"] == b"x"
    assert max(read.metadata.row_group(g).num_rows for g in range(read.metadata.num_row_groups)) == 3000
    assert read.read(["ordinal"])["ordinal"].to_pylist() == list(range(50_000))
    assert "BYTE_STREAM_SPLIT" in read.metadata.row_group(0).column(3).encodings
    assert spark.read.parquet(file).agg(F.sum("point.spectrum_index")).first()[0] == sum(range(50_000))
    archive.write_facet(df.where("false"), file, ["ordinal"])
    assert pq.ParquetFile(file).metadata.num_rows == 0


def test_grid_modes(spark, tmp_path, monkeypatch):
    """off stores m/z, auto falls back to it where no lattice is shared, on fails there and writes nothing."""
    from lumenspec import cli, session
    from lumenspec.sources import members

    monkeypatch.setattr(session, "session", lambda: spark)
    none = (None,) * 4  # no precursor
    k = [100_000 + 3 * i if i % 7 == 0 else 100_000 + 3 * (i - 1) + 1 for i in range(300)]
    on_grid = [(17.32 + 1.6e-5 * x) ** 2 for x in sorted(set(k))]
    drift = [400 + 0.31 * i + 0.0007 * i * i + (i * 7919 % 101) * 1e-4 for i in range(300)]

    def run(masses, mode):
        df = spark.createDataFrame([(i, f"s{i}", i / 10, 1, "positive", "Profile", *none, masses, [1.0] * len(masses)) for i in range(4)], mzml.SCHEMA)
        sinks.write_mzml(df, str(tmp_path / "in.mzML"))
        target = str(tmp_path / f"{len(list(tmp_path.iterdir()))}.zip")
        code = cli.main([str(tmp_path / "in.mzML"), "-o", target, "--no-chromatograms", f"--grid={mode}"])
        return code, set(members.members(target)) if code == 0 else (tmp_path / target).exists()

    assert run(drift, "off")[0] == 0 and "spectra_grid.parquet" not in run(on_grid, "off")[1]
    assert run(drift, "auto") == (0, run(drift, "off")[1])
    assert "spectra_grid.parquet" in run(on_grid, "auto")[1] and "spectra_grid.parquet" in run(on_grid, "on")[1]
    assert run(drift, "on") == (1, False)


# --- side tables and images


def side_file(path, tables):
    import sqlite3

    db = sqlite3.connect(path)
    for name, (columns, rows) in tables.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns.split(',')))})", rows)
    db.commit()
    db.close()
    return str(path)


DDA = ("Frame INT, ScanNumBegin INT, ScanNumEnd INT, IsolationMz REAL, IsolationWidth REAL, CollisionEnergy REAL, Precursor INT", [(2, -3, 10, 500.0, 2.0, 20.0, 1), (2, 11, 20, 600.0, 2.0, 25.0, 99), (3, 0, 5, 700.0, 3.0, 30.0, None)])
PRECURSORS = ("Id INT, MonoisotopicMz REAL, AverageMz REAL, Charge INT, Intensity REAL", [(1, 499.5, 500.1, 2, 1e4)])


def test_isolation_windows(spark, tmp_path, monkeypatch):
    from lumenspec.sources import sidetables, sqlite

    monkeypatch.setattr(sqlite, "ROWS", 2)
    got = sidetables.isolation_windows(spark, side_file(tmp_path / "a", {"PasefFrameMsMsInfo": DDA, "Precursors": PRECURSORS})).orderBy("frame", "scan_begin").collect()
    assert [(r["frame"], r["scan_begin"], r["isolation_mz"], r["mono_mz"], r["charge"]) for r in got] == [(2, 0, 500.0, 499.5, 2), (2, 11, 600.0, None, None), (3, 0, 700.0, None, None)]
    dia = {"DiaFrameMsMsInfo": ("Frame INT, WindowGroup INT", [(2, 7), (4, 7), (5, 8)]), "DiaFrameMsMsWindows": ("WindowGroup INT, " + DDA[0][11:-15], [(7, 0, 9, 400.0, 25.0, 10.0), (7, 10, 19, 425.0, 25.0, 11.0)])}
    got = sidetables.isolation_windows(spark, side_file(tmp_path / "b", dia)).orderBy("frame", "scan_begin").collect()
    assert [(r["frame"], r["isolation_mz"], r["charge"]) for r in got] == [(2, 400.0, None), (2, 425.0, None), (4, 400.0, None), (4, 425.0, None)]
    assert sidetables.isolation_windows(spark, side_file(tmp_path / "c", {"PrmFrameMsMsInfo": DDA, "Precursors": PRECURSORS})) is None
    assert sidetables.isolation_windows(spark, side_file(tmp_path / "d", {"PasefFrameMsMsInfo": (DDA[0], []), "Precursors": PRECURSORS})).count() == 0


FRAMES = ("Id INT, NumPeaks INT, NumScans INT, Time REAL, MsMsType INT, Polarity TEXT", [(1, 5, 3, 0.5, 0, "+"), (2, -1, 4, 0.7, 8, "-")])


def test_frame_table_is_dropped_if_rows_differ(spark, tmp_path):
    from lumenspec.sources import sidetables

    file = side_file(tmp_path / "a", {"Frames": FRAMES})
    rows = sidetables.frame_table(spark, file, 2).orderBy("frame").collect()
    assert [(r["n_points"], r["ms_level"], r["polarity"]) for r in rows] == [(5, 1, "Positive"), (0, 2, "Negative")]
    assert sidetables.frame_table(spark, file, 3) is None and sidetables.frame_table(spark, side_file(tmp_path / "b", {"Other": FRAMES})) is None


def test_line_spectra_tables(spark, tmp_path):
    from lumenspec.sources import sidetables

    columns, keys = "Id INT, Rt REAL, AcquisitionKey INT, LineMzId INT, LineIntensityId INT, ProfileMzId INT, ProfileIntensityId INT", "Id INT, MsLevel INT, Polarity INT"
    good = {"Spectra": (columns, [(1, None, 1, 10, 11, None, None), (2, 3.0, 2, None, None, 20, 21)]), "AcquisitionKeys": (keys, [(1, 0, 0), (2, 1, 1)])}
    rows = sidetables.line_spectra(spark, side_file(tmp_path / "a", good)).orderBy("index").collect()
    assert [(r["time"], r["ms_level"], r["polarity"], r["continuity"], r["profile_mz"]) for r in rows] == [(0.0, 1, "Positive", "Centroid", None), (3.0, 2, "Negative", "Profile", 20)]
    for k, bad in enumerate(((1, 1.0, 9, 10, 11, None, None), (1, 1.0, 1, 0, 11, None, None), (1, 1.0, 1, None, None, 5, None), (1, 1.0, 1, None, None, -5, 6), (1, 1.0, 3, 10, 11, None, None))):
        df = sidetables.line_spectra(spark, side_file(tmp_path / f"b{k}", {"Spectra": (columns, [bad]), "AcquisitionKeys": (keys, [(1, 0, 0), (3, None, 0)])}))
        with pytest.raises(Exception, match="damaged|without acquisition key"):
            df.collect()
    with pytest.raises(ValueError, match="twice"):
        sidetables.line_spectra(spark, side_file(tmp_path / "c", {"Spectra": good["Spectra"], "AcquisitionKeys": (keys, [(1, 0, 0), (1, 1, 0)])}))


def test_mobility_table(spark, tmp_path):
    from lumenspec import cli
    from lumenspec.operators import mobility

    calibration = ("Id INT, ModelType INT, C0 REAL, C1 REAL, C2 REAL, C3 REAL, C6 REAL, C7 REAL", [(1, 2, 0.0, 4.0, 200.0, 40.0, 0.5, 0.1)])
    meta = ("Key TEXT, Value TEXT", [("OneOverK0AcqRangeLower", "0.6"), ("OneOverK0AcqRangeUpper", "1.6")])
    side_file(tmp_path / "analysis.tdf", {"Frames": FRAMES, "TimsCalibration": calibration, "GlobalMetadata": meta})
    out = str(tmp_path / "table")
    assert cli.main([str(tmp_path), "--mobility-table", "-o", out]) == 0
    rows = spark.read.csv(out, header=True, inferSchema=True).orderBy("scan").collect()
    assert [r["scan"] for r in rows] == [0, 1, 2, 3] and [r["linear"] for r in rows] == pytest.approx([1.6, 1.35, 1.1, 0.85])
    offset = 0.6 * (0.1 + 0.5 * 40) - 40
    want = [(v + offset) / (0.1 + 0.5 * v) for v in (200.0, 160.0, 120.0, 80.0)]
    assert [r["recalibrated"] for r in rows] == pytest.approx(want) and [r["abs_diff"] for r in rows] == pytest.approx([abs(r["linear"] - w) for r, w in zip(rows, want, strict=True)])
    assert cli.main([str(tmp_path), "--mobility-table"]) == 1
    points = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 9.0)], "scan long, intensity double")
    frames = spark.createDataFrame([(3,)], "num_scans long")
    rows = mobility.mobility_table(frames, 0.6, 1.6, None, mobility.scan_statistics(points)).orderBy("scan").collect()
    assert [(r["scan"], r["recalibrated"], r["n_points"], r["total"]) for r in rows] == [(0, None, None, None), (1, None, 2, 5.0), (2, None, None, None)]
    assert mobility.mobility_table(frames.limit(0), 0.6, 1.6).count() == 0


def test_images_beside_a_run(tmp_path):
    run = tmp_path / "x.imzML"
    run.write_text('<mzML><cvParam value="3" accession="IMS:1000042"/><cvParam accession="IMS:1000043" name="y" value="9"/><run><cvParam accession="IMS:1000042" value="77"/>')
    assert sinks.pixel_grid(str(run)) == (3, 9) and sinks.pixel_grid(str(tmp_path)) is None
    assert sinks.discovered_image(str(run)) is None
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 5, 1)
    (tmp_path / "x-opticalimage.jpg").write_bytes(b"no image")
    (tmp_path / "x-opticalimage.png").write_bytes(png)
    found = sinks.discovered_image(str(run))
    assert found.endswith(".png")

    class Writer:
        def add_bytes(self, name, data, **entry):
            return {"name": name, **entry}

    bad = str(tmp_path / "x-opticalimage.jpg")
    got = sinks.embed_images(Writer(), [found], [bad, found, str(tmp_path / "none.png")], (3, 9))
    assert [(g["name"], g["affine"]) for g in got] == [("images/image_0000.png", [0.5, 0.0, 1.0, 0.0, 0.0, 1.0])]
    with pytest.raises(ValueError):
        sinks.embed_images(Writer(), [bad], [], (3, 9))
    with pytest.raises(ValueError):
        sinks.embed_images(Writer(), [found], [], None)
    assert sinks.embed_images(Writer(), [], [found], None) == []
