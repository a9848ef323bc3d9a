"""The mzML sources over a hand-made run: units, empty and self-closing spectra, parameter groups, several ions, further arrays, chromatograms."""

import base64
import gzip
import hashlib
import json
import struct
import zipfile

import pytest

from lumenspec import cli
from lumenspec.sources import archive, mzml, sinks


def param(accession, value="", unit=""):
    return f'<cvParam cvRef="MS" accession="{accession}" name="" value="{value}" unitAccession="{unit}"/>'


def array(kind, values, unit="", value=""):
    text = base64.b64encode(struct.pack(f"<{len(values)}d", *values)).decode()
    return f'<binaryDataArray encodedLength="{len(text)}">{param(mzml.DOUBLE)}{param(kind, value, unit)}<binary>{text}</binary></binaryDataArray>'


def window(target, *offsets):
    return "<isolationWindow>" + param(mzml.TARGET, target) + "".join(param(k, v) for k, v in zip((mzml.BELOW, mzml.ABOVE), offsets, strict=False)) + "</isolationWindow>"


def ion(mz, *rest):
    return "<selectedIon>" + param(mzml.SELECTED, mz) + "".join(param(k, v) for k, v in zip((mzml.CHARGE, mzml.PEAK), rest, strict=False)) + "</selectedIon>"


SECOND = "UO:0000010"
RUN = f'''<?xml version="1.0" encoding="UTF-8"?>
<mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList count="2"><referenceableParamGroup id="none"/><referenceableParamGroup id="ms2">{param(mzml.LEVEL, 2)}{param(mzml.PROFILE)}</referenceableParamGroup></referenceableParamGroupList>
<run id="r"><spectrumList count="3">
<spectrum index="0" id="scan=1" defaultArrayLength="2">{param(mzml.LEVEL, 1)}<scanList><scan>{param(mzml.START, 90, SECOND)}</scan></scanList><binaryDataArrayList>{array(mzml.MZ, [100.0, 200.0])}{array(mzml.INTENSITY, [5.0, 7.0])}{array("MS:1002816", [0.9, 1.1])}{array("MS:1000786", [1.0, 2.0], value="noise é")}</binaryDataArrayList></spectrum>
<spectrum index="1" id="scan=2" defaultArrayLength="0"><referenceableParamGroupRef ref="none"/><referenceableParamGroupRef ref="ms2"/>
<precursorList><precursor spectrumRef="scan=1">{window(445.3, 0.5, 0.7)}<selectedIonList>{ion(445.34, 2, 120.5)}{ion(446.0)}</selectedIonList><activation>{param("MS:1000133")}{param(mzml.ENERGY, 35)}</activation></precursor><precursor>{window(500)}</precursor></precursorList></spectrum>
<spectrum index="2" id="empty" defaultArrayLength="0"/>
</spectrumList><chromatogramList count="3">
<chromatogram index="0" id="tic" defaultArrayLength="1">{param(mzml.TIC)}<binaryDataArrayList>{array(mzml.TIMES, [90.0], SECOND)}{array(mzml.INTENSITY, [12.0])}</binaryDataArrayList></chromatogram>
<chromatogram index="1" id="sic" defaultArrayLength="2">{param("MS:1000627")}<precursor>{window(456.7)}</precursor><product>{window(678.9)}</product><binaryDataArrayList>{array(mzml.TIMES, [30.0, 60.0], SECOND)}{array(mzml.INTENSITY, [3.0, 4.0])}</binaryDataArrayList></chromatogram>
<chromatogram index="2" id="bare" defaultArrayLength="0"/>
</chromatogramList></run></mzML>'''
SIC = ("sic", "selected ion current chromatogram", "MS:1000627", 456.7, 678.9, [0.5, 1.0], [3.0, 4.0])


@pytest.fixture(params=["plain", "gz", "latin-1", "cut"])
def run(request, tmp_path, monkeypatch):
    path = tmp_path / "run.mzML"
    if request.param == "gz":
        path = tmp_path / "run.mzML.gz"
        path.write_bytes(gzip.compress(RUN.encode()))
    elif request.param == "latin-1":
        path.write_bytes(RUN.replace("UTF-8", "ISO-8859-1", 1).encode("latin-1"))
    else:
        path.write_text(RUN, encoding="utf-8")
    if request.param == "cut":  # every element crosses borders, most ranges begin within one
        monkeypatch.setattr(mzml, "RANGE", 97)
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_spectra(spark, run):
    got = rows(mzml.read_mzml(spark, run), "index")
    assert [r[:6] for r in got] == [(0, "scan=1", 1.5, 1, "Unknown", None), (1, "scan=2", None, 2, "Unknown", "Profile"), (2, "empty", None, 1, "Unknown", None)]
    assert got[0][10:] == ([100.0, 200.0], [5.0, 7.0]) and got[1][6:10] == ("scan=1", 445.3, 445.34, 2) and got[2][10:] == ([], [])


def test_precursors(spark, run):
    how = ("collision-induced dissociation", 35.0)
    assert rows(mzml.read_precursors(spark, run), "ordinal") == [
        (1, 0, "scan=1", 445.3, 0.5, 0.7, 445.34, 120.5, 2, *how),
        (1, 1, "scan=1", 445.3, 0.5, 0.7, 446.0, None, None, *how),
        (1, 2, None, 500.0, None, None, None, None, None, None, None),
    ]


def test_arrays(spark, run):
    got = rows(mzml.read_arrays(spark, run), "accession")
    assert got == [(0, "MS:1000786", "noise é", None, [1.0, 2.0]), (0, "MS:1002816", "mean ion mobility array", None, [0.9, 1.1])]


def test_chromatograms(spark, run):
    got = rows(mzml.read_chromatograms(spark, run), "index")
    assert got == [(0, "tic", mzml.TRACES[mzml.TIC], mzml.TIC, None, None, [1.5], [12.0]), (1, *SIC), (2, "bare", None, None, None, None, [], [])]


def test_cut_file_is_an_error(spark, tmp_path):
    path = tmp_path / "cut.mzML"
    path.write_text(RUN[: RUN.index("</spectrum>") - 5])
    with pytest.raises(Exception, match="has no end"):
        mzml.read_mzml(spark, str(path)).collect()


def test_no_content(spark, tmp_path):
    for name, text in (("a.mzML", ""), ("b.mzML", "<mzML><run><spectrumList count=\"0\"></spectrumList></run></mzML>")):
        (tmp_path / name).write_text(text)
        assert mzml.read_mzml(spark, str(tmp_path / name)).count() == mzml.read_chromatograms(spark, str(tmp_path / name)).count() == 0


def test_chromatograms_written(spark, tmp_path):
    """The source's TIC gives way to the one made from the spectra, others stay; a run of chromatograms alone keeps them too."""
    source, out = str(tmp_path / "a.mzML"), str(tmp_path / "b.mzML")
    (tmp_path / "a.mzML").write_text(RUN, encoding="utf-8")
    assert cli.main([source, "-o", out]) == 0
    got = rows(mzml.read_chromatograms(spark, out), "index")
    # The spectrum without arrays is of the first level and has no time.
    assert got == [(0, "TIC", mzml.TRACES[mzml.TIC], mzml.TIC, None, None, [1.5, 0.0], [12.0, 0.0]), (1, "BPC", mzml.TRACES[mzml.BPC], mzml.BPC, None, None, [1.5, 0.0], [7.0, 0.0]), (2, *SIC), (3, "bare", None, None, None, None, [], [])]
    sinks.write_mzml(mzml.read_mzml(spark, source).limit(0), out, mzml.read_chromatograms(spark, source))
    assert mzml.read_mzml(spark, out).count() == 0 and [r[1] for r in rows(mzml.read_chromatograms(spark, out), "index")] == ["TIC", "BPC", "sic", "bare"]


def test_archive_with_chromatograms_and_samples(spark, tmp_path):
    source, a, b = (str(tmp_path / n) for n in ("a.mzML", "a.zip", "b.zip"))
    (tmp_path / "a.mzML").write_text(RUN, encoding="utf-8")
    table = tmp_path / "PXD000001.sdrf.tsv"
    table.write_bytes(b"source name\nx\n")
    assert cli.main([source, "-o", str(tmp_path / "c.mzML"), "--sdrf", str(table)]) == 1
    assert cli.main([source, "-o", a, "--sdrf", str(table)]) == 0
    facets = archive.read_archive(spark, a)
    named = rows(facets["chromatograms_metadata.parquet"].select("chromatogram.*"), "index")
    assert named == [(0, "TIC", mzml.TRACES[mzml.TIC], 2), (1, "BPC", mzml.TRACES[mzml.BPC], 2), (2, "sic", "selected ion current chromatogram", 2), (3, "bare", None, 0)]
    assert rows(facets["chromatograms_data.parquet"].select("point.*").where("chromatogram_index = 2"), "time") == [(2, 0.5, 3.0), (2, 1.0, 4.0)]
    with zipfile.ZipFile(a) as z:
        assert z.read("sample_metadata/sdrf.tsv") == table.read_bytes()
    meta = archive.read_index(a)["metadata"]
    assert meta["study"]["dataset_accession"] == "PXD000001" and meta["sample_metadata"]["sha256"] == hashlib.sha256(table.read_bytes()).hexdigest() and meta["sample_metadata"]["size_bytes"] == 14


def test_no_vendor(spark, tmp_path):
    a, b = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    (tmp_path / "a.mzML").write_text(RUN, encoding="utf-8")
    archive.write_archive(mzml.read_mzml(spark, str(tmp_path / "a.mzML")), a, extra=lambda out: out.add_bytes("vendor/x.method", b"x"))
    assert cli.main([a, "-o", b, "--no-vendor"]) == 0
    with zipfile.ZipFile(b) as z:
        assert "vendor/x.method" not in z.namelist() and json.loads(z.read("run_index.json"))["metadata"]["filter"]["dropped"] == ["vendor/x.method"]


def lattice_run(spark):
    """40 spectra on a lattice, whose gaps are of one and three steps, and one with a point off it."""
    c0, c1 = 17.32, 1.6e-4
    at = [[k for k in range(10_000 + 7 * i, 11_200 + 7 * i) if k % 7 < 5] for i in range(40)]
    runs = [(i, f"s{i}", float(i), 1, "Positive", "Centroid", None, None, None, None, [(c0 + c1 * k) ** 2 for k in ks], [float(j % 9) for j in range(len(ks))]) for i, ks in enumerate(at)]
    off = [*runs[3][10][:-1], runs[3][10][-1] + 3e-3]
    runs.append((40, "off", 40.0, *runs[3][3:10], off, runs[3][11]))
    return runs, spark.createDataFrame(runs, mzml.SCHEMA)


@pytest.mark.parametrize("layout", ["point", "chunk"])
def test_layouts_with_lattice(spark, tmp_path, layout):
    from lumenspec.functions.scalar import PPM_TOLERANCE
    from lumenspec.sources import decode

    runs, df = lattice_run(spark)
    a = str(tmp_path / "a.zip")
    archive.write_archive(df, a, layout=layout, width=1.0, lattice=True)
    facets = archive.read_archive(spark, a)
    column = facets["spectra_data.parquet"].select(f"{layout}.spectrum_index").distinct()
    assert {r[0] for r in column.collect()} == {40} and facets["spectra_grid.parquet"].select("point.spectrum_index").distinct().count() == 40
    got = rows(decode.read_spectra(spark, a), "index")
    assert [r[:10] for r in got] == [r[:10] for r in runs] and got[40] == runs[40] and [r[11] for r in got] == [r[11] for r in runs]
    assert all(abs(x - y) <= y * PPM_TOLERANCE * 1e-6 for r, s in zip(got, runs, strict=True) for x, y in zip(r[10], s[10], strict=True))


def test_settings(spark, tmp_path, capsys):
    from lumenspec.sources import decode

    source, a, config = (str(tmp_path / n) for n in ("a.mzML", "a.zip", "c.yaml"))
    (tmp_path / "a.mzML").write_text(RUN, encoding="utf-8")
    for text, fault in (('{"layuot": "chunk"}', "unknown setting: layuot"), ('{"layout": "lines"}', "no layout"), ('{"force": "yes"}', "is no bool"), ("[1]", "no settings")):
        (tmp_path / "c.yaml").write_text(text)
        assert cli.main([source, "-o", a, "--config", config]) == 1 and fault in capsys.readouterr().err
    (tmp_path / "c.yaml").write_text(json.dumps({"output": str(tmp_path / "never.zip"), "layout": "chunk", "chunk_size": 200, "no_chromatograms": True}))
    assert cli.main([source, "-o", a, "--config", config, "--chunk-size", "150"]) == 0
    chunks = archive.read_archive(spark, a)["spectra_data.parquet"].select("chunk.*").collect()
    assert sorted((r["chunk_start"], r["mz_chunk_values"]) for r in chunks) == [(100.0, [100.0]), (200.0, [200.0])]
    assert archive.read_archive(spark, a)["chromatograms_metadata.parquet"].count() == 2
    assert rows(decode.read_spectra(spark, a), "index") == rows(mzml.read_mzml(spark, source), "index")
    assert not (tmp_path / "never.zip").exists()
