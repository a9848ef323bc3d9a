import math
import random

import pytest
from pyspark.sql import functions as F

from lumenspec.functions import scalar, text
from lumenspec.operators import calibration, chrom, encode, grid, selection, vendor


def test_ranges():
    assert selection.parse_range("10-") == (10, math.inf)
    assert selection.parse_range("-30") == (-math.inf, 30)
    for bad in ("10", "5-1"):
        with pytest.raises(ValueError):
            selection.parse_range(bad)
    with pytest.raises(NotImplementedError):
        selection.survivors(None, mz=(1, 2))


def test_window_drops_null_and_nan(spark):
    s = spark.createDataFrame([(1, 5.0, 1), (2, None, 1), (3, float("nan"), 1), (4, 10.0, None)], "index long, time double, ms_level int")
    assert [r[0] for r in selection.survivors(s, (5, 10)).orderBy("index").collect()] == [1, 4]
    assert [r[0] for r in selection.survivors(s, levels={0}).collect()] == [4]
    assert selection.survivors(s).count() == 4


def test_tic_of_empty_spectra(spark):
    s = spark.createDataFrame([(1, 0.1, 1), (2, 0.2, 1), (3, 0.3, 2)], "index long, time double, ms_level int")
    p = spark.createDataFrame([(1, 2.0), (1, 3.0), (3, 9.0)], "spectrum_index long, intensity double")
    assert sorted(map(tuple, chrom.tic_bpc(s, p).collect())) == [(1, 0.1, 5.0, 3.0), (2, 0.2, 0.0, 0.0)]


def test_delta_of_scans(spark):
    scans = [[10, 12, 500, 501, 402000], [3, 400000], [7], []]
    rows = [(1, s, i, t) for s, v in enumerate(scans) for i, t in enumerate(v)]
    p = spark.createDataFrame(rows, "frame long, scan int, ordinal int, tof long")
    coded = encode.delta_encoded(p, ["frame", "scan"])
    assert [r["delta"] for r in coded.where("scan = 0").orderBy("ordinal").collect()] == [10, 2, 488, 1, 401499]
    assert sorted(tuple(r) for r in encode.delta_decoded(coded.drop("tof"), ["frame", "scan"]).select("frame", "scan", "ordinal", "tof").collect()) == sorted(rows)


def test_lattice_needs_two_probes(spark):
    def pts(n):
        k = "100000 + x * 1000 + s"
        df = spark.range(n).selectExpr("id spectrum_index", "id s").selectExpr("spectrum_index", "s", "explode(sequence(0, 400)) x").selectExpr("spectrum_index", f"{k.replace('x * 1000', 'x')} k")
        return df.select("spectrum_index", scalar.grid_mz(F.lit(14.0), F.lit(1e-3), F.col("k").cast("double")).alias("mz"))

    got = grid.fit(pts(2))
    assert got and got.median_dk == 1 and abs(got.c1 - 1e-3) < 1e-9
    assert grid.fit(pts(1)) is None
    drift = spark.range(2).selectExpr("id spectrum_index", "explode(sequence(1, 2000)) x").selectExpr("spectrum_index", "100 + x * 0.37D + sin(x) * 0.11D + x * x * 1e-5D mz")
    assert grid.fit(drift) is None


def test_routing(spark):
    good = [(1, i, (14 + 1e-4 * (i * 7)) ** 2) for i in range(400)]
    bad = [(2, i, 200 + i * 0.777) for i in range(50)]
    out = grid.routed(spark.createDataFrame(good + bad, "spectrum_index long, ordinal int, mz double"), 14.0, 1e-4)
    assert {(r[0], r[1]) for r in out.select("spectrum_index", "on_grid").distinct().collect()} == {(1, True), (2, False)}


def test_rounding_and_limits(spark):
    df = spark.createDataFrame([(4.0,), (-1.0,), (0.0,), (float("nan"),), (float("inf"),), (None,), (1e300,)], "mz double")
    got = [r[0] for r in df.select(scalar.grid_index(F.col("mz"), F.lit(1.5), F.lit(1.0))).collect()]
    assert got == [1, None, None, None, None, None, None]  # 0.5 rounds away from zero


def test_polynomial(spark):
    df = spark.createDataFrame([(30.0,), (1.0,), (99.0,)], "t double")
    lit = lambda v: F.lit(float(v))
    poly = F.array(lit(2), lit(3))
    flags = F.lit(0b1010)
    got = [r[0] for r in df.select(scalar.polynomial_mz(F.col("t"), lit(0.5), lit(1), lit(5), lit(40), poly, flags)).collect()]
    want = [(0.5 * (t - 1)) ** 2 - (2 * min(max(t, 5), 40) + 3 * min(max(t, 5), 40) ** 3) for t in (30, 1, 99)]
    assert got == pytest.approx(want)


def test_mobility_endpoints(spark):
    c = {k: F.lit(v) for k, v in {"c0": 0.0, "c1": 909.0, "c2": 200.0, "c3": 40.0, "c6": 0.02, "c7": 120.0, "low": 0.6}.items()}
    k0 = lambda s: scalar.inverse_mobility(scalar.mobility_voltage(F.lit(float(s)), c["c0"], c["c1"], c["c2"], c["c3"]), c["c3"], c["c6"], c["c7"], c["low"])
    low, high = spark.range(1).select(k0(909), k0(0)).first()
    assert low == pytest.approx(0.6) and high > low
    flat = spark.range(1).select(scalar.mobility_voltage(F.lit(3.0), F.lit(5.0), F.lit(5.0), F.lit(7.0), F.lit(9.0))).first()[0]
    assert flat == 7.0


def test_affine_corners(spark):
    a = spark.range(1).select(scalar.affine(F.lit(5), F.lit(8), F.lit(10), F.lit(20)).alias("a")).first()["a"]
    assert (a["sx"] * 4 + a["tx"], a["sy"] * 7 + a["ty"]) == (10, 20)


def test_policy_and_globs(spark):
    df = spark.createDataFrame([("a/DATA_bin",), ("a/keep_bin",), ("x/notes.TXT",), ("x/y.raw",)], "p string")
    got = [r[0] for r in df.select(text.policy(F.col("p"), [("keep*", "embed")], [("*.txt", "drop")], True)).collect()]
    assert got == ["drop", "embed", "drop", "embed"]
    got = [r[0] for r in df.select(text.member_matches(F.col("p"), "a/*")).collect()]
    assert got == [True, True, False, False]


def test_safe_members(spark):
    names = ["a/b", "../a", "a/../b", "/a", "a\\b", "c:/x", "", "a\nb", "a..b"]
    got = spark.createDataFrame([(n,) for n in names], "p string").select(text.safe_member(F.col("p"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, False, False, False, False, True]


def test_wide_trailers(spark):
    rows = [(1, 1, "Ion (ms):", " 3.5 "), (2, 1, "Ion [ms]", "x"), (3, 1, "Ion (ms):", "9"), (4, 2, "Ion (ms):", "4"), (5, 2, "--", None)]
    out = vendor.wide(spark.createDataFrame(rows, "position long, ordinal long, label string, value string"))
    assert out.columns == ["ordinal", "Ion_ms", "Ion_ms_1", "col"]
    assert sorted(map(tuple, out.collect())) == [(1, 3.5, "x", None), (2, 4.0, None, None)]


def test_fallback_calibration(spark):
    s = spark.createDataFrame([(1, 7), (2, 3), (3, None)], "index long, calibration_id int")
    c = spark.createDataFrame([(3, 0.3), (5, 0.5)], "calibration_id int, coeff double")
    got = sorted(map(tuple, calibration.with_calibration(s, c).select("index", "coeff", "fallback").collect()))
    assert got == [(1, 0.3, True), (2, 0.3, False), (3, 0.3, True)]


def test_damaged_line_arrays(spark):
    s = spark.createDataFrame([(1, 0, 5, None)], "index long, acquisition_key long, line_mz long, line_intensity long")
    k = spark.createDataFrame([(0, 1)], "acquisition_key long, ms_level int")
    with pytest.raises(Exception, match="damaged"):
        calibration.line_spectra(s, k).collect()


def test_nearest_ties_go_left(spark):
    p = spark.createDataFrame([(1.5,), (-3.0,), (9.0,), (2.2,)], "x double")
    a = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert sorted((r[0], r[1]) for r in calibration.nearest(p, a).collect()) == [(-3.0, 1.0), (1.5, 1.0), (2.2, 2.0), (9.0, 2.0)]


def test_duplicate_and_dangling_precursors(spark):
    s = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "f", "a"), (4, "g", "zz"), (5, "h", "")], "index long, id string, precursor_id string")
    assert calibration.dangling_fragments(s, s.where("index <> 2")).collect() == [(3, 2)]
    assert calibration.dangling_fragments(s, s.where("index <> 1")).count() == 0


def test_reindexed_keeps_every_row(spark):
    """Many partitions and wide rows: every index comes exactly once, in order of the keys."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    rows = spark.range(400_000).selectExpr("(id * 7919) % 400000 k", "repeat(cast(id as string), 40) payload")
    got = encode.reindexed(rows, ["k"])
    assert got.agg(F.count("*"), F.countDistinct("index"), F.min("index"), F.max("index")).first()[:] == (400_000, 400_000, 0, 399_999)
    assert got.where("index <> k").count() == 0 and got.where("length(payload) < 40").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert encode.reindexed(rows.where("false"), ["k"]).count() == 0


def test_nearest_leaves_out_what_is_no_number(spark):
    nan = float("nan")
    probe, axis = spark.createDataFrame([(1.0,), (nan,), (None,), (9.0,)], "x double"), spark.createDataFrame([(2.0,), (nan,), (8.5,)], "x double")
    assert sorted((r["x"], r["nearest"]) for r in calibration.nearest(probe, axis).collect()) == [(1.0, 2.0), (9.0, 8.5)]


def test_grids_need_positive_points(spark):
    rows = [(s, (14.0 + 1e-3 * (1000 + k)) ** 2) for s in (1, 2) for k in range(40)] + [(2, 0.0), (3, 5.0)]
    p = spark.createDataFrame(rows, "spectrum_index long, mz double")
    assert [r["spectrum_index"] for r in grid.per_spectrum(p).collect()] == [1] == [r["spectrum_index"] for r in grid.fixed_clock(p, 1e-3).collect()]


def test_names_of_sdrf_and_images(spark):
    df = spark.createDataFrame([("a/PXD001_a.sdrf.tsv",), ("x_a.sdrf.tsv",), ("b/MTBLS7.svs",)], "p string")
    got = df.select(text.accession_hint(F.col("p")), text.media_type(F.col("p"))).collect()
    assert [r[0] for r in got] == ["PXD001_a", "x_a.sdrf", "MTBLS7"] and got[2][1] == "image/tiff"


def test_integer_intensity_only_if_lossless(spark):
    p = spark.createDataFrame([(1, 2.0), (1, 3.0)], "spectrum_index long, intensity double")
    assert dict(encode.integer_intensity(p).dtypes)["intensity"] == "int"
    assert dict(encode.integer_intensity(p.withColumn("intensity", F.col("intensity") + 0.5)).dtypes)["intensity"] == "double"


def test_nearest_over_skewed_and_equal_values(spark):
    """Nine tenths of the probes in one narrow range, many equal ones, few axis values: as by sorting, and no partition holds more than its share."""
    import bisect

    from lumenspec.operators import calibration

    r = random.Random(6)
    probe = [500 + r.random() / 1000 for _ in range(3000)] + [7.0] * 1500 + [r.uniform(-1000, 1000) for _ in range(500)] + [-0.0, 1e300, -1e300]
    for axis in ([500 + r.random() / 1000 for _ in range(200)] + [7.0, -3.5], [0.25], sorted(probe)[::7]):
        ordered = sorted(axis)

        def want(x, ordered=ordered):
            i = bisect.bisect_left(ordered, x)
            near = ordered[max(i - 1, 0) : i + 1]
            return min(near, key=lambda a: (abs(x - a), a))

        df = spark.createDataFrame([(x,) for x in probe], "x double").repartition(3)
        got = calibration.nearest(df.unionByName(spark.createDataFrame([(None,), (float("nan"),)], "x double")), spark.createDataFrame([(a,) for a in axis], "x double")).collect()
        assert sorted((x["x"], x["nearest"]) for x in got) == sorted((x, want(x)) for x in probe)
    assert calibration.nearest(df.limit(0), df).count() == 0
    assert [x["nearest"] for x in calibration.nearest(df.limit(2), df.limit(0)).collect()] == [None, None]


def test_value_at_rank(spark, monkeypatch):
    from lumenspec.operators import grid

    monkeypatch.setattr(grid, "FETCHED", 3)
    monkeypatch.setattr(grid, "BUCKETS", 5)
    r = random.Random(2)
    inf, nan = float("inf"), float("nan")
    for values in ([0.0] * 50 + [1.0], [r.random() ** 9 for _ in range(400)], [5e-324, 0.0, 1e308, 3.0] * 5 + [inf, inf, nan], [r.choice([1e-9, 1e-9 + 1e-25, 2e-9]) for _ in range(90)], [4.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "e double")
        ordered = sorted(values, key=lambda v: (v != v, v))
        for rank in {0, len(values) // 2, len(values) - 1}:
            got = grid.value_at_rank(df, "e", rank)
            assert got == ordered[rank] or (got != got and ordered[rank] != ordered[rank])
        assert grid.value_at_rank(df, "e", len(values)) is None


def test_chunk_slice_reads_few_points(spark, tmp_path):
    """A slice of 20 Th of 1,900 reads under a tenth of the points: row groups are bounded by their chunks' m/z."""
    import glob

    import pyarrow.parquet as pq

    pts = spark.range(60_000).select((F.col("id") % 300).alias("spectrum_index"), F.col("id").alias("ordinal"), (100 + F.pmod(F.xxhash64("id"), F.lit(1900)).cast("double")).alias("mz"), F.lit(1.0).alias("intensity"))
    path = str(tmp_path / "chunks")
    encode.write_chunks(encode.chunked(pts), path, rows=200)
    read = total = 0
    for file in glob.glob(f"{path}/*.parquet"):
        f = pq.ParquetFile(file)
        at = {f.metadata.schema.column(c).path: c for c in range(len(f.metadata.schema))}
        for g in range(f.metadata.num_row_groups):
            group = f.metadata.row_group(g)
            assert group.num_rows <= 200
            n = len(f.read_row_group(g, columns=["mz_values"])["mz_values"].combine_chunks().flatten())
            total += n
            low, high = group.column(at["chunk_start"]).statistics.min, group.column(at["chunk_end"]).statistics.max
            read += n if high >= 700 and low <= 720 else 0
    assert total == 60_000 and read < 0.1 * total
    chunks = spark.read.parquet(path)
    got = {(r["spectrum_index"], r["ordinal"], r["value"]) for r in encode.chunk_slice(chunks, 700.0, 720.0).collect()}
    assert got == {(r["spectrum_index"], r["ordinal"], r["mz"]) for r in pts.where("mz between 700 and 720").collect()}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = encode.chunk_slice(spark.read.parquet(path), 700.0, 720.0)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(chunk_end,700.0)" in plan and "LessThanOrEqual(chunk_start,720.0)" in plan


def test_lattice_chunks_of_a_falling_axis(spark):
    rows = [(0, i, k, float(k)) for i, k in enumerate(range(100, 400, 3))]
    pts = spark.createDataFrame(rows, "spectrum_index long, ordinal long, tof int, intensity double")
    chunks = encode.tof_chunks(pts, 40.0, -0.05, 25.0)
    assert chunks.where("chunk_start > chunk_end").count() == 0
    inside = (150, 250)
    low, high = ((40 - 0.05 * k) ** 2 for k in (250, 150))
    got = sorted(r["value"] for r in encode.chunk_slice(chunks, low, high, "tof_values", inside).collect())
    assert got == [k for _, _, k, _ in rows if 150 <= k <= 250]


def test_frame_buffers(spark):
    import numpy as np

    from lumenspec.functions.binary import scan_buffer
    from lumenspec.operators import frames

    scan, tof, intensity = scan_buffer(np.array([2, 0, 1, 7, 9, 70, 90, 5, 50]), 3)
    assert (scan.tolist(), tof.tolist(), intensity.tolist()) == ([0, 0, 2], [7, 9, 5], [70, 90, 50])
    for words, scans in (([2, 0], 3), ([2, 1, 2, 3], 1), ([1, 4, 5, 6], 1), ([-1, 3], 1), ([], -1)):
        with pytest.raises(ValueError):
            scan_buffer(np.array(words), scans)
    held = spark.createDataFrame([(1, 3, [2, 0, 1, 7, 9, 70, 90, 5, 50]), (2, 2, [0, 0]), (3, 1, None)], "frame long, scans int, words array<int>")
    got = frames.frame_points(held)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 7, 70), (1, 1, 0, 9, 90), (1, 2, 2, 5, 50)]
    by = frames.by_mass(got, scalar.grid_mz(F.lit(1.0), F.lit(1.0), F.col("tof")), 1.0 - F.col("scan") / 10).orderBy("place").collect()
    assert [(r["mz"], r["mobility"], r["intensity"]) for r in by] == [(36.0, 0.8, 50), (64.0, 1.0, 70), (100.0, 1.0, 90)]
    with pytest.raises(Exception, match="frame 4"):
        frames.frame_points(spark.createDataFrame([(4, 2, [1, 1, 3])], "frame long, scans int, words array<int>")).collect()


def test_frames_of_many_batches(spark):
    """A frame may lie in several batches of rows, and one batch may hold many frames; work follows the points, not the frames."""
    import time

    from lumenspec.operators import frames

    points = spark.createDataFrame([(f, s, 10 * s + k, k) for f in (3, None, 1, 2) for s in (2, 0) for k in range(f or 5)], "frame long, scan int, tof long, intensity int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        held = {r["frame"]: r["words"] for r in frames.frame_buffers(points, 3).collect()}
        got = sorted(map(tuple, frames.frame_points(frames.frame_buffers(points.where("frame > 0"), 3)).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert held == {f: [f or 5, 0, f or 5, *range(f or 5), *range(f or 5), *(20 + k for k in range(f or 5)), *range(f or 5)] for f in (3, None, 1, 2)}
    assert got == sorted((f, k + f * (s > 0), s, 10 * s + k, k) for f in (1, 2, 3) for s in (0, 2) for k in range(f))
    for bad in ([(1, 0, None, 1)], [(1, 3, 1, 1)], [(1, None, 1, 1)]):
        with pytest.raises(Exception, match="a null|outside"):
            frames.frame_buffers(spark.createDataFrame(bad, "frame long, scan int, tof long, intensity int"), 3).collect()
    many = spark.range(1_600_000).selectExpr("id div 4 frame", "cast(id % 4 as int) scan", "id % 1000 tof", "cast(id % 7 as int) intensity")
    start = time.monotonic()
    assert frames.frame_points(frames.frame_buffers(many, 4)).where("tof % 4 = scan").count() == 1_600_000
    assert time.monotonic() - start < 25


def test_windows_of_groups_take_little_disk(spark, tmp_path):
    """Rows are frames times windows: what is written repeats within a task. Frames without a group have no row, and many windows meet without a broadcast."""
    few = calibration.dia_windows(spark.createDataFrame([(1, 5), (1, 6), (2, 7), (None, 8), (4, 9)], "window_group int, frame long"), spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (None, 14)], "window_group int, window_id long"))
    assert sorted(map(tuple, few.collect())) == [(1, 5, 10), (1, 5, 11), (1, 6, 10), (1, 6, 11), (2, 7, 12)]
    frames = spark.range(40_000).selectExpr("id frame", "cast(id % 25 as int) window_group")
    windows = spark.range(6_000).selectExpr("cast(hash(id) & 31 as int) % 25 window_group", "id window_id")
    calibration.dia_windows(frames, windows).select("frame", "window_id").write.parquet(str(tmp_path / "o"))
    rows = spark.read.parquet(str(tmp_path / "o")).count()
    assert rows == frames.join(windows, "window_group").count() and sum(f.stat().st_size for f in (tmp_path / "o").glob("*.parquet")) < 0.7 * rows


def test_many_frames_by_mass(spark):
    """Work follows the points of frames, not their number."""
    import time

    from lumenspec.operators import frames

    many = spark.range(1_200_000).selectExpr("id div 4 frame", "cast(id % 4 as int) scan", "100 - id % 4 tof", "cast(id % 7 as int) intensity")
    start = time.monotonic()
    by = frames.by_mass(frames.frame_points(frames.frame_buffers(many, 4)), scalar.grid_mz(F.lit(1.0), F.lit(1.0), F.col("tof")), F.col("scan") / 10)
    got = by.groupBy("place", "mz", "mobility").count().orderBy("place").collect()
    assert list(map(tuple, got)) == [(k, float((98 + k) ** 2), (3 - k) / 10, 300_000) for k in range(4)]
    assert time.monotonic() - start < 25


def test_many_windows_of_groups_take_little_disk(spark, tmp_path, monkeypatch):
    """What a row takes does not grow with the windows of a group: they come in blocks. Repeated rows count as often as they come, with and without a broadcast."""
    frames = spark.range(1_500).selectExpr("id frame", "cast(id % 5 as int) window_group")
    windows = spark.range(30_000).selectExpr("cast(id % 5 as int) window_group", "id window_id")
    calibration.dia_windows(frames, windows).select("frame", "window_id").write.parquet(str(tmp_path / "o"))
    rows = spark.read.parquet(str(tmp_path / "o"))
    assert rows.count() == 1_500 * 6_000 == rows.where("frame % 5 = window_id % 5").distinct().count()
    assert sum(f.stat().st_size for f in (tmp_path / "o").glob("*.parquet")) < 0.3 * rows.count()
    frames = spark.sql("select cast(if(id % 11 = 0, null, id % 3) as int) window_group, id div 2 frame, 'x' kind from range(1500)")
    windows = spark.sql("select cast(if(id % 7 = 0, null, id % 4) as long) window_group, if(id % 13 = 0, null, id div 3) window_id, 0.5D width from range(900)")
    want = frames.join(windows, "window_group")
    for sent in (calibration.SENT, 100):
        monkeypatch.setattr(calibration, "SENT", sent)
        got = calibration.dia_windows(frames, windows)
        assert got.dtypes == want.dtypes and got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and want.count() > 100_000
    assert calibration.dia_windows(frames, windows.where("false")).count() == 0 == calibration.dia_windows(frames.where("false"), windows).count()


def test_rising_order(spark):
    rows = [(0, 0, 9.0), (0, 1, 5.0), (0, 2, 1.0), (1, 4, 2.0), (1, 7, 3.0), (2, 0, 4.0)]
    got = encode.rising(spark.createDataFrame(rows, "spectrum_index long, ordinal long, mz double")).collect()
    assert {(r["spectrum_index"], r["mz"]): r["place"] for r in got} == {(0, 1.0): 0, (0, 5.0): 1, (0, 9.0): 2, (1, 2.0): 0, (1, 3.0): 1, (2, 4.0): 0}
