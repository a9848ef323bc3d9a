"""The registered queries over the driver's tables, each with its SQL twin.

The tables stand for a run's facets: orders are spectra (days since 1992 as
minutes, status as MS level), line items signal points, events status-log
rows and chromatogram points, customers precursors, parts calibrations, pages
archive members, documents conversion results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.functions import scalar as S
from lumenspec.functions import text as X
from lumenspec.operators import calibration, chrom, encode, frames, grid, report, selection, vendor
from lumenspec.plans import facets
from lumenspec.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The logical tables in SQL; each twin uses those it names.
VIEWS = {
    "spectra": "SELECT o_orderkey AS index, 'scan=' || o_orderkey AS id, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS time, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS ms_level, CASE WHEN o_orderstatus <> 'F' THEN 'scan=' || o_custkey END AS precursor_id, o_custkey FROM orders",
    "points": "SELECT l_orderkey AS spectrum_index, l_linenumber * 10000000000 + l_partkey * 100 + CAST(l_quantity AS BIGINT) AS ordinal, l_extendedprice / 100 AS mz, l_quantity AS intensity, l_partkey AS tof, l_suppkey % 4 AS scan FROM lineitem",
    "chosen": "SELECT * FROM spectra WHERE time BETWEEN 200 AND 1500 AND ms_level IN (1, 2)",
    "log": "SELECT event_id AS position, user_id AS ordinal, event_type AS label, CASE WHEN event_id % 5 = 0 THEN ' n/a ' ELSE ' ' || CAST(event_id % 97 AS VARCHAR) || ' ' END AS value, value AS time FROM events",
    "results": "SELECT doc_id, source AS format, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'skipped' ELSE 'ok' END AS status, n_chars AS raw_bytes, n_chars * (1 + doc_id % 5) AS out_bytes FROM documents",
}
NEEDS = {"chosen": ["spectra"]}


def twin(sql: str) -> str:
    """The statement with the logical tables that it names in front."""
    import re

    names: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in names:
                for n in NEEDS.get(name, []):
                    if n not in names:
                        names.append(n)
                names.append(name)

    add(sql)
    if not names:
        return sql
    body = sql.strip()
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {heads}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = twin(sql)
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").selectExpr("o_orderkey index", "concat('scan=', o_orderkey) id", "cast(datediff(cast(o_orderdate as date), date'1992-01-01') as double) time", "case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end ms_level", "case when o_orderstatus <> 'F' then concat('scan=', o_custkey) end precursor_id", "o_custkey")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").selectExpr("l_orderkey spectrum_index", "l_linenumber * 10000000000L + l_partkey * 100 + cast(l_quantity as long) ordinal", "l_extendedprice / 100 mz", "l_quantity intensity", "l_partkey tof", "l_suppkey % 4 scan")


def chosen(spark: SparkSession, sf: str) -> DataFrame:
    return selection.survivors(spectra(spark, sf), selection.parse_range("200-1500"), {1, 2})


def log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr("event_id position", "user_id ordinal", "event_type label", "case when event_id % 5 = 0 then ' n/a ' else concat(' ', event_id % 97, ' ') end value", "value time")


def results(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").selectExpr("doc_id", "source format", "case when doc_id % 11 = 0 then 'failed' when doc_id % 13 = 0 then 'skipped' else 'ok' end status", "n_chars raw_bytes", "n_chars * (1 + doc_id % 5) out_bytes")


# --- selection and filtering


@query("SELECT index, time, ms_level FROM chosen")
def survivor_filter(spark, sf):
    return chosen(spark, sf).select("index", "time", "ms_level")


@query("SELECT index, time FROM spectra WHERE time <= 1900")
def rt_window_open(spark, sf):
    return selection.survivors(spectra(spark, sf), selection.parse_range("-1900")).select("index", "time")


@query("SELECT index, ms_level FROM spectra WHERE ms_level IN (1, 3)")
def ms_level_set(spark, sf):
    return selection.survivors(spectra(spark, sf), levels={1, 3}).select("index", "ms_level")


@query("SELECT spectrum_index, ordinal, mz, intensity FROM points WHERE spectrum_index IN (SELECT index FROM chosen)")
def facet_semi_filter(spark, sf):
    return selection.facet_rows(points(spark, sf), chosen(spark, sf), "spectrum_index").select("spectrum_index", "ordinal", "mz", "intensity")


@query("WITH m AS (SELECT CASE WHEN index % 7 = 0 THEN NULL ELSE index END AS index, id FROM spectra) SELECT * FROM m WHERE index IS NULL OR index IN (SELECT index FROM chosen)")
def facet_semi_filter_null_keep(spark, sf):
    meta = spectra(spark, sf).selectExpr("if(index % 7 = 0, null, index) index", "id")
    return selection.facet_rows(meta, chosen(spark, sf), "index", keep_null=True)


@query("SELECT spectrum_index, ordinal, mz FROM points WHERE spectrum_index BETWEEN (SELECT min(index) FROM chosen) AND (SELECT max(index) FROM chosen)")
def facet_key_range(spark, sf):
    return selection.with_key_range(points(spark, sf), chosen(spark, sf), "spectrum_index").select("spectrum_index", "ordinal", "mz")


@query("SELECT spectrum_index, ordinal, mz, intensity FROM points WHERE mz BETWEEN 100 AND 150")
def mz_slice(spark, sf):
    return selection.points_in_range(points(spark, sf), 100.0, 150.0).select("spectrum_index", "ordinal", "mz", "intensity")


@query("SELECT spectrum_index, ordinal, mz, intensity FROM points WHERE mz BETWEEN 100 AND 150")
def chunk_slice(spark, sf):
    path = new_path(spark, "chunks")
    encode.write_chunks(encode.chunked(points(spark, sf)), path)
    return encode.chunk_slice(spark.read.parquet(path), 100.0, 150.0).select("spectrum_index", "ordinal", F.col("value").alias("mz"), "intensity")


@query("SELECT spectrum_index, ordinal, tof FROM points WHERE tof BETWEEN ceil((sqrt(100.0) - 9.5) / 0.01) AND floor((sqrt(200.0) - 9.5) / 0.01)")
def chunk_slice_on_grid(spark, sf):
    path = new_path(spark, "chunks")
    encode.write_chunks(encode.tof_chunks(points(spark, sf), 9.5, 0.01), path)
    inside = selection.index_range(9.5, 0.01, 100.0, 200.0)
    return encode.chunk_slice(spark.read.parquet(path), 100.0, 200.0, "tof_values", inside).select("spectrum_index", "ordinal", F.col("value").alias("tof"))


@query("WITH w AS (SELECT spectrum_index, ordinal, mz, row_number() OVER s AS r, count(*) OVER (PARTITION BY spectrum_index) AS n, first_value(mz) OVER f AS a, last_value(mz) OVER f AS b FROM points WINDOW s AS (PARTITION BY spectrum_index ORDER BY ordinal), f AS (PARTITION BY spectrum_index ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT spectrum_index, ordinal, mz, CASE WHEN a > b THEN n - r ELSE r - 1 END AS place FROM w")
def descending_profiles(spark, sf):
    return encode.rising(points(spark, sf)).select("spectrum_index", "ordinal", "mz", "place")


@query("SELECT spectrum_index AS frame, scan, tof, CAST(intensity AS BIGINT) AS intensity, row_number() OVER (PARTITION BY spectrum_index ORDER BY scan, tof, intensity) - 1 AS ordinal FROM points")
def frame_points(spark, sf):
    flat = points(spark, sf).select(F.col("spectrum_index").alias("frame"), F.col("scan").cast("int").alias("scan"), "tof", "intensity")
    return frames.frame_points(frames.frame_buffers(flat, 4)).select("frame", "scan", "tof", "intensity", "ordinal")


@query("WITH m AS (SELECT spectrum_index AS frame, (9.5 + 0.01 * tof) * (9.5 + 0.01 * tof) AS mz, 1.6 - 0.1 * scan AS mobility, CAST(intensity AS BIGINT) AS intensity, row_number() OVER (PARTITION BY spectrum_index ORDER BY scan, tof, intensity) AS o FROM points) SELECT frame, CAST(mz AS DOUBLE) AS mz, CAST(mobility AS DOUBLE) AS mobility, intensity, row_number() OVER (PARTITION BY frame ORDER BY mz, o) - 1 AS place FROM m")
def frame_points_by_mass(spark, sf):
    flat = points(spark, sf).select(F.col("spectrum_index").alias("frame"), F.col("scan").cast("int").alias("scan"), "tof", "intensity")
    mz = S.grid_mz(F.lit(9.5), F.lit(0.01), F.col("tof"))
    return frames.by_mass(frames.frame_points(frames.frame_buffers(flat, 4)), mz, F.lit(1.6) - F.lit(0.1) * F.col("scan"))


@query("SELECT spectrum_index, ordinal, tof FROM points WHERE tof BETWEEN ceil((sqrt(100.0) - 9.5) / 0.01) AND floor((sqrt(200.0) - 9.5) / 0.01)")
def mz_slice_on_grid(spark, sf):
    low, high = selection.index_range(9.5, 0.01, 100.0, 200.0)
    return points(spark, sf).where(F.col("tof").between(low, high)).select("spectrum_index", "ordinal", "tof")


@query("WITH k AS (SELECT id, max(index) AS source FROM spectra GROUP BY id) SELECT count(*) AS dangling FROM chosen c JOIN k ON c.precursor_id = k.id WHERE c.precursor_id <> '' AND k.source NOT IN (SELECT index FROM chosen)")
def dangling_precursors(spark, sf):
    return calibration.dangling_fragments(spectra(spark, sf), chosen(spark, sf)).agg(F.count("*").alias("dangling"))


@query("SELECT ordinal AS chromatogram_index, position AS ordinal, time FROM log WHERE time BETWEEN 10 AND 60")
def chrom_truncate_point(spark, sf):
    return selection.truncate_points(log(spark, sf), 10, 60).selectExpr("ordinal chromatogram_index", "position ordinal", "time")


CHUNKED_LOG = "WITH c AS (SELECT ordinal AS chromatogram_index, CAST(floor(time / 20) AS BIGINT) AS chunk, min(time) AS time_start, max(time) AS time_end, count(*) AS n FROM log GROUP BY ALL)"


@query(f"{CHUNKED_LOG} SELECT * FROM c WHERE time_end >= 30 AND time_start <= 90")
def chrom_truncate_chunk(spark, sf):
    c = log(spark, sf).groupBy(F.col("ordinal").alias("chromatogram_index"), F.floor(F.col("time") / 20).alias("chunk")).agg(F.min("time").alias("time_start"), F.max("time").alias("time_end"), F.count("*").alias("n"))
    return selection.truncate_chunks(c, 30, 90)


@query("SELECT c.c_custkey AS index, count(l.position) AS number_of_points FROM customer c LEFT JOIN (SELECT * FROM log WHERE time BETWEEN 10 AND 60) l ON l.ordinal = c.c_custkey GROUP BY 1")
def chrom_count_refresh(spark, sf):
    c = read(spark, sf, "customer").selectExpr("c_custkey index", "0L number_of_points")
    return selection.refreshed_counts(c, selection.truncate_points(log(spark, sf), 10, 60).withColumnRenamed("ordinal", "chromatogram_index"))


@query("SELECT index, id FROM spectra ORDER BY index LIMIT 25")
def first_spectra(spark, sf):
    return selection.first_spectra(spectra(spark, sf), 25).select("index", "id")


@query("WITH s AS (SELECT row_number() OVER (ORDER BY index) - 1 AS index, id FROM spectra), n AS (SELECT greatest(count(*) // 16, 1) AS step FROM s) SELECT CAST(index AS BIGINT) AS index, id FROM s, n WHERE index % step = 0 AND index // step < 16")
def sample_every_n(spark, sf):
    s = encode.reindexed(spectra(spark, sf).select("id", F.col("index").alias("key")), ["key"])
    return selection.every_nth(s, 16, s.count()).select("index", "id")


@query("SELECT spectrum_index, ordinal, mz FROM points WHERE intensity <> 0 AND intensity <> 25 AND mz > 0")
def nonzero_fine_points(spark, sf):
    p = points(spark, sf).withColumn("intensity", F.when(F.col("intensity") == 25, 0.0).otherwise(F.col("intensity")))
    return selection.fine_mz(selection.nonzero(p)).select("spectrum_index", "ordinal", "mz")


@query("SELECT index, coalesce(precursor_id, 'none') AS precursor_id, coalesce(CASE WHEN time > 1000 THEN time END, 0.0) AS time FROM spectra")
def fill_only_if_null(spark, sf):
    s = spectra(spark, sf).withColumn("time", F.when(F.col("time") > 1000, F.col("time")))
    return selection.filled(s, {"precursor_id": F.lit("none"), "time": F.lit(0.0)}).select("index", "precursor_id", "time")


# --- aggregates


TIC = "SELECT s.index, s.time, coalesce(p.tic, 0.0) AS tic, coalesce(p.bpc, 0.0) AS bpc FROM spectra s LEFT JOIN (SELECT spectrum_index, sum(intensity) AS tic, max(intensity) AS bpc FROM points GROUP BY 1) p ON p.spectrum_index = s.index WHERE s.ms_level = 1"


@query(TIC)
def tic_bpc(spark, sf):
    return chrom.tic_bpc(spectra(spark, sf), points(spark, sf))


@query(TIC + " AND s.time BETWEEN 200 AND 1500 ORDER BY s.time, s.index")
def tic_of_survivors(spark, sf):
    """The flagship: select spectra, cut the points to them, sum per spectrum, order by time."""
    s = chosen(spark, sf)
    p = selection.facet_rows(points(spark, sf), s.where("ms_level = 1"), "spectrum_index")
    return chrom.tic_bpc(s, p).orderBy("time", "index")


@query("WITH t AS (" + TIC + ") SELECT CAST(0 AS BIGINT) AS chromatogram_index, time, CAST(tic AS FLOAT) AS intensity, index AS ordinal FROM t UNION ALL SELECT 1, time, CAST(bpc AS FLOAT), index FROM t")
def chromatogram_points(spark, sf):
    return chrom.chromatogram_points(chrom.tic_bpc(spectra(spark, sf), points(spark, sf)))


@query("SELECT spectrum_index, min(mz) AS mz_low, max(mz) AS mz_high FROM points WHERE mz > 0 GROUP BY 1")
def observed_mz_range(spark, sf):
    return chrom.observed_range(points(spark, sf))


@query("SELECT spectrum_index, (2.5 + 0.001 * min(tof)) * (2.5 + 0.001 * min(tof)) AS mz_low, (2.5 + 0.001 * max(tof)) * (2.5 + 0.001 * max(tof)) AS mz_high FROM (SELECT spectrum_index, CAST(tof AS DOUBLE) AS tof FROM points) GROUP BY 1".replace("2.5", "CAST(2.5 AS DOUBLE)").replace("0.001", "CAST(0.001 AS DOUBLE)"))
def observed_mz_range_of_grid(spark, sf):
    return chrom.observed_range_of_grid(points(spark, sf), 2.5, 0.001)


@query("SELECT count(*) AS n_points, count(DISTINCT spectrum_index) AS n_spectra FROM points")
def facet_counts(spark, sf):
    return chrom.facet_counts(points(spark, sf))


@query("SELECT CAST(count(DISTINCT (spectrum_index, floor(mz / 50))) AS BIGINT) AS n_chunks, count(*) AS n_points, count(DISTINCT spectrum_index) AS n_spectra FROM points")
def chunk_counts(spark, sf):
    return chrom.chunk_counts(encode.chunked(points(spark, sf)))


@query("SELECT spectrum_index, count(*) FILTER (WHERE intensity > 10) AS nnz, sum(CASE WHEN intensity > 10 THEN intensity ELSE 0 END) AS total, min(ordinal) FILTER (WHERE intensity > 10) AS first_nonzero, max(ordinal) FILTER (WHERE intensity > 10) AS last_nonzero, max(CASE WHEN intensity > 10 THEN intensity ELSE 0 END) AS most FROM points GROUP BY 1")
def profile_scan_stats(spark, sf):
    p = points(spark, sf).withColumn("intensity", F.when(F.col("intensity") > 10, F.col("intensity")).otherwise(0.0))
    return chrom.scan_statistics(p)


@query("WITH made AS (SELECT 'TIC' AS id, 'tic' AS type UNION ALL SELECT 'BPC', 'bpc'), source AS (SELECT DISTINCT 'src' || label AS id, CASE label WHEN 'click' THEN 'tic' ELSE label END AS type FROM log) SELECT * FROM made UNION ALL SELECT * FROM source WHERE type NOT IN (SELECT type FROM made)")
def union_chromatograms(spark, sf):
    made = spark.createDataFrame([("TIC", "tic"), ("BPC", "bpc")], "id string, type string")
    source = log(spark, sf).select(F.concat(F.lit("src"), "label").alias("id"), F.when(F.col("label") == "click", "tic").otherwise(F.col("label")).alias("type")).distinct()
    return chrom.united(made, source)


# --- layouts


@query("SELECT spectrum_index, CAST(floor(mz / 50) AS INTEGER) AS chunk_no, min(mz) AS chunk_start, max(mz) AS chunk_end, count(*) AS n, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY mz, ordinal) AS ordinals FROM points GROUP BY 1, 2")
def chunk_by_mz(spark, sf):
    return encode.chunked(points(spark, sf)).select("spectrum_index", "chunk_no", "chunk_start", "chunk_end", F.size("mz_values").cast("long").alias("n"), F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"))


@query("SELECT spectrum_index, ordinal, mz, intensity FROM points")
def chunk_explode_roundtrip(spark, sf):
    return encode.unchunked(encode.chunked(points(spark, sf)))


SCANS = ["spectrum_index", "scan"]


@query("SELECT spectrum_index, scan, ordinal, tof - coalesce(lag(tof) OVER (PARTITION BY spectrum_index, scan ORDER BY ordinal), 0) AS delta FROM points")
def delta_encode(spark, sf):
    return encode.delta_encoded(points(spark, sf), SCANS).select(*SCANS, "ordinal", "delta")


@query("SELECT spectrum_index, scan, ordinal, tof FROM points")
def delta_decode(spark, sf):
    coded = encode.delta_encoded(points(spark, sf), SCANS).drop("tof")
    return encode.delta_decoded(coded, SCANS).select(*SCANS, "ordinal", "tof")


@query("SELECT spectrum_index, row_number() OVER (PARTITION BY spectrum_index ORDER BY mz, ordinal) - 1 AS place, ordinal FROM points")
def points_by_mz(spark, sf):
    return encode.reindexed(points(spark, sf), ["mz", "ordinal"], within=["spectrum_index"]).selectExpr("spectrum_index", "index place", "ordinal")


@query("SELECT CAST(row_number() OVER (ORDER BY scan, spectrum_index, ordinal) - 1 AS BIGINT) AS index, scan AS function, spectrum_index, ordinal FROM points")
def reindex_scans(spark, sf):
    return encode.reindexed(points(spark, sf), ["scan", "spectrum_index", "ordinal"]).selectExpr("index", "scan function", "spectrum_index", "ordinal")


@query("SELECT spectrum_index AS frame, scan, row_number() OVER (PARTITION BY spectrum_index ORDER BY scan, ordinal) - 1 AS ordinal FROM points")
def scan_membership(spark, sf):
    n = points(spark, sf).groupBy(F.col("spectrum_index").alias("frame")).pivot("scan", [0, 1, 2, 3]).count().fillna(0)
    offsets = n.selectExpr("frame", "array(0L, `0`, `0` + `1`, `0` + `1` + `2`, `0` + `1` + `2` + `3`) offsets")
    return encode.scans_of_offsets(offsets).selectExpr("frame", "cast(scan as long) scan", "ordinal")


@query("SELECT index AS spectrum_index, CAST(0 AS BIGINT) AS facets FROM spectra WHERE index % 5 = 4 UNION ALL SELECT index, 2 FROM spectra WHERE index % 5 <> 4 AND index % 3 = 0")
def facet_partition_check(spark, sf):
    s = spectra(spark, sf).withColumnRenamed("index", "spectrum_index")
    return encode.partition_faults(s, s.where("spectrum_index % 5 <> 4"), s.where("spectrum_index % 5 <> 4 and spectrum_index % 3 = 0"))


# --- grids


GRID = "CAST(17.32 AS DOUBLE)", "CAST(0.000016 AS DOUBLE)"
LATTICE = f"SELECT spectrum_index, ordinal, ({GRID[0]} + {GRID[1]} * tof) * ({GRID[0]} + {GRID[1]} * tof) AS mz FROM (SELECT spectrum_index, ordinal, CAST(tof AS DOUBLE) AS tof FROM points)"
OFF = "SELECT spectrum_index, ordinal, CASE WHEN spectrum_index % 6 = 0 AND ordinal < 20000000000 THEN mz * 1.0001 ELSE mz END AS mz FROM lattice"


def lattice(spark, sf):
    return points(spark, sf).select("spectrum_index", "ordinal", "tof", S.grid_mz(F.lit(17.32), F.lit(1.6e-5), F.col("tof")).alias("mz"))


@query(LATTICE)
def grid_mz(spark, sf):
    return lattice(spark, sf).select("spectrum_index", "ordinal", "mz")


@query(f"SELECT spectrum_index, ordinal, CAST(round((sqrt(mz) - {GRID[0]}) / {GRID[1]}) AS INTEGER) AS k FROM ({LATTICE})")
def grid_index(spark, sf):
    return lattice(spark, sf).select("spectrum_index", "ordinal", S.grid_index(F.col("mz"), F.lit(17.32), F.lit(1.6e-5)).alias("k"))


@query(f"WITH lattice AS ({LATTICE}), o AS ({OFF}), k AS (SELECT *, round((sqrt(mz) - {GRID[0]}) / {GRID[1]}) AS k FROM o), f AS (SELECT spectrum_index, bool_and(abs(({GRID[0]} + {GRID[1]} * k) * ({GRID[0]} + {GRID[1]} * k) - mz) / mz * 1e6 <= 5) AS on_grid FROM k GROUP BY 1) SELECT k.spectrum_index, k.ordinal, CAST(k.k AS INTEGER) AS tof_index, f.on_grid FROM k JOIN f USING (spectrum_index)")
def grid_route(spark, sf):
    off = lattice(spark, sf).withColumn("mz", F.when((F.col("spectrum_index") % 6 == 0) & (F.col("ordinal") < 20_000_000_000), F.col("mz") * 1.0001).otherwise(F.col("mz")))
    return grid.routed(off, 17.32, 1.6e-5).select("spectrum_index", "ordinal", "tof_index", "on_grid")


@query(f"WITH y AS (SELECT sqrt(mz) AS y FROM ({LATTICE})), m AS (SELECT min(y) AS low FROM y), k AS (SELECT y, round((y - low) / {GRID[1]}) AS k FROM y, m), s AS (SELECT count(*)::DOUBLE AS n, sum(k) AS k, sum(k * k) AS kk, sum(y) AS y, sum(k * y) AS ky FROM k) SELECT round((kk * y - k * ky) / (n * kk - k * k), 6) AS c0, round((n * ky - k * y) / (n * kk - k * k), 9) AS c1 FROM s")
def grid_lsq(spark, sf):
    return grid.least_squares(lattice(spark, sf), 1.6e-5).select(F.round("c0", 6).alias("c0"), F.round("c1", 9).alias("c1"))


@query(f"WITH k AS (SELECT mz, round((sqrt(mz) - {GRID[0]}) / CAST(0.0000161 AS DOUBLE)) AS k FROM ({LATTICE})), e AS (SELECT k, abs(({GRID[0]} + CAST(0.0000161 AS DOUBLE) * k) * ({GRID[0]} + CAST(0.0000161 AS DOUBLE) * k) - mz) / mz * 1e6 AS e FROM k), r AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS place, count(*) OVER () AS n FROM e) SELECT (SELECT max(e) FROM e) AS max_ppm, (SELECT e FROM r WHERE place = n // 2) AS median_ppm, (SELECT CAST(max(k) AS BIGINT) FROM e) AS max_k")
def grid_evaluate(spark, sf):
    return grid.evaluated(lattice(spark, sf), 17.32, 1.61e-5)


ROOTS = "SELECT spectrum_index, sqrt(mz) AS y FROM points WHERE mz > 0"


@query(f"WITH y AS ({ROOTS.replace('spectrum_index', 'scan AS spectrum_index')}), g AS (SELECT spectrum_index, y, y - lag(y) OVER (PARTITION BY spectrum_index ORDER BY y) AS gap FROM y), n AS (SELECT spectrum_index, count(*) AS n, list_sort(list(gap) FILTER (WHERE gap > 1e-10)) AS g FROM g GROUP BY 1) SELECT spectrum_index, g[len(g) * 30 // 100 + 1] AS step FROM n WHERE n >= 8 AND len(g) >= 4")
def gap_p30(spark, sf):
    return grid.base_steps(points(spark, sf).drop("spectrum_index").withColumnRenamed("scan", "spectrum_index"))


@query(f"WITH k AS (SELECT spectrum_index, CAST(round((sqrt(mz) - {GRID[0]}) / {GRID[1]}) AS BIGINT) AS k FROM ({LATTICE})), d AS (SELECT spectrum_index, k - lag(k) OVER (PARTITION BY spectrum_index ORDER BY k) AS d FROM k), l AS (SELECT spectrum_index, list_sort(list(d) FILTER (WHERE d > 0)) AS d FROM d GROUP BY 1) SELECT spectrum_index, CASE WHEN len(d) > 0 THEN d[len(d) // 2 + 1] ELSE 9223372036854775807 END AS dk FROM l")
def upper_median_dk(spark, sf):
    return grid.median_steps(lattice(spark, sf), 17.32, 1.6e-5)


@query(f"WITH y AS (SELECT spectrum_index, mz, sqrt(mz) AS y FROM ({LATTICE})), n AS (SELECT spectrum_index, min(y) AS low FROM y GROUP BY 1 HAVING count(*) >= 4), k AS (SELECT y.*, round((y - low) / {GRID[1]}) AS k FROM y JOIN n USING (spectrum_index)) SELECT spectrum_index, round(avg(y - {GRID[1]} * k), 7) AS c0 FROM k GROUP BY 1")
def fixed_clock_fit(spark, sf):
    return grid.fixed_clock(lattice(spark, sf), 1.6e-5).select("spectrum_index", F.round("c0", 7).alias("c0"))


@query("SELECT true AS accepted, CAST(14 AS DOUBLE) AS c0, CAST(0.0001 AS DOUBLE) AS c1, CAST(1 AS BIGINT) AS median_dk")
def lattice_fit(spark, sf):
    """A run whose spectra share a lattice; the fit finds it back. Each nation is a spectrum."""
    pts = read(spark, sf, "nation").selectExpr("cast(n_nationkey as long) spectrum_index", "explode(sequence(0, 999)) x").where("x % 7 <> 3 or x % 2 = 0")
    got = grid.fit(pts.select("spectrum_index", S.grid_mz(F.lit(14.0), F.lit(1e-4), (F.col("x") + 3 * F.col("spectrum_index")).cast("double")).alias("mz")))
    row = (True, round(got.c0, 6), round(got.c1, 9), got.median_dk) if got else (False, None, None, None)
    return spark.createDataFrame([row], "accepted boolean, c0 double, c1 double, median_dk long")


@query("SELECT CAST(count(*) AS BIGINT) AS fitted FROM (SELECT DISTINCT n_nationkey FROM nation)")
def per_spectrum_fit(spark, sf):
    pts = read(spark, sf, "nation").selectExpr("cast(n_nationkey as long) spectrum_index", "explode(sequence(1000, 1199)) k")
    pts = pts.select("spectrum_index", S.grid_mz(F.lit(14.0), F.lit(1e-3), F.col("k").cast("double")).alias("mz"))
    return grid.per_spectrum(pts).agg(F.count("*").alias("fitted"))


# --- vendor tables


@query("SELECT o_orderkey AS frame, CASE WHEN o_custkey % 4 = 0 THEN 1 ELSE 2 END AS ms_level, CASE WHEN o_custkey % 4 = 0 THEN 1 WHEN o_custkey % 4 = 3 THEN 3 ELSE 2 END AS line_level, CASE o_orderstatus WHEN 'F' THEN 'Positive' WHEN 'O' THEN 'Negative' ELSE 'Unknown' END AS polarity FROM orders")
def frame_level_polarity(spark, sf):
    code = F.col("o_custkey") % 4
    sign = F.when(F.col("o_orderstatus") == "F", " + ").when(F.col("o_orderstatus") == "O", "-").otherwise("?")
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("frame"), S.level("frame", code).alias("ms_level"), S.level("line", code).alias("line_level"), S.polarity(sign).alias("polarity"))


@query("SELECT l_orderkey AS frame, l_linenumber AS scan_begin, l_partkey AS precursor, p_size AS charge FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10")
def dda_windows_left(spark, sf):
    w = read(spark, sf, "lineitem").selectExpr("l_orderkey frame", "l_linenumber scan_begin", "l_partkey precursor")
    return calibration.dda_windows(w, read(spark, sf, "part").where("p_size > 10").selectExpr("p_partkey precursor", "p_size charge")).select("frame", "scan_begin", "precursor", "charge")


@query("SELECT o_orderkey AS frame, s_suppkey AS window_id FROM orders JOIN supplier ON o_orderkey % 25 = s_nationkey")
def dia_windows_expand(spark, sf):
    frames = read(spark, sf, "orders").selectExpr("o_orderkey frame", "cast(o_orderkey % 25 as int) window_group")
    windows = read(spark, sf, "supplier").selectExpr("s_nationkey window_group", "s_suppkey window_id")
    return calibration.dia_windows(frames, windows).select("frame", "window_id")


@query("SELECT c_custkey AS spectrum_index, CAST(CAST(c_custkey AS DOUBLE) * 1.5 - CAST(2 + c_nationkey AS DOUBLE) / 2 AS FLOAT) AS lower, CAST(CAST(c_custkey AS DOUBLE) * 1.5 + CAST(2 + c_nationkey AS DOUBLE) / 2 AS FLOAT) AS upper, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey + 1 AS DOUBLE) WHEN c_custkey % 3 = 1 THEN CAST(c_custkey + 2 AS DOUBLE) ELSE CAST(c_custkey AS DOUBLE) * 1.5 END AS selected_mz, nullif(c_nationkey % 4, 0) AS charge, CAST(floor((c_nationkey + c_nationkey + 7) / 2) AS INTEGER) AS mobility_scan, CAST(c_nationkey AS DOUBLE) AS collision_energy FROM customer")
def isolation_bounds(spark, sf):
    p = read(spark, sf, "customer").selectExpr("c_custkey spectrum_index", "c_custkey * 1.5D isolation_mz", "cast(2 + c_nationkey as double) isolation_width", "cast(c_nationkey as double) collision_energy", "if(c_custkey % 3 = 0, c_custkey + 1.0D, null) mono_mz", "if(c_custkey % 3 = 1, c_custkey + 2.0D, null) average_mz", "c_nationkey % 4 charge", "c_nationkey scan_begin", "c_nationkey + 7 scan_end")
    return calibration.isolation(p)


@query("SELECT l.l_orderkey AS index, l.l_linenumber AS line, coalesce(p.p_size, f.p_size) AS coeff, p.p_partkey IS NULL AS fallback FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) p ON p.p_partkey = l.l_partkey, (SELECT p_size FROM part WHERE p_partkey % 3 = 0 ORDER BY p_partkey LIMIT 1) f")
def calibration_lookup(spark, sf):
    s = read(spark, sf, "lineitem").selectExpr("l_orderkey index", "l_linenumber line", "l_partkey calibration_id")
    return calibration.with_calibration(s, read(spark, sf, "part").where("p_partkey % 3 = 0").selectExpr("p_partkey calibration_id", "p_size coeff")).select("index", "line", "coeff", "fallback")


@query("SELECT l_partkey AS calibration_id, min(l_orderkey) AS first_index FROM lineitem GROUP BY 1 ORDER BY 2")
def first_seen_calibrations(spark, sf):
    return calibration.first_seen(read(spark, sf, "lineitem").selectExpr("l_orderkey index", "l_partkey calibration_id"))


@query("SELECT p_partkey AS part, (0.5::DOUBLE * (t - 1::DOUBLE)) * (0.5::DOUBLE * (t - 1::DOUBLE)) - ((0::DOUBLE * x + 0.25::DOUBLE) * x * x + 0.125::DOUBLE) AS refined FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS t, greatest(5::DOUBLE, least(40::DOUBLE, CAST(p_size AS DOUBLE))) AS x FROM part)")
def agilent_poly_mz(spark, sf):
    t = F.col("p_size").cast("double")
    lit = lambda v: F.lit(float(v))
    poly = F.array(lit(0.125), lit(0.25))  # powers 0 and 2
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), S.polynomial_mz(t, lit(0.5), lit(1), lit(5), lit(40), poly, F.lit(0b101)).alias("refined"))


@query("WITH v AS (SELECT p_partkey AS part, 200::DOUBLE + (40::DOUBLE - 200::DOUBLE) * (CAST(p_size AS DOUBLE) - 1::DOUBLE) / (50::DOUBLE - 1::DOUBLE) AS v FROM part) SELECT part, (v + (0.6::DOUBLE * (0.1::DOUBLE + 0.5::DOUBLE * 40::DOUBLE) - 40::DOUBLE)) / (0.1::DOUBLE + 0.5::DOUBLE * v) AS k0 FROM v")
def mobility_k0(spark, sf):
    c = {k: F.lit(float(v)) for k, v in {"c0": 1, "c1": 50, "c2": 200, "c3": 40, "c6": 0.5, "c7": 0.1, "low": 0.6}.items()}
    v = S.mobility_voltage(F.col("p_size").cast("double"), c["c0"], c["c1"], c["c2"], c["c3"])
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), S.inverse_mobility(v, c["c3"], c["c6"], c["c7"], c["low"]).alias("k0"))


@query("SELECT DISTINCT value AS mobility FROM events WHERE value IS NOT NULL AND NOT isnan(value)")
def distinct_axis(spark, sf):
    return calibration.distinct_axis(read(spark, sf, "events").selectExpr("value mobility"))


@query("WITH a AS (SELECT DISTINCT p_retailprice AS x FROM part), p AS (SELECT l_extendedprice / 10 AS x FROM lineitem), l AS (SELECT p.x, a.x AS below FROM p ASOF LEFT JOIN a ON p.x >= a.x), u AS (SELECT l.x, l.below, a.x AS above FROM l ASOF LEFT JOIN a ON l.x <= a.x) SELECT x, CASE WHEN above IS NULL OR x - below <= above - x THEN below ELSE above END AS nearest, abs(x - CASE WHEN above IS NULL OR x - below <= above - x THEN below ELSE above END) AS delta FROM u")
def nearest_axis(spark, sf):
    probe = read(spark, sf, "lineitem").selectExpr("l_extendedprice / 10 x")
    return calibration.nearest(probe, read(spark, sf, "part").selectExpr("p_retailprice x").distinct())


@query("SELECT ordinal, label, trim(value) AS value, TRY_CAST(trim(value) AS DOUBLE) AS value_float FROM log")
def trailers_tall(spark, sf):
    return vendor.tall(log(spark, sf))


@query("WITH f AS (SELECT ordinal, label, arg_min(value, position) AS value FROM log GROUP BY 1, 2) SELECT ordinal, max(value) FILTER (WHERE label = 'click') AS click, max(value) FILTER (WHERE label = 'view') AS view, max(value) FILTER (WHERE label = 'purchase') AS purchase FROM f GROUP BY 1")
def trailers_wide(spark, sf):
    return vendor.wide(log(spark, sf)).select("ordinal", "click", "view", "purchase")


@query("SELECT doc_id, coalesce(nullif(trim(regexp_replace(source || ' (' || coalesce(lang, '') || '):', '[^0-9A-Za-z]+', '_', 'g'), '_'), ''), 'col') AS name FROM documents")
def label_sanitize(spark, sf):
    return read(spark, sf, "documents").select("doc_id", X.sanitized_label(F.concat("source", F.lit(" ("), F.coalesce("lang", F.lit("")), F.lit("):"))).alias("name"))


@query("WITH l AS (SELECT source || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ':' ELSE ' -' END AS label, trim(regexp_replace(source, '[^0-9A-Za-z]+', '_', 'g'), '_') AS bare, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY 1, 2) SELECT label, CASE WHEN row_number() OVER (PARTITION BY bare ORDER BY first) = 1 THEN bare ELSE bare || '_' || (row_number() OVER (PARTITION BY bare ORDER BY first) - 1) END AS name FROM l")
def name_collision(spark, sf):
    """Labels that differ only in signs fall on one bare name."""
    rows = read(spark, sf, "documents").where("source is not null").selectExpr("concat(source, case doc_id % 3 when 0 then '' when 1 then ':' else ' -' end) label", "doc_id ordinal", "doc_id position", "'1' value")
    return vendor.column_names(rows).select("label", "name")


@query("SELECT page_id, CASE WHEN lower(regexp_extract(url, '[^/]*$')) LIKE '%ref=x' THEN 'drop' WHEN lower(regexp_extract(url, '[^/]*$')) LIKE '%_bin' THEN 'drop' WHEN lower(regexp_extract(url, '[^/]*$')) LIKE '%.html' THEN 'drop' ELSE 'embed' END AS action FROM pages")
def vendor_policy(spark, sf):
    return read(spark, sf, "pages").select("page_id", X.policy(F.col("url"), [("*REF=X", "drop")], [("*.html", "drop")], lossless=True).alias("action"))


@query("SELECT page_id, url, url LIKE 'https://%/en/%' OR url LIKE '%#top' AS dropped FROM pages")
def member_glob(spark, sf):
    return selection.dropped_members(read(spark, sf, "pages").selectExpr("page_id", "url name"), ["https://*/en/*", "*#top"]).selectExpr("page_id", "name url", "dropped")


@query("SELECT l_orderkey, l_linenumber, 'frame=' || l_orderkey AS frame, 'scan=' || l_linenumber AS scan, 'sample=' || 1 || ' period=1 cycle=' || l_orderkey || ' experiment=' || l_linenumber AS cycle, 'function=' || l_linenumber || ' process=0 scan=' || l_orderkey AS function FROM lineitem")
def native_ids(spark, sf):
    a, b = F.col("l_orderkey"), F.col("l_linenumber")
    return read(spark, sf, "lineitem").select(a, b, S.native_id("frame", a).alias("frame"), S.native_id("scan", b).alias("scan"), S.native_id("cycle", F.lit(1), a, b).alias("cycle"), S.native_id("function", b, a).alias("function"))


@query("SELECT o_orderkey AS index, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 2 END AS ms_level, CASE WHEN o_custkey % 2 = 0 THEN 'Centroid' ELSE 'Profile' END AS continuity FROM orders")
def line_spectra(spark, sf):
    array = "if(o_custkey % 2 = 0, abs(coalesce(o_orderkey, 0)) + 1, null)"  # numbers of arrays begin with 1, keys of orders with 0
    s = read(spark, sf, "orders").selectExpr("o_orderkey index", "if(o_custkey % 2 = 0, 0, 1) acquisition_key", f"{array} line_mz", f"{array} line_intensity")
    keys = spark.createDataFrame([(0, 0), (1, 1)], "acquisition_key long, code int").select("acquisition_key", S.level("rising", F.col("code")).alias("ms_level"))
    return calibration.line_spectra(s, keys).select("index", "ms_level", "continuity")


@query("WITH a AS (SELECT DISTINCT p_retailprice AS x FROM part), p AS (SELECT l_extendedprice / 10 AS x FROM lineitem), d AS (SELECT p.x, least(coalesce(p.x - l.x, 1e300), coalesce(u.x - p.x, 1e300)) AS d FROM p ASOF LEFT JOIN a l ON p.x >= l.x ASOF LEFT JOIN a u ON p.x <= u.x) SELECT count(*) AS n, max(d) AS max_delta, round(avg(d), 6) AS mean_delta, avg(CAST(d <= 1 AS DOUBLE)) AS within FROM d")
def axis_agreement(spark, sf):
    probe = read(spark, sf, "lineitem").selectExpr("l_extendedprice / 10 x")
    out = calibration.axis_agreement(probe, read(spark, sf, "part").selectExpr("p_retailprice x").distinct(), 1.0)
    return out.withColumn("mean_delta", F.round("mean_delta", 6))


@query("SELECT s_suppkey AS id, CAST(s_acctbal AS DOUBLE) AS c0 FROM supplier WHERE s_nationkey % 3 = 2 ORDER BY s_suppkey LIMIT 1")
def mobility_model(spark, sf):
    return calibration.mobility_model(read(spark, sf, "supplier").selectExpr("s_suppkey id", "s_nationkey % 3 model_type", "cast(s_acctbal as double) c0")).select("id", "c0")


@query("SELECT p_partkey AS part, 1.6::DOUBLE - (1.6::DOUBLE - 0.6::DOUBLE) * p_size / 50 AS k0, 90::DOUBLE AS widened FROM part")
def linear_mobility(spark, sf):
    a, b = S.line_calibration(100, 1000, 900, wider=True)
    lit = lambda v: F.lit(float(v))
    k0 = S.linear_mobility(F.col("p_size"), F.lit(50), lit(0.6), lit(1.6))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), k0.alias("k0"), F.lit(round(a * a) - 5.0).alias("widened"))


@query("SELECT p_partkey AS part, sqrt(CAST(p_size AS DOUBLE)) AS a, sqrt(CAST(p_size + 1 AS DOUBLE)) - sqrt(CAST(p_size AS DOUBLE)) AS b FROM part")
def model_of_converter(spark, sf):
    size = F.col("p_size").cast("double")
    a, b = S.model_of_converter(size, size + 1)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), a.alias("a"), b.alias("b"))


@query("SELECT spectrum_index, row_number() OVER (PARTITION BY spectrum_index ORDER BY tof, ordinal) - 1 AS place, ordinal, CAST(tof AS INTEGER) AS tof FROM points")
def points_by_tof(spark, sf):
    p = points(spark, sf).withColumn("tof", S.checked_int(F.col("tof")))
    return encode.reindexed(p, ["tof", "ordinal"], within=["spectrum_index"]).selectExpr("spectrum_index", "index place", "ordinal", "tof")


# --- names, files, images


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS slug, regexp_replace(url, '^.*[/\\\\]', '') AS scrubbed, NOT (url LIKE '/%' OR regexp_matches(url, '(^|/)\\.\\.(/|$)') OR regexp_matches(url, '^[A-Za-z]:')) AS safe, regexp_matches(lower(url), '\\.(xml|txt|method|tsf|tdf|json|csv|sqlite|cfg|ini|log)$') AS compressible FROM pages")
def member_names(spark, sf):
    u = F.col("url")
    return read(spark, sf, "pages").select("page_id", X.slug(u).alias("slug"), X.scrubbed(u).alias("scrubbed"), X.safe_member(u).alias("safe"), X.compressible(u).alias("compressible"))


@query("WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'PXD00' WHEN 1 THEN 'MTBLS' WHEN 2 THEN 'MSV' ELSE 'x' END || page_id || '_a' AS bare, CASE page_id % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'tif' WHEN 2 THEN 'svs' ELSE 'tsv' END AS ext FROM pages) SELECT page_id, CASE WHEN bare LIKE 'x%' THEN bare || '.sdrf' ELSE bare END AS accession, CASE ext WHEN 'PNG' THEN 'image/png' WHEN 'tsv' THEN 'application/octet-stream' ELSE 'image/tiff' END AS media FROM n")
def accession_and_media(spark, sf):
    name = F.expr("concat('runs/', case page_id % 4 when 0 then 'PXD00' when 1 then 'MTBLS' when 2 then 'MSV' else 'x' end, page_id, '_a.sdrf.', case page_id % 4 when 0 then 'PNG' when 1 then 'tif' when 2 then 'svs' else 'tsv' end)")
    return read(spark, sf, "pages").select("page_id", X.accession_hint(name).alias("accession"), X.media_type(name).alias("media"))


@query("SELECT page_id, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS size, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def sha_size(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"), X.xml_attribute(F.col("html"), "html", "lang").alias("lang"))


@query("SELECT p_partkey AS part, CASE WHEN p_size > 1 THEN 19::DOUBLE / (p_size - 1) ELSE 0::DOUBLE END AS sx, p_size <= 16777216 AS exact FROM part")
def affine_and_float(spark, sf):
    a = S.affine(F.col("p_size"), F.col("p_size"), F.lit(20), F.lit(10))
    return read(spark, sf, "part").select(F.col("p_partkey").alias("part"), a["sx"].alias("sx"), S.exact_in_float32(F.col("p_size")).alias("exact"))


@query("SELECT page_id, try_cast(CASE WHEN page_id % 3 = 0 THEN 'soon' ELSE '2024-01-0' || (1 + page_id % 9) || 'T10:00:00Z' END AS TIMESTAMP) AS started FROM pages")
def start_times(spark, sf):
    t = F.expr("case when page_id % 3 = 0 then 'soon' else concat('2024-01-0', 1 + page_id % 9, 'T10:00:00Z') end")
    return read(spark, sf, "pages").select("page_id", X.timestamp(t).cast("timestamp_ntz").alias("started"))


@query("SELECT page_id, CAST(page_id AS VARCHAR) AS pixels, CASE WHEN size < 1024 THEN CAST(size AS VARCHAR) || ' B' ELSE printf('%.1f KB', size / 1024.0::DOUBLE) END AS size FROM (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)")
def sizes_and_parameters(spark, sf):
    xml = F.concat(F.lit('<cvParam cvRef="IMS" accession="IMS:1000042" name="max count of pixels x" value="'), F.col("page_id").cast("string"), F.lit('"/>'))
    return read(spark, sf, "pages").select("page_id", X.cv_value(xml, "IMS:1000042").alias("pixels"), S.human_bytes(F.octet_length("html").cast("long")).alias("size"))


# --- reports


@query("SELECT format, count(*) AS files, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM results GROUP BY 1")
def status_matrix(spark, sf):
    return report.status_matrix(results(spark, sf))


@query("SELECT CASE WHEN grouping(format) = 1 THEN 'all' ELSE format END AS format, count(*) AS n, CAST(sum(out_bytes) AS DOUBLE) / CAST(sum(raw_bytes) AS DOUBLE) AS pooled, quantile_cont(CAST(out_bytes AS DOUBLE) / raw_bytes, 0.5) AS median FROM results WHERE status = 'ok' GROUP BY ROLLUP (format)")
def ratio_by_format_rollup(spark, sf):
    return report.size_ratios(results(spark, sf))


@query("SELECT count(*) AS n, CAST(sum(out_bytes) AS DOUBLE) / CAST(sum(raw_bytes) AS DOUBLE) AS pooled, round(avg(CAST(out_bytes AS DOUBLE) / raw_bytes), 9) AS mean FROM results WHERE raw_bytes >= 2000 AND format <> 'fixture'")
def pooled_ratio_floor(spark, sf):
    return report.large_ratio(results(spark, sf), 2000).withColumn("mean", F.round("mean", 9))


@query("SELECT m AS model_type, count(*) AS n, count(DISTINCT file) AS files FROM (SELECT o_orderkey AS file, unnest([o_custkey % 3, o_custkey % 2]) AS m FROM orders) GROUP BY 1")
def model_histogram(spark, sf):
    return report.model_histogram(read(spark, sf, "orders").selectExpr("o_orderkey file", "array(o_custkey % 3, o_custkey % 2) model_types"))


@query("SELECT (SELECT count(*) FROM pages) AS members, (SELECT count(*) FROM orders) AS spectra, (SELECT count(*) FROM customer) AS chromatograms")
def inspect_report(spark, sf):
    return report.inspected(*(read(spark, sf, t) for t in ("pages", "orders", "customer")))


@query("SELECT format, status, raw_bytes FROM results WHERE doc_id % 2 = 0 UNION ALL SELECT format, NULL, raw_bytes FROM results WHERE doc_id % 2 = 1")
def concat_results(spark, sf):
    r = results(spark, sf)
    return report.concatenated(r.where("doc_id % 2 = 0").select("format", "status", "raw_bytes"), r.where("doc_id % 2 = 1").select("format", "raw_bytes"))


@query("SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS far")
def lossless_check(spark, sf):
    p = points(spark, sf).select("spectrum_index", "ordinal", "mz", "intensity")
    return report.lossless_report(p, encode.unchunked(encode.chunked(p))).drop("max_ppm")


# --- small lookups


@query("SELECT count(*) AS frames, CAST(max(n) AS BIGINT) AS max_scans FROM (SELECT count(*) AS n FROM points GROUP BY spectrum_index)")
def frame_extent(spark, sf):
    frames = points(spark, sf).groupBy("spectrum_index").agg(F.count("*").alias("num_scans"))
    return calibration.frame_extent(frames)


@query("SELECT s.index, l_linenumber AS window FROM spectra s JOIN lineitem ON l_orderkey = s.index + 1")
def windows_of_position(spark, sf):
    windows = read(spark, sf, "lineitem").selectExpr("l_orderkey frame", "l_linenumber window")
    return calibration.windows_of_position(spectra(spark, sf).select("index"), windows)


@query("SELECT index, CASE WHEN ms_level < 3 THEN id END AS id, CASE WHEN ms_level < 3 THEN CAST(coalesce(n, 0) AS BIGINT) END AS n FROM spectra LEFT JOIN (SELECT spectrum_index, count(*) AS n FROM points GROUP BY 1) p ON p.spectrum_index = index")
def struct_child(spark, sf):
    """Counts put into a struct column; a null struct stays null."""
    s = spectra(spark, sf).select("index", F.when(F.col("ms_level") < 3, F.struct("id", F.lit(-1).cast("long").alias("n"))).alias("spectrum"))
    n = points(spark, sf).groupBy(F.col("spectrum_index").alias("index")).agg(F.count("*").alias("c"))
    return facets.with_child(s.join(n, "index", "left"), "spectrum", "n", F.coalesce("c", F.lit(0))).select("index", "spectrum.id", "spectrum.n")


@query("SELECT spectrum_index AS key, count(*) AS n FROM points GROUP BY 1")
def chunk_point_counts(spark, sf):
    """A chunk counts as many points as its lists hold."""
    return facets.point_counts(encode.chunked(points(spark, sf)))


@query("SELECT spectrum_index, ordinal, CAST(intensity AS INTEGER) AS intensity FROM points")
def integer_intensity(spark, sf):
    return encode.integer_intensity(points(spark, sf)).select("spectrum_index", "ordinal", "intensity")
