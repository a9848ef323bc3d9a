"""Line spectra of TSF runs: a SQLite frame table and a file of compressed frames, decoded where the tasks run."""

from __future__ import annotations

import struct
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.functions.binary import line_frame
from lumenspec.functions.scalar import level, line_calibration, native_id, polarity, seconds_to_minutes
from lumenspec.sources import sqlite

# Fixed value: the software whose runs need a wider range.
WIDER = "Bruker otofControl"


def calibration(meta: dict[str, str]) -> tuple[float, float]:
    """(a, b) of sqrt(mz) = a + b * tof from a run's metadata."""
    low, high, samples = (float(meta[k]) for k in ("MzAcqRangeLower", "MzAcqRangeUpper", "DigitizerNumSamples"))
    return line_calibration(low, high, samples, meta.get("AcquisitionSoftware", "").strip() == WIDER)


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Spectra (index, id, time, ms_level, polarity, mz, intensity) of a TSF folder that all executors see."""
    a, b = calibration(sqlite.global_metadata(folder) or {})
    frames = sqlite.table(spark, f"{folder}/analysis.tsf", "SELECT Id, Time, MsMsType, Polarity, NumPeaks, TimsId FROM Frames ORDER BY Id", "id long, time double, type int, sign string, n long, offset long")
    data = str(Path(folder) / "analysis.tsf_bin")

    def run(batches):
        with open(data, "rb") as f:
            for pdf in batches:
                mz, inten = [], []
                for n, offset in zip(pdf["n"], pdf["offset"], strict=True):
                    if n < 0 or offset < 0:
                        raise ValueError("negative count or offset of a frame")
                    if n == 0:
                        tof, i = line_frame(b"", 0)
                    else:
                        f.seek(offset)
                        head = f.read(8)
                        tof, i = line_frame(head + f.read(struct.unpack("<II", head)[1]), n)
                    mz.append(((a + b * tof) ** 2).tolist())
                    inten.append(i.astype(float).tolist())
                yield pd.DataFrame({"id": pdf["id"], "mz": mz, "intensity": inten})

    arrays = frames.select("id", "n", "offset").mapInPandas(run, "id long, mz array<double>, intensity array<double>")
    rows = frames.join(arrays, "id")
    return rows.select((F.col("id") - 1).alias("index"), native_id("frame", F.col("id")).alias("id"), seconds_to_minutes(F.col("time")).alias("time"), level("line", F.col("type")).alias("ms_level"), polarity(F.col("sign")).alias("polarity"), "mz", "intensity")
