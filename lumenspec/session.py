"""Session defaults for runs on a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: ANSI keeps integer overflow an error; zstd and adaptive plans suit large facets.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def session(name: str = "lumenspec", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in {**DEFAULTS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
