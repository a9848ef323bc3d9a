"""Helpers shared by the text operators: shared storage, shipping of Python
code to executors, and connected components of an edge table."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few bytes that are broadcast at most; beyond, they are joined by shuffle.
FEW_KEYS = 500_000
#: Code points of a block of a text.
BLOCK = 4096
#: Rows of an Arrow batch: at 2 KB a text, a few MB for each worker and each task.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def few(keys: DataFrame) -> DataFrame:
    """A table of thin rows with a broadcast hint if a count of it shows FEW_KEYS rows at most, as it is otherwise."""
    return F.broadcast(keys) if keys.limit(FEW_KEYS + 1).count() <= FEW_KEYS else keys


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body's own lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocks(text: Column) -> Column:
    """A text as an array of BLOCK code points each, so that cut() needn't count from the text's beginning."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text from its blocks()."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(held, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))


def ship(module: str) -> None:
    """Send the functions of a module to executors by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only where the session names none (tests), a temporary one is set.

    Texts are long, so Arrow batches are made smaller too, where the session leaves their size at the default.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isDefined():
        return named.get()
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lumenspec-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors, goes at session end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its tree) that connect what the edges a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, low[x], low[y])
        np.minimum.at(new, low[y], low[x])
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    far = low != np.arange(len(nodes))
    return nodes[far], nodes[low[far]]


def _stars(batches):
    for pdf in batches:
        if len(pdf):
            a, b = forest(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
            yield pd.DataFrame({"a": a, "b": b})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long) as (node, component), component being the smallest node.

    Alternates large-star and small-star rounds, each written to the shared
    folder, until the edge set stays the same; every batch of edges is first
    contracted to stars where it lies. Null ends and loops are ignored, nodes
    without edges don't appear, an empty table gives an empty table.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    tidy = edges.where("a is not null and b is not null and a <> b").selectExpr("cast(greatest(a, b) as long) a", "cast(least(a, b) as long) b")
    now, before = tidy.mapInPandas(_stars, "a long, b long").distinct().checkpoint(), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.selectExpr("a node", "b component").unionByName(now.selectExpr("b node", "b component").distinct())
        before = mark
        both = now.unionByName(now.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(low, "a")
        small = met.selectExpr("a", "m b").unionByName(met.where("b > m").selectExpr("b a", "m b"))
        now = small.distinct().checkpoint()


ship(__name__)
