"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Keys and the virtual nodes of all shards lie on one ring. A key belongs to the
next node clockwise; where that node's shard is full, it goes on to the next
node whose shard has room. Rows are ordered along the ring once, so whatever
is decided for an arc (the keys between two nodes) is a table of a fixed size:
ranks of the arc from a to b go to shard s. Only that table goes through the
rounds in which full shards hand on what they can't hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenspec.llm.common import saved
from lumenspec.llm.linededup import free_name

#: Least bits of a key's hash that name its cell of the ring; nodes lie between cells.
CELL_BITS = 16
#: Low bits of monotonically_increasing_id that count a partition's rows.
ROW_BITS = (1 << 33) - 1


def cell_bits(shards: int, replicas: int) -> int:
    """Bits of a cell, so that there are 16 cells and more for each node."""
    return max(CELL_BITS, (16 * shards * replicas - 1).bit_length())


def nodes(spark: SparkSession, shards: int, replicas: int) -> DataFrame:
    """(node, shard, place): ``replicas`` nodes for each shard, numbered clockwise; a node serves the cells up to its place. One partition."""
    h = F.xxhash64(F.lit("node"), "shard", "replica")
    every = spark.range(0, shards * replicas, 1, 1).select((F.col("id") % shards).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("replica"))
    placed = every.select("shard", h.alias("h"), F.shiftrightunsigned(h, 64 - cell_bits(shards, replicas)).alias("place"))
    return placed.select((F.row_number().over(Window.orderBy("place", "h", "shard")) - 1).alias("node"), "shard", "place")


def arcs_of_cells(ring: DataFrame, bits: int) -> DataFrame:
    """(cell, arc): arc a lies before node a; the last arc lies behind all nodes and goes on to node 0."""
    before = F.coalesce(F.sum("count").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.broadcast(ring.groupBy(F.col("place").alias("cell")).count())
    return ring.sparkSession.range(0, 1 << bits, 1, 1).withColumnRenamed("id", "cell").join(at, "cell", "left").select("cell", before.cast("int").alias("arc"))


def room(spark: SparkSession, total: int, shards: int, slack: float | None) -> DataFrame:
    """(shard, room, filled): rows a shard may hold. Without slack they differ by one at most and sum up to ``total``."""
    cap = f"{total} div {shards} + cast(id < {total % shards} as int)" if slack is None else f"cast(ceil({total} * {1 + slack}D / {shards}) as long)"
    return spark.range(0, shards, 1, 1).selectExpr("cast(id as int) shard", f"{cap} room", "0L filled")


def fill(arcs: DataFrame, ring: DataFrame, rooms: DataFrame) -> DataFrame:
    """(arc, start, parts): for each arc of (arc, n), the ring's rows before it and what ranks of it go to which shard.

    In every round each arc sends what it has left to the next open shard
    clockwise. A shard takes arcs in the order of a hash until it is full;
    the rest goes on in the next round. Each round but the last fills a shard,
    so there are no more rounds than shards. All tables have a row for each
    node or shard, however many rows the corpus has, and lie in one partition.
    """
    spark, order = arcs.sparkSession, Window.orderBy("arc")
    every = spark.range(0, ring.count() + 1, 1, 1).select(F.col("id").cast("int").alias("arc"))
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = every.join(F.broadcast(arcs), "arc", "left").join(F.broadcast(ring.select(F.col("node").alias("arc"), "shard")), "arc", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    none = F.array().cast("array<struct<shard:int,first:bigint,n:bigint,slot:bigint>>")
    now = known.select("arc", "shard", start.alias("start"), F.lit(0).cast("long").alias("first"), "n", none.alias("parts"))
    while True:
        goal = rooms.select(F.col("shard").alias("goal"), "room", "filled")
        is_open = F.when(F.col("room") > 0, F.col("shard"))
        ahead = F.first(is_open, ignorenulls=True)
        sent = now.coalesce(1).join(F.broadcast(rooms.select("shard", "room")), "shard", "left").select(*now.columns, F.coalesce(ahead.over(order.rowsBetween(0, Window.unboundedFollowing)), ahead.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("goal"))
        queue = Window.partitionBy("goal").orderBy(F.xxhash64(F.lit("arc"), "arc"), "arc").rowsBetween(Window.unboundedPreceding, -1)
        met = sent.join(F.broadcast(goal), "goal", "left").withColumn("before", F.coalesce(F.sum("n").over(queue), F.lit(0)))
        taken = met.withColumn("take", F.coalesce(F.greatest(F.lit(0).cast("long"), F.least("n", F.col("room") - F.col("before"))), F.lit(0).cast("long")))
        part = F.array(F.struct(F.col("goal").alias("shard"), F.col("first"), F.col("take").alias("n"), (F.col("filled") + F.col("before")).alias("slot")))
        held = saved(taken.select("arc", "shard", "start", "first", "n", "goal", "take", F.when(F.col("take") > 0, F.concat("parts", part)).otherwise(F.col("parts")).alias("parts")), "arcs")
        now = held.select("arc", "shard", "start", (F.col("first") + F.col("take")).alias("first"), (F.col("n") - F.col("take")).alias("n"), "parts")
        if not now.where("n > 0").limit(1).count():
            return now.select("arc", "start", "parts")
        more = held.coalesce(1).groupBy(F.col("goal").alias("shard")).agg(F.sum("take").alias("more"))
        more_or_none = F.coalesce("more", F.lit(0))
        rooms = saved(rooms.coalesce(1).join(F.broadcast(more), "shard", "left").select("shard", (F.col("room") - more_or_none).alias("room"), (F.col("filled") + more_or_none).alias("filled")), "room")


def assign(docs: DataFrame, key: str = "doc_id", shards: int = 40, replicas: int = 64, slack: float | None = None) -> DataFrame:
    """``docs`` with shard (int, from 0) and slot (long, gapless from 0 in each shard).

    Without ``slack`` the shards' counts differ by one at most; with it, a
    shard holds at most (1 + slack) times the mean, and fewer rows move when
    a shard is added. Which shard a row gets follows from its key, the other
    keys and the number of shards: not from how the table is stored, but for
    rows that repeat a key (those are told apart by their place in the table,
    so copies of one key spread over shards as soon as one is full).
    A null key is a key like any other. All rows and columns are kept; if
    shard or slot is taken, the new column's name gets underscores at its
    end. An empty table gives an empty table.

    Rows are shuffled once, by ranges of their place on the ring, and written
    to the shared folder in that order; a row's rank is its partition's start
    plus its place there. What is broadcast has a size that follows from
    ``shards`` and ``replicas``, and a row for each partition.
    """
    if shards < 1 or replicas < 1:
        raise ValueError("at least one shard and one node each")
    spark, bits = docs.sparkSession, cell_bits(shards, replicas)
    plain = [f"_{k}" for k in range(len(docs.columns))]
    named = F.coalesce(F.col(plain[docs.columns.index(key)]).cast("string"), F.lit(""))
    h = F.xxhash64(named)
    on_ring = docs.toDF(*plain).select("*", F.shiftrightunsigned(h, 64 - bits).alias("cell"), h.alias("h"), named.alias("key"), F.monotonically_increasing_id().alias("uid"))
    along = ["cell", "h", "key", "uid"]
    laid = saved(on_ring.repartitionByRange(*along).sortWithinPartitions(*along).select(*plain, "cell", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(ROW_BITS).alias("at")), "ring")
    ring = saved(nodes(spark, shards, replicas), "nodes").coalesce(1)
    cells = F.broadcast(saved(arcs_of_cells(ring, bits), "cells"))
    sizes = saved(laid.groupBy("part").agg(F.count("*").alias("n")), "parts")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    starts = sizes.coalesce(1).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    arcs = laid.join(cells, "cell").groupBy("arc").agg(F.count("*").alias("n"))
    filled = fill(arcs, ring, room(spark, total, shards, slack))
    rank = F.col("base") + F.col("at") - F.col("start")
    met = laid.join(F.broadcast(starts), "part").join(cells, "cell").join(F.broadcast(filled), "arc").withColumn("rank", rank)
    mine = met.withColumn("mine", F.expr("filter(parts, p -> rank >= p.first and rank < p.first + p.n)[0]"))
    return mine.select(*(F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)), F.col("mine.shard").alias(free_name(docs, "shard")), (F.col("mine.slot") + F.col("rank") - F.col("mine.first")).alias(free_name(docs, "slot")))


def write_shards(docs: DataFrame, path: str, files: int, key: str = "doc_id", shards: int = 40, replicas: int = 64, slack: float | None = None) -> None:
    """Writes ``docs`` as Parquet in one folder for each shard, in about ``files`` files that hold consecutive slots."""
    out = assign(docs, key, shards, replicas, slack)
    shard, slot = out.columns[-2:]
    out.repartitionByRange(files, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
