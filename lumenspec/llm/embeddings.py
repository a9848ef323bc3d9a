"""Near-duplicate embeddings by sorted projection passes.

Each pass orders all vectors lexicographically by a concatenation of random
hashes, the nearest of some random pivots and then signs of projections of
what is left, and compares each with a bounded window of neighbours. The pairs
of all passes are united to groups; in a last step every pair inside a group
is compared exactly, so that a window bounds no vector's number of links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import components, forest, saved, shared_dir, ship

#: Passes, neighbours compared on each side and pivots for BASE vectors or fewer; for more they grow with the powers
#: of their number that follow, as neighbours in a dense region get more.
PASSES, WINDOW, PIVOTS, BASE = 16, 256, 64, 65_536
GROWTH = (0.2, 0.3, 0.3)
#: Pivots of all passes are drawn from so many vectors at most, those with the lowest hashes.
POOL = 4096
#: Sign hashes in an order key, seed of the random directions.
BITS, SEED = 62, 77
#: Passes compare vectors of 8-bit integers; this much below the threshold is still a candidate for the exact step.
SLACK = 0.01
#: Vectors of a group that one task compares with as many others.
BLOCK = 1024
ROW = "a long, b long, part int, ord long, n long, p int, dim int, node long, q binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sketches(passes: int, pivots: int, pool: dict[int, np.ndarray]):
    def run(batches):
        drawn: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for batch in batches:
            by_dim: dict[int, list[int]] = {}
            vectors = batch.column(1)
            for k in range(len(vectors)):
                by_dim.setdefault(len(vectors[k]), []).append(k)
            for dim, rows in by_dim.items():
                if dim not in drawn:
                    r, known = np.random.default_rng([SEED, dim]), pool.get(dim, np.zeros((1, dim)))
                    drawn[dim] = r.standard_normal((dim, passes * BITS)), [known[r.integers(0, len(known), pivots)] for _ in range(passes)]
                directions, chosen = drawn[dim]
                x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                x /= np.abs(x).max(1, keepdims=True)
                small = np.round(x * 127).astype(np.int8)
                x = _unit(x)
                node, quant = batch.column(0).take(pa.array(rows)), pa.array([q.tobytes() for q in small], pa.binary())
                for p in range(passes):
                    cell = (x @ chosen[p].T).argmax(1)
                    signs = (x - chosen[p][cell]) @ directions[:, p * BITS : (p + 1) * BITS] > 0
                    keys = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    ints = [pa.array(v, pa.int32()) for v in (np.full(len(rows), p), np.full(len(rows), dim), cell)]
                    yield pa.RecordBatch.from_arrays([*ints, pa.array(keys), node, quant], ["p", "dim", "cell", "k", "node", "q"])

    return run


def _compare(node: np.ndarray, q: np.ndarray, old: int, least: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The candidate pairs among rows in order, less those of the first ``old`` among themselves, as stars."""
    x = _unit(q.astype(np.float32))
    out_a, out_b = [], []
    for at in range(old, len(x), 256):
        low, high = max(0, at - window), min(len(x), at + 256)
        i, j = np.nonzero(x[at:high] @ x[low:high].T >= least)
        i, j = i + at, j + low
        near = (j < i) & (i - j <= window)
        out_a.append(node[i[near]])
        out_b.append(node[j[near]])
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (out_a, out_b))
    return forest(a, b) if len(a) else (a, b)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], NAMES)


def _windows(least: float, window: int):
    """Pairs (a, b) within a partition's windows; and its first and last rows, which have partners in other partitions."""

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        last, node0, q0 = None, np.empty(0, np.int64), None
        first, end = [], []
        for batch in batches:
            p, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            node, raw = batch.column(4).to_numpy(), batch.column(5)
            rows = lambda low, high: list(zip(range(n + low, n + high), p[low:high].tolist(), dim[low:high].tolist(), node[low:high].tolist(), raw.slice(low, high - low).to_pylist(), strict=True))  # noqa: B023, E731
            first += rows(0, min(len(p), max(0, window - n)))
            end = (end + rows(max(0, len(p) - window), len(p)))[-window:]
            n += len(p)
            edges = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(dim) != 0)) + 1).tolist(), len(p)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                q = np.frombuffer(b"".join(raw.slice(a, b - a).to_pylist()), np.int8).reshape(b - a, int(dim[a]))
                m, old = node[a:b], 0
                if last == (p[a], dim[a]):
                    q, m, old = np.concatenate([q0, q]), np.concatenate([node0, m]), len(node0)
                yield _pairs(*_compare(m, q, old, least, window))
                last, node0, q0 = (p[a], dim[a]), m[-window:], q[-window:]
        border = list({r[0]: r for r in first + end}.values())
        for at in range(0, len(border), 1024):
            o, *rest = zip(*border[at : at + 1024], strict=True)
            k = len(o)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([None] * k, [None] * k, [part] * k, o, [n] * k, *rest), types, strict=True)], NAMES)

    return run


def _borders(starts: dict[int, int], window: int):
    """Rows with the borders (first position after each) that lie within a window of them."""
    borders = np.array(sorted(set(starts.values())), np.int64)

    def run(batches):
        for pdf in batches:
            pos = pdf["part"].map(starts).to_numpy(np.int64) + pdf["ord"].to_numpy(np.int64)
            low, high = np.searchsorted(borders, pos - window, "right"), np.searchsorted(borders, pos + window, "right")
            at = np.repeat(np.arange(len(pdf)), high - low)
            border = borders[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)]).astype(np.int64)] if len(at) else np.empty(0, np.int64)
            yield pd.DataFrame({"border": border, "pos": pos[at], **{c: pdf[c].to_numpy()[at] for c in ("p", "dim", "node", "q")}})

    return run


def _across(least: float, window: int):
    """Stars of the pairs that stand on both sides of a border, at most a window apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        border, out = pdf["border"].iloc[0], []
        for (_, dim), g in pdf.groupby(["p", "dim"]):
            pos, node = g["pos"].to_numpy(), g["node"].to_numpy()
            x = _unit(np.frombuffer(b"".join(g["q"]), np.int8).reshape(len(g), dim).astype(np.float32))
            i, j = np.flatnonzero(pos < border), np.flatnonzero(pos >= border)
            near = (x[i] @ x[j].T >= least) & (pos[j][None, :] - pos[i][:, None] <= window)
            a, b = np.nonzero(near)
            if len(a):
                out.append(pd.DataFrame(dict(zip("ab", forest(node[i][a], node[j][b]), strict=True))))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    return run


def candidates(nodes: DataFrame, threshold: float, passes: int = PASSES, window: int = WINDOW, pivots: int = PIVOTS) -> DataFrame:
    """Pairs (a, b) of nodes (node, v) that some pass brings into one window, wherever partitions of the order end; one shuffle sorts all passes."""
    pool: dict[int, list] = {}
    for (v,) in nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(POOL).select("v").collect():
        pool.setdefault(len(v), []).append(v)
    units = {dim: _unit(x / np.abs(x).max(1, keepdims=True)) for dim, vs in pool.items() for x in (np.array(vs, np.float64),)}
    sketch = nodes.select("node", "v").mapInArrow(_sketches(passes, pivots, units), "p int, dim int, cell int, k long, node long, q binary")
    key = ["p", "dim", "cell", "k", "node"]
    rows = saved(sketch.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_windows(threshold - SLACK, window), ROW), "windows")
    sizes = dict(rows.where("part is not null").select("part", "n").distinct().collect())  # a number for each partition
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    near = rows.where("part is not null").select("part", "ord", "p", "dim", "node", "q").mapInPandas(_borders(starts, window), "border long, pos long, p int, dim int, node long, q binary")
    return rows.where("a is not null").select("a", "b").unionByName(near.groupBy("border").applyInPandas(_across(threshold - SLACK, window), "a long, b long"))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and 1, so that no square overflows or vanishes; cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _exact(threshold: float):
    """Links among the members of each group in a task, counted with copies, and a forest of them."""

    def pairs(a: pd.DataFrame, b: pd.DataFrame, same: bool) -> list[pd.DataFrame]:
        x, y = (_scaled(np.stack(t["v"].to_numpy()).astype(np.float64)) for t in (a, b))
        near = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]) >= threshold
        if same:
            np.fill_diagonal(near, False)
        na, nb = a["node"].to_numpy(), b["node"].to_numpy()
        out = [pd.DataFrame({"node": na, "links": near @ b["n"].to_numpy(), "other": -1, "edge": False})]
        if not same:
            out.append(pd.DataFrame({"node": nb, "links": near.T @ a["n"].to_numpy(), "other": -1, "edge": False}))
        i, j = np.nonzero(near)
        if len(i):
            s, t = forest(na[i], nb[j])
            out.append(pd.DataFrame({"node": s, "links": 0, "other": t, "edge": True}))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["component", "dim"]):
            if g["i"].iloc[0] == g["j"].iloc[0]:
                out += pairs(g, g, True)
            elif (g["side"] == 0).any() and (g["side"] == 1).any():
                out += pairs(g[g["side"] == 0], g[g["side"] == 1], False)
        return pd.concat(out) if out else pd.DataFrame({"node": [], "links": [], "other": [], "edge": []})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, passes: int | None = None, window: int | None = None) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    Rows link at a cosine (in double precision) of ``threshold`` or more.
    n_links counts the other rows linked directly, component_id is the
    smallest id reachable, kept marks the row that bears it. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows with a
    null id, link with nothing; vectors of different lengths never link.
    Equal vectors are one node with a count, so repeated rows link with
    each other; an id that names several different vectors stands for all of them. Other columns are ignored.

    A link is found if some pass brings its ends, or a chain of links between
    them, into a window. Passes and window follow the number of vectors
    unless they are given. Groups of more than BLOCK vectors are compared block
    by block; each task returns counts and a forest, never all pairs.
    """
    shared_dir(vectors.sparkSession)
    v = F.col("v")
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).withColumn("fine", fine)
    rows = rows.withColumn("h1", F.when(F.col("fine"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("fine"), F.xxhash64("v", F.lit(1))))
    nodes = saved(rows.where("fine").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")), "vectors")
    larger = max(1.0, nodes.count() / BASE)
    many, wide, pivots = (round(n * larger**power) for n, power in zip((PASSES, WINDOW, PIVOTS), GROWTH, strict=True))
    coarse = components(candidates(nodes, threshold, passes or many, window or wide, pivots)).checkpoint()
    members = coarse.join(nodes, "node").select("component", "node", "n", "v", F.size("v").alias("dim"))
    sizes = coarse.groupBy("component").agg(F.count("*").alias("size"))
    shared = max(1, coarse.count() // BLOCK)
    dealt = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("i0", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("i0")).alias("i"), F.greatest(j, F.col("i0")).alias("j"), (j < F.col("i0")).cast("int").alias("side"))))
    dealt = dealt.select("component", "node", "n", "v", "dim", "blocks", pair.alias("x")).select("component", "node", "n", "v", "dim", "x.i", "x.j", "x.side", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(shared)) - shared).otherwise(F.col("component")).alias("key"))
    exact = saved(dealt.groupBy("key", "i", "j").applyInPandas(_exact(threshold), "node long, links long, other long, edge boolean"), "links")
    links = exact.where("not edge").groupBy("node").agg(F.sum("links").alias("links"))
    found = components(exact.where("edge").selectExpr("node a", "other b"))
    of = nodes.select("h1", "h2", "node", "n").join(links, "node", "left").join(found, "node", "left")
    out = rows.select("id", "h1", "h2").join(of, ["h1", "h2"], "left").withColumn("c", F.coalesce("component", "node", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))


ship(__name__)
