"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

A fingerprint splits into segments. Two fingerprints at most ``2 * r + 1``
bits apart over two segments agree in one segment up to ``r`` bits, so the
small Hamming ball around each segment is enumerated, looked up in the table
of segments, and every match is verified on the complete fingerprint.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.llm.common import FEW_KEYS, components, few, saved, shared_dir, ship

#: A segment value held by more fingerprints than this is compared in blocks.
HOT_BUCKET, BLOCK = 64, 2048


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of the n-word shingles of a text, in order, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, len(words) - n + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned number; 0 for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * total > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long) of every row; null or blank texts get fingerprint 0."""

    def run(batches):
        for batch in batches:
            fp = np.array([majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["i", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "i long, fp long").withColumnRenamed("i", id_col)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into a and b of links that connect what all links between a and b connect."""
    left, todo = np.arange(len(b)), list(range(len(a)))
    reach, seen, out = np.zeros(len(a), bool), np.zeros(len(b), bool), ([], [])
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= distance
    for start in todo:
        if reach[start]:
            continue
        reach[start], edge = True, [start]
        while edge:
            i = edge.pop()
            new = left[near[i] & ~seen]
            seen[new] = True
            out[0].extend([i] * len(new))
            out[1].extend(new.tolist())
            for j in new.tolist():
                more = np.flatnonzero(near[:, j] & ~reach)
                reach[more] = True
                out[0].extend(more.tolist())
                out[1].extend([j] * len(more))
                edge.extend(more.tolist())
    return np.array(out[0], int), np.array(out[1], int)


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Verified links (a, b) between rows (fp, node), enough to connect all fingerprints at most ``distance`` (3) bits apart.

    Ordinary segment values give every link. A value that more than
    HOT_BUCKET fingerprints share is cut into blocks of about BLOCK
    fingerprints; each pair of blocks is compared completely in one task,
    which returns a spanning forest of the links there, so no group is
    collected whole and none emits all its pairs.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    halves = prints.selectExpr("fp", "node", "explode(array(named_struct('s', 0L, 'h', shiftrightunsigned(fp, 32)), named_struct('s', 4294967296L, 'h', fp & 4294967295L))) x").selectExpr("fp", "node", "x.s + x.h key", "x.h h")
    held = halves.select("key", "fp", "node")
    # A pair that differs in one bit of the segment is found from the side that has 0 there.
    ball = halves.selectExpr("fp", "node", "explode(concat(array(key), filter(transform(sequence(0, 31), i -> if(shiftright(h, i) & 1 = 0, key + shiftleft(1L, i), null)), x -> x is not null))) key")
    hot = held.groupBy("key").count().where(F.col("count") > HOT_BUCKET).checkpoint()
    n_hot = hot.count()
    probe, mate = ball, held
    if n_hot:
        known = F.broadcast(hot.select("key")) if n_hot <= FEW_KEYS else hot.select("key")
        probe, mate = ball.join(known, "key", "left_anti"), held.join(known, "key", "left_anti")
    # The merge hint keeps one plan at every size.
    found = probe.alias("p").join(mate.alias("t").hint("merge"), "key").where(f"p.fp <> t.fp and bit_count(p.fp ^ t.fp) <= {distance}").selectExpr("p.node a", "t.node b")
    if not n_hot:
        return found

    hot_ball = ball.join(F.broadcast(hot) if n_hot <= FEW_KEYS else hot, "key")
    dealt = hot.join(hot_ball.groupBy("key").agg(F.count("*").alias("probes")), "key").selectExpr("key", f"cast(ceil(count / {BLOCK}) as int) nt", f"cast(ceil(probes / {BLOCK}) as int) np").checkpoint()
    dealt = F.broadcast(dealt) if n_hot <= FEW_KEYS else dealt
    t = held.join(dealt, "key").selectExpr("key", "fp", "node", "1 held", "cast(pmod(xxhash64(fp), nt) as int) i", "explode(sequence(0, np - 1)) j")
    p = ball.join(dealt, "key").selectExpr("key", "fp", "node", "0 held", "explode(sequence(0, nt - 1)) i", "cast(pmod(xxhash64(fp, 7), np) as int) j")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        is_held = pdf["held"].to_numpy() == 1
        fp, node = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)
        i, j = _near(fp[~is_held], fp[is_held], distance)
        a, b = node[~is_held][i], node[is_held][j]
        return pd.DataFrame({"a": a[a != b], "b": b[a != b]})

    return found.unionByName(p.unionByName(t.select(p.columns)).groupBy("key", "i", "j").applyInPandas(block, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per input row: (id_col, fp long, component_id).

    Rows link when their fingerprints differ in at most ``distance`` bits;
    component_id is the smallest id reachable. Rows with equal fingerprints
    are one node, whatever their number. Null and blank texts have
    fingerprint 0 and link like any other; repeated rows stay repeated; rows
    with a null id get the component of their fingerprint, or null if only
    such rows have it. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    prints = saved(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("node"))
    kept = saved(nodes, "nodes")
    found = components(links(kept.where("node is not null"), distance))
    of = kept.join(found, "node", "left").selectExpr("fp", "coalesce(component, node) component_id")
    return prints.join(of, "fp", "left").select(id_col, "fp", "component_id")


#: One text in so many is read to learn which shingles are common, and a shingle counts as common in so many of them.
SAMPLE, COMMON = 16, 3
#: Texts, and shingle hashes, of a crowded shingle that one task compares with as many others.
BLOCK_TEXTS, BLOCK_HASHES = 4096, 1_000_000
#: Pairs to a text of a shingle that sketches may leave to be verified pair by pair, each once wherever it is met; where they leave more, the block is verified in one task.
FEW_PAIRS = 2
#: Bits of the smallest sketch; a text of more shingles has the next power of two.
SKETCH_BITS = 512
PROFILE = "c long, n long, fp long, sketch binary, prefix array<long>"


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of hashes in each of about as many cells as there are hashes.

    Cells in which two sketches differ are never more than the shingles in
    which the sets differ, so a sketch rules pairs out and never wrongly.
    """
    bits = max(SKETCH_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """Differing cells of two sketches, the longer one folded to the shorter one's cells."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    m, n = len(a) * 8, len(b) * 8
    while m != n:
        if m > n:
            m //= 2
            x = (x & ((1 << m) - 1)) ^ (x >> m)
        else:
            n //= 2
            y = (y & ((1 << n) - 1)) ^ (y >> n)
    return (x ^ y).bit_count()


def _most_apart(similarity: float) -> float:
    """Shingles in which two linked sets may differ, as a share of the sum of their sizes."""
    return (1 - similarity) / (1 + similarity)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the texts (c, text) has often, at most FEW_KEYS of them, the commonest last, and about how many texts hold each."""

    def run(batches):
        seen = set()
        for batch in batches:
            held = [np.empty(0, np.uint64)]
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c not in seen:
                    seen.add(c)
                    held.append(_shingle_set(text.as_py(), shingle))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["h"])

    often = docs.where(f"pmod(c, {SAMPLE}) = 0").mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    held = often.orderBy(F.desc("count"), "h").limit(FEW_KEYS).toArrow()
    return held["h"].to_numpy()[::-1].copy().view(np.uint64), held["count"].to_numpy()[::-1].copy() * SAMPLE


def _profiles(docs: DataFrame, common: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """Of each text (c, text) with words: its number of distinct shingles, their fingerprint, their sketch and the first of them.

    All sets are ordered alike, common shingles last. Two sets of the given
    similarity share one of their first ``n - ceil(similarity * n) + 1``.
    """
    order = np.argsort(common)
    ranks = docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches):
        known, rank = ranks.value
        seen = set()
        for batch in batches:
            rows = []
            for c, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c in seen:
                    continue
                seen.add(c)
                h = _shingle_set(text.as_py(), shingle)
                if not len(h):
                    continue
                fp, cells = majority(h), sketch(h)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, rank[at], -1), kind="stable")]
                # A bit below the product, so that rounding never shortens a prefix.
                first = h[: len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1]
                rows.append((c, len(h), fp - 2**64 if fp >= 2**63 else fp, cells, first.view(np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int64()))], ["c", "n", "fp", "sketch", "prefix"])

    return docs.mapInArrow(run, PROFILE)


def _some(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(c, s) the shingle sets of the wanted texts, each once."""
    def run(batches):
        seen = set()
        for batch in batches:
            fresh = []
            for k, c in enumerate(batch.column(0).to_pylist()):
                if c not in seen:
                    seen.add(c)
                    fresh.append(k)
            part = batch.take(pa.array(fresh, pa.int64()))
            sets = [_shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["c", "s"])

    met = docs.join(few(wanted), "c").select("c", "text")
    return met.mapInArrow(run, "c long, s array<long>").groupBy("c").agg(F.first("s").alias("s"))


def _near_rows(n: np.ndarray, label: np.ndarray, cells: list[bytes], similarity: float, first: int | None = None):
    """Yields (i, j) arrays: rows with other labels whose sizes and sketches let them link, i before j; with ``first``, i below and j from it on."""
    share, width = _most_apart(similarity), np.fromiter(map(len, cells), np.int64, len(cells))
    side = np.arange(len(cells)) >= first if first is not None else None
    held = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    rows = {w: np.frombuffer(b"".join(cells[k] for k in at.tolist()), np.uint64).reshape(len(at), w // 8) for w, at in held.items()}
    for w, at in held.items():
        for other in (w, 2 * w):
            if other not in held:
                continue
            there, x, y = held[other], rows[w], rows[other]
            if other != w:
                y = y[:, : w // 8] ^ y[:, w // 8 :]
            step = max(1, 2_000_000 // max(1, len(there) * (w // 8)))
            for low in range(0, len(at), step):
                i = at[low : low + step]
                far = np.zeros((len(i), len(there)), np.int64)
                for k in range(w // 8):
                    far += np.bitwise_count(x[low : low + step, k][:, None] ^ y[:, k][None, :])
                both = n[i][:, None] + n[there][None, :]
                fine = (far <= share * both + 1e-6) & (label[i][:, None] != label[there][None, :])
                fine &= np.minimum(n[i][:, None], n[there][None, :]) >= similarity * np.maximum(n[i][:, None], n[there][None, :]) - 1e-6
                a, b = np.nonzero(fine)
                a, b = i[a], there[b]
                a, b = np.minimum(a, b), np.maximum(a, b)
                keep = a < b if first is None else side[a] != side[b]
                if keep.any():
                    yield a[keep], b[keep]


def _linked(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the similarity."""
    k = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return k >= similarity * (len(a) + len(b) - k) - 1e-9


def _buckets(pdf: pd.DataFrame):
    """The pairs of blocks of a task: rows, and where the second block begins (None: a block with itself)."""
    for _, g in pdf.groupby(["h", "i", "j"], sort=False):
        if g["i"].iloc[0] == g["j"].iloc[0]:
            yield g, None
        elif g["side"].min() != g["side"].max():
            g = g.sort_values("side", kind="stable")
            yield g, int((g["side"] == 0).sum())


def _near_texts(similarity: float):
    """What sizes and sketches let link: the pairs (c, b) of a shingle where they are few to a text, else the rows (b null) that have a partner."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pdf.iloc[:0].drop(columns="sketch").assign(b=pd.array([], "Int64"))]
        for g, first in _buckets(pdf):
            some, n, pairs = np.zeros(len(g), bool), 0, []
            for a, b in _near_rows(g["n"].to_numpy(), g["l"].to_numpy(), g["sketch"].to_list(), similarity, first):
                some[a] = some[b] = True
                n += len(a)
                if n <= FEW_PAIRS * len(g):
                    pairs.append((a, b))
            if n > FEW_PAIRS * len(g):
                out.append(g[some].drop(columns="sketch").assign(b=pd.array([None] * int(some.sum()), "Int64")))
            elif n:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                out.append(g.iloc[a].drop(columns="sketch").assign(b=pd.array(g["c"].to_numpy()[b], "Int64")))
        return pd.concat(out)

    return run


def _links(similarity: float):
    """Verified links of a task that connect all that its links connect."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for g, first in _buckets(pdf):
            c, l, sets = g["c"].to_numpy(), g["l"].to_numpy(), [np.sort(s) for s in g["s"]]
            up = {x: x for x in l.tolist()}

            def root(x: int, up: dict[int, int] = up) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for a, b in _near_rows(g["n"].to_numpy(), l, [sketch(s.view(np.uint64)) for s in sets], similarity, first):
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    x, y = root(int(l[i])), root(int(l[j]))
                    if x != y and _linked(sets[i], sets[j], similarity):
                        up[x] = y
                        out.append((int(c[i]), int(c[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (h, blocks, c, ...) dealt to the pairs of blocks of their shingle: (h, i, j, side, key), small shingles sharing a key."""
    tasks = max(1, rows.count() // BLOCK_TEXTS)
    mine = rows.withColumn("i0", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("i0")).alias("i"), F.greatest(j, F.col("i0")).alias("j"), (j < F.col("i0")).cast("int").alias("side"))))
    key = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("h"), F.lit(tasks))).otherwise(F.xxhash64("h", "x.i", "x.j"))
    return mine.withColumn("x", pair).withColumn("key", key).select("key", "h", "c", "n", "l", "x.i", "x.j", "x.side")


def similar_texts(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(c, component) of the texts that link with another one; c is xxhash64 of a text, component the smallest c of its group.

    Texts link at a Jaccard similarity of ``similarity`` or more of their
    sets of ``shingle``-word shingles (A-Z lower-cased, 64-bit hashes).
    Candidates come from two searches. Multi-index hashing finds fingerprints
    at most 3 bits apart. As texts at the limit differ in about ten bits, a
    prefix search finds all the rest: under one order of all shingles, two
    sets that link share one of their first ones. Every candidate is
    decided by the sets themselves; sketches only rule out.

    Where texts share a first shingle, all are compared with one of them, the
    same one wherever they meet. What is left between different groups is
    compared pair by pair in blocks of bounded size, by sketches, and only
    what these leave is met by its sets. Null texts and texts
    without words link with nothing; equal texts are one.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("c"), F.col(text_col).alias("text"))
    common, held_by = _common(texts, shingle)
    profile = _profiles(texts, common, shingle, similarity)
    nodes = saved(profile.groupBy("c").agg(*(F.first(x).alias(x) for x in profile.columns[1:])), "profiles")
    thin = nodes.select("c", "n", "sketch")
    size = f"least(n, pn) >= {similarity} * greatest(n, pn) - 1e-6"

    def verified(pairs: DataFrame) -> DataFrame:
        share = _most_apart(similarity)

        def run(batches):
            for batch in batches:
                fine = [_apart(x, y) <= share * (m + n) + 1e-6 for x, y, m, n in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

        met = pairs.join(thin.toDF("a", "na", "ka"), "a").join(thin.toDF("b", "nb", "kb"), "b").select("a", "b", "ka", "kb", "na", "nb")
        near = saved(met.mapInArrow(run, "a long, b long"), "near")
        sets = saved(_some(texts, near.selectExpr("a c").union(near.selectExpr("b c")).distinct(), shingle), "sets")
        both = near.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("k", F.size(F.array_intersect("sa", "sb")))
        return saved(both.where(F.col("k") >= similarity * (F.size("sa") + F.size("sb") - F.col("k")) - 1e-9).select("a", "b"), "similar")

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.selectExpr("greatest(a, b) a", "least(a, b) b").where("a <> b")

    # Equal fingerprints stand for one another in the search by segments.
    prints = saved(nodes.groupBy("fp").agg(F.min("c").alias("node")), "prints")
    alike = nodes.join(prints, "fp").selectExpr("c a", "node b").unionByName(links(prints))
    # A crowded shingle's texts are dealt to several groups, each with a pivot of its own.
    crowd = np.flatnonzero(held_by > BLOCK_TEXTS)
    hot = spark.createDataFrame(pd.DataFrame({"h": common[crowd].view(np.int64), "salts": -(-held_by[crowd] // BLOCK_TEXTS)}), "h long, salts long")
    entries = nodes.select("c", "n", F.explode("prefix").alias("h")).join(F.broadcast(hot), "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    meet = Window.partitionBy("h", F.pmod(F.xxhash64("c"), F.col("salts")))
    starred = entries.withColumn("pivot", F.min(F.struct(F.xxhash64("c", F.lit(1)), "c", "n")).over(meet)).withColumn("k", F.count("*").over(meet))
    shared = saved(starred.where("k > 1 or salts > 1").selectExpr("h", "c", "n", "salts", "pivot.c p", "pivot.n pn"), "shared")
    stars = shared.where("c <> p").where(size).selectExpr("c a", "p b")
    linked = verified(pairs_of(alike.unionByName(stars)).distinct())
    labels = saved(components(linked), "labels")

    rest = shared.where("c <> p or salts > 1").join(labels.toDF("c", "l"), "c", "left").select("h", "c", "n", F.coalesce("l", "c").alias("l"))
    blocks = f"cast(ceil(greatest(count(*) / {BLOCK_TEXTS}, sum(n) / {BLOCK_HASHES})) as int) blocks"
    parts = rest.groupBy("h").agg(F.expr(blocks), F.min("l").alias("low"), F.max("l").alias("high")).where("low <> high").select("h", "blocks")
    open_ = saved(rest.join(parts, "h"), "open")
    dealt = _blocks(open_).join(nodes.select("c", "sketch"), "c")
    near = "key long, h long, c long, n long, l long, i int, j int, side int, b long"
    left = saved(dealt.select("key", "h", "c", "n", "l", "i", "j", "side", "sketch").groupBy("key").applyInPandas(_near_texts(similarity), near), "left")
    linked = linked.unionByName(verified(pairs_of(left.where("b is not null").selectExpr("c a", "b")).distinct()))
    crowded = left.where("b is null").drop("b")
    if crowded.head(1):
        sets = saved(_some(texts, crowded.select("c").distinct(), shingle), "sets")
        blocks = crowded.join(sets, "c").select("h", "c", "n", "l", "i", "j", "side", "s").groupBy("h", "i", "j")
        linked = linked.unionByName(saved(blocks.applyInPandas(_links(similarity), "a long, b long"), "more"))
    return components(linked).toDF("c", "component")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, c, k, g) of the distinct (id, text) with words: how often the row comes, and its group."""
    groups = saved(similar_texts(docs, text_col, shingle, similarity), "groups")
    some = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    ids = some.groupBy(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("c")).agg(F.count("*").alias("k"))
    return saved(ids.join(groups, "c", "left").select("id", "c", "k", F.coalesce("component", "c").alias("g")), "ids")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id) of every distinct (id, text) with words and an id: the smallest id of its group of ``similar_texts``, its own if it has none."""
    rows = _grouped(docs, id_col, text_col, shingle, similarity).where("id is not null")
    low = rows.groupBy("g").agg(F.min("id").alias("component_id"))
    return rows.join(low, "g").select(F.col("id").cast("long").alias(id_col), F.col("component_id").cast("long").alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each group of similar texts.

    The row with the smallest id stays, a null id counting as the largest and
    the smaller text hash deciding a tie; of rows that are equal in id and
    text one stays, whichever. Rows are judged by id and text together, so
    one that merely shares an id with another stays. Null texts and texts
    without words belong to no group and stay.
    """
    rows = _grouped(docs, id_col, text_col, shingle, similarity)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "c")
    first = rows.groupBy("g").agg(F.min(order).alias("f"), F.sum("k").alias("rows")).where("rows > 1")
    met = saved(rows.join(first, "g").select("id", "c", "k", ((F.col("c") == F.col("f.c")) & F.col("id").eqNullSafe(F.col("f.id"))).alias("stays")), "met")
    gone, twice = met.where("not stays").select("id", "c"), met.where("stays and k > 1").select("id", "c")
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("c"))

    def without(rows: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
        return rows.alias("r").join(few(keys).alias("k"), F.col("r.id").eqNullSafe(F.col("k.id")) & (F.col("r.c") == F.col("k.c")), how)

    out = without(d, gone)
    if twice.head(1):
        one = without(out, twice, "left_semi").groupBy("id", "c").agg(F.first("row").alias("row"))
        out = without(out, twice).select("row").unionByName(one.select("row"))
    return out.select(*(F.col("row")[x].alias(x) for x in docs.columns))


ship(__name__)
