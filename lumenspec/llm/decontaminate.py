"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` inverts shards of documents: each row is the posting list of
one term in one shard. ``match`` joins every test window to the postings of
its rarest term, intersects the offset-adjusted list of the next rarest, and
intersects the lists of all other terms where something is left.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import few, saved, shared_dir, ship

#: Words are runs of letters, digits and all beyond ASCII; no UTF-8 byte of a wider character is below 0x80.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Distinct test words that are sent to the tasks, so that others aren't indexed; for a benchmark of more, every word is.
BLOCK_WORDS = 200_000
#: A shard ends with this many documents or words; GAP free positions keep its documents apart.
SHARD_DOCS, SHARD_WORDS, GAP = 256, 1_000_000, 4096
#: Words whose hashes a task keeps; the cache starts anew when full.
CACHE_WORDS = 100_000
#: Up to so many starts are looked up one by one in a posting list.
FEW_STARTS = 16
INDEX = "shard long, term long, n int, at array<int>, ids array<long>, n_words array<int>, bases array<int>"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


def term(word: bytes) -> int:
    """The 64 bits that stand for a word; never 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(word) or 1).view(np.int64))


class _Terms(dict):
    """Terms by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        t = self[word] = term(word)
        return t


def vocabulary(benchmark: DataFrame, text_col: str) -> dict[bytes, int] | None:
    """The terms of all test words, if there are BLOCK_WORDS at most."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array({w for t in batch.column(0) for w in words(t.as_py())}, pa.binary())], ["w"])

    held = benchmark.select(text_col).mapInArrow(run, "w binary").distinct().limit(BLOCK_WORDS + 1).toArrow()["w"].to_pylist()
    return {w: term(w) for w in held} if len(held) <= BLOCK_WORDS else None


def windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """(g, items) every distinct window of ``size`` terms, or the whole item if it's shorter, with the ids of its items as sorted strings."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = [term(w) for w in words(text.as_py())]
                g = list({tuple(t[at : at + size]) for at in range(max(1, len(t) - size + 1))}) if t else []
                if g:
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.list_(pa.int64())), pa.array([item] * len(g), pa.string())], ["g", "item"])

    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("string"), F.col(text_col))
    return rows.mapInArrow(run, "g array<long>, item string").groupBy("g").agg(F.array_sort(F.collect_set("item")).alias("items"))


def build_index(docs: DataFrame, known: dict[bytes, int] | None, id_col: str, text_col: str) -> DataFrame:
    """The inverted file: a row (shard, term, n, at) for each term of a shard, at being its n positions in order, and
    a row (shard, ids, n_words, bases) without term for the shard's documents, whose positions begin at bases. Only known words are indexed, or all if there are none given."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def shard(number: int, ids: list, terms: list[np.ndarray]):
        n = np.fromiter(map(len, terms), np.int64, len(terms))
        bases = GAP + np.concatenate([[0], np.cumsum(n + GAP)[:-1]])
        t = np.concatenate(terms)
        at = np.arange(len(t)) + np.repeat(bases - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        at, t = at[t != 0], t[t != 0]
        order = np.argsort(t, kind="stable")
        held, first, count = np.unique(t[order], return_index=True, return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(t)), pa.int32()), pa.array(at[order], pa.int32()))
        none, ints, longs = len(held), pa.list_(pa.int32()), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, ints), pa.array([ids], longs), pa.array([n], ints), pa.array([bases], ints)], NAMES)
        if none:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(none, number)), pa.array(held, pa.int64()), pa.array(count, pa.int32()), lists, pa.nulls(none, longs), pa.nulls(none, ints), pa.nulls(none, ints)], NAMES)

    def run(batches):
        from pyspark import TaskContext

        terms_of, number = _Terms(), TaskContext.get().partitionId() << 32
        look = (lambda w: map(terms_of.__getitem__, w)) if sent.value is None else (lambda w: map(sent.value.get, w, repeat(0)))
        ids, terms, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py())
                ids.append(i)
                terms.append(np.fromiter(look(w), np.int64, len(w)))
                held += len(w)
                if len(ids) >= SHARD_DOCS or held >= SHARD_WORDS:
                    yield from shard(number, ids, terms)
                    ids, terms, held, number = [], [], 0, number + 1
        if ids:
            yield from shard(number, ids, terms)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, INDEX)


NAMES = [x.split()[0] for x in INDEX.split(", ")]


def _met(starts: Column, at: Column, shift: Column, slop: int) -> Column:
    """The starts that have a position of the list ``shift`` words on (or at most ``slop`` words from there)."""
    if slop:
        return F.filter(starts, lambda s: F.exists(at, lambda p: F.abs(p - s - shift) <= slop))
    one_by_one = F.filter(starts, lambda s: F.array_contains(at, s + shift))
    return F.when(F.size(starts) <= FEW_STARTS, one_by_one).otherwise(F.array_intersect(starts, F.transform(at, lambda p: p - shift)))


def _matches(lists: DataFrame, ranked: DataFrame, slop: int) -> DataFrame:
    """(shard, size, items, starts) of every window (k, size, items, terms: array of (n, j, term), rarest first) that a shard holds; starts are the rarest term's positions."""
    first = F.element_at("terms", 1)
    heads = ranked.select("k", "size", first["term"].alias("term"), first["j"].alias("j0"), F.get("terms", F.lit(1)).alias("next"))
    found = lists.join(heads, "term").select("shard", "k", "size", "j0", "next", F.col("at").alias("starts"))
    second = lists.select("shard", F.col("term").alias("t1"), F.col("at").alias("p"))
    pairs = found.where("size > 1").withColumn("t1", F.col("next.term")).join(second, ["shard", "t1"])
    pairs = pairs.select("shard", "k", "size", "j0", _met(F.col("starts"), F.col("p"), F.col("next.j") - F.col("j0"), slop).alias("starts")).where("size(starts) > 0")
    pairs = saved(pairs, "pairs").join(ranked.select("k", "items", F.expr("slice(terms, 3, greatest(size - 2, 0))").alias("rest")), "k")
    rest = pairs.where("size > 2").select("shard", "k", "size", "j0", "items", "starts", F.explode("rest").alias("x")).withColumn("t", F.col("x.term"))
    part = rest.join(lists.select("shard", F.col("term").alias("t"), F.col("at").alias("p")), ["shard", "t"])
    part = part.select("shard", "k", "size", "items", F.explode(_met(F.col("starts"), F.col("p"), F.col("x.j") - F.col("j0"), slop)).alias("s"), "j0")
    whole = part.groupBy("shard", "k", "s").agg(F.count("*").alias("c"), F.first("size").alias("size"), F.first("items").alias("items"), F.first("j0").alias("j0")).where("c = size - 2")
    long_ = whole.groupBy("shard", "k").agg(F.first("size").alias("size"), F.first("items").alias("items"), F.first("j0").alias("j0"), F.collect_list("s").alias("starts"))
    one = found.where("size = 1").join(ranked.select("k", "items"), "k")
    cols = ["shard", "size", "items", "j0", "starts"]
    return long_.select(cols).unionByName(pairs.where("size = 2").select(cols)).unionByName(one.select(cols))


def _documents(batches):
    """A row for each document of a shard from the matches there."""
    for batch in batches:
        for ids, n_words, bases, exact, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, base = np.array(n_words, np.int64), np.array(bases, np.int64)
            spans, items, close = [[] for _ in n], [set() for _ in n], [set() for _ in n]
            for m in exact or ():
                starts = np.array(m["starts"], np.int64) - m["j0"]
                doc = np.searchsorted(base, starts, "right") - 1
                for d in np.unique(doc).tolist():
                    spans[d].append(np.stack([starts[doc == d] - base[d], starts[doc == d] - base[d] + m["size"]], axis=1))
                    items[d].update(m["items"])
            for m in near or ():
                for d in np.unique(np.searchsorted(base, np.array(m["starts"]), "right") - 1).tolist():
                    close[d].update(m["items"])
            hit = [_covered(np.concatenate(s), k) if s else 0 for s, k in zip(spans, n.tolist(), strict=True)]
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), pa.array(hit, pa.int64()), pa.array(map(sorted, items), text), pa.array(map(sorted, close), text)], ["row_id", "n_words", "n_hit", "items", "near_items"])


def _covered(spans: np.ndarray, n: int) -> int:
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, spans[:, 0], 1)
    np.add.at(mark, spans[:, 1], -1)
    return int((np.cumsum(mark) > 0).sum())


def match(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, ratio: int = 20, slop: int = 0) -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items (long), items (array of item ids as strings, sorted),
    near_items (items with a proximity match, if slop > 0), contaminated (n_hit > 0 and ratio * n_hit >= n_words).

    A null or empty text has no words and no hit. Items without words, and
    null items, match nothing. Item ids that repeat are one item. Repeated
    document rows, and rows with a null id, each get a row. Other columns are
    ignored. Words are told apart by 64 hash bits.

    A proximity match has every term of a window at most ``slop`` words from
    its place beside the rarest one. The corpus is read once, whatever the
    benchmark's size; texts are not shuffled, only posting lists are.
    """
    if not 0 <= slop < GAP - window:
        raise ValueError(f"slop must be below {GAP - window}")
    shared_dir(docs.sparkSession)
    wins = saved(windows(benchmark, item_col, item_text, window).withColumn("k", F.monotonically_increasing_id()), "windows")
    index = saved(build_index(docs, vocabulary(benchmark, item_text), id_col, text_col), "index")
    lists = index.where("term is not null").select("shard", "term", "at")
    counts = index.where("term is not null").groupBy("term").agg(F.sum("n").alias("n"))
    each = wins.select("k", F.posexplode("g").alias("j", "term")).join(counts, "term", "left")
    rank = each.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "j", "term"))).alias("terms"))
    # A window with a term that no document has is in none.
    ranked = saved(rank.where(F.element_at("terms", 1)["n"] > 0).join(wins.select("k", "items"), "k").withColumn("size", F.size("terms")), "ranked")
    hits = lambda s: _matches(lists, ranked, s).groupBy("shard").agg(F.collect_list(F.struct("size", "items", "j0", "starts")).alias("near" if s else "exact"))
    out = index.where("term is null").select("shard", "ids", "n_words", "bases").join(hits(0), "shard", "left")
    out = out.join(hits(slop), "shard", "left") if slop else out.withColumn("near", F.lit(None).cast("array<struct<size:int,items:array<string>,j0:int,starts:array<int>>>"))
    rows = out.select("ids", "n_words", "bases", "exact", "near").mapInArrow(_documents, "row_id long, n_words long, n_hit long, items array<string>, near_items array<string>")
    return rows.selectExpr(f"row_id `{id_col}`", "n_words", "n_hit", "cast(size(items) as long) n_items", "items", "near_items", f"n_hit > 0 and {ratio} * n_hit >= n_words contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 13, ratio: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated. A row is judged by its text alone, whatever its id, so equal texts go or stay together."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("c"))
    texts = docs.select(F.xxhash64(text_col).alias("c"), F.col(text_col).alias("text"))
    bad = saved(match(texts, benchmark, "c", "text", window=window, ratio=ratio).where("contaminated").select("c").distinct(), "contaminated")
    return keyed.join(few(bad), "c", "left_anti").select(*(F.col("row")[x].alias(x) for x in docs.columns))


ship(__name__)
