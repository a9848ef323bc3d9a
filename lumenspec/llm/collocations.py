"""Phrase collocations from a suffix tree that is cut at three words and built in parts.

The tree over all word suffixes doesn't fit into one memory. Its prefixes are
split vertically: a word that begins few suffixes is a prefix of its own, a
frequent one is extended by its next words until each prefix begins at most a
budget of suffixes. Neighbouring prefixes are put together until a group's
budget is full, every group's subtree is built by itself, and the counts of
inner nodes are read from the totals of the leaves below.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenspec.llm.common import few, saved, shared_dir, ship

#: Words in a phrase at most: the depth of the tree.
DEPTH = 3
#: Suffixes that a group's prefixes begin, at most: some 50 MB in a task.
BUDGET = 250_000
#: Groups that all suffixes are dealt to at least, so that a cluster's cores share them and no frequent word holds up a task, as long as they begin so many suffixes each.
PARTS, LEAST = 400, 10_000
#: Bytes of plain words that a task holds before it hands on their counts: about half a million words.
HELD = 3 << 20
#: Rows of a batch that a task hands on.
ROWS = 100_000
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Every end of a piece becomes a full stop, which no word holds, and every blank a space.
PLAIN = bytes.maketrans(ENDS + b"\t", b"." * len(ENDS) + b" ")
GAP = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
WORDS = [f"w{k}" for k in range(1, DEPTH + 1)]


def chunks(text: bytes):
    """The text with A-Z lower-cased and plain ends and blanks, cut between words."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + CHUNK)
        end = gap.start() if gap else len(text)
        yield text[at:end].translate(PLAIN).lower()
        at = end


class Stream:
    """Words of one language, and the counts of suffixes cut at ``depth`` words once enough are held."""

    def __init__(self, depth: int):
        self.parts, self.held, self.depth = [], 0, depth

    def add(self, text: bytes) -> None:
        for part in chunks(text):
            self.parts.append(part.replace(b".", b" . "))
            self.held += len(self.parts[-1])
            if self.held >= HELD:
                yield self.flush(last=False)
        self.parts.append(b".")
        self.held += 1

    def flush(self, last: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words, numbers of distinct suffixes, their counts); word 0 is none, as after the end of a piece.

        Suffixes of the last words wait for what follows, but for the ``last`` time.
        """
        more = self.depth - 1
        plain = b" ".join(self.parts)
        coded = pc.ascii_split_whitespace(pa.array([plain], pa.string())).flatten().dictionary_encode()
        words = pa.concat_arrays([pa.array([""]), coded.dictionary])
        ids, size = coded.indices.to_numpy() + np.int64(1), len(words)
        for mark in (".", ""):
            at = pc.index(coded.dictionary, mark).as_py() + 1
            ids = ids if not at else np.where(ids == at, 0, ids) if mark else ids[ids != at]
        ids = np.concatenate([ids, np.zeros(more if last else 0, np.int64)])
        code, here = ids[: len(ids) - more], ids[: len(ids) - more]
        for k in range(1, self.depth):
            here = np.where(here == 0, 0, ids[k : len(ids) - more + k])
            code = code * size + here
        found, n = np.unique(code[ids[: len(code)] > 0], return_counts=True)
        rest = words.take(pa.array(ids[len(ids) - more :])).to_pylist()
        self.parts, self.held = [(w or ".").encode() for w in rest], 0
        return words, np.stack([found // size ** (more - k) % size for k in range(self.depth)], axis=1), n


def suffixes(batches, depth: int = DEPTH):
    """(lang, words, suffixes, counts) of the batches' texts, many texts at a time."""
    streams: dict[str, Stream] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            lang = "und" if lang is None else lang
            stream = streams.get(lang) or streams.setdefault(lang, Stream(depth))
            for done in stream.add(text.as_buffer().to_pybytes() if text.is_valid else b""):
                yield (lang, *done)
        while sum(s.held for s in streams.values()) > 2 * HELD:  # many languages with few words each
            lang = max(streams, key=lambda x: streams[x].held)
            yield (lang, *streams.pop(lang).flush(last=True))
        pa.default_memory_pool().release_unused()  # workers live on between tasks
    for lang, stream in streams.items():
        yield (lang, *stream.flush(last=True))


def prefixes(texts: DataFrame, depth: int, hot: set[tuple] | None = None) -> DataFrame:
    """(lang, w1..., n): how many suffixes begin with each prefix of ``depth`` words (shorter at the end of a piece, the missing words empty), given that its first words are ``hot``."""

    keys = ["lang", *WORDS[:depth]]

    def run(batches):
        for lang, words, found, n in suffixes(batches, depth):
            if hot is not None:
                size, mine = len(words), [h[1:] for h in hot if h[0] == lang]
                known = [pc.index_in(pa.array([h[k] for h in mine], pa.string()), words).to_pylist() for k in range(depth - 1)]
                code = [sum(i * size**k for k, i in enumerate(h)) for h in zip(*known, strict=True) if None not in h]
                keep = np.isin(sum(found[:, k] * size**k for k in range(depth - 1)), code)
                found, n = found[keep], n[keep]
            for at in range(0, len(n), ROWS):
                part = n[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), *(words.take(pa.array(c)) for c in found[at : at + ROWS].T), pa.array(part)], [*keys, "n"])

    counted = texts.mapInArrow(run, "lang string, " + ", ".join(f"{w} string" for w in WORDS[:depth]) + ", n long")
    return saved(counted.groupBy(*keys).agg(F.sum("n").alias("n")), f"prefixes{depth}")


def _starts(budget: int):
    def run(batches):
        held = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True)
            first = []
            for *key, n in rows:
                if held is None or held + n > budget:
                    first.append(key)
                    held = 0
                held += n
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in first], pa.string()) for i in range(DEPTH + 1)], ["lang", *WORDS])

    return run


def group_starts(prefixes: DataFrame, budget: int) -> list[tuple]:
    """The first prefix of each group, in order: sorted prefixes are put together while they begin at most ``budget`` suffixes."""
    key = ["lang", *WORDS]
    laid = prefixes.select(*key, "n").repartitionByRange(*key).sortWithinPartitions(*key)
    return sorted(tuple(r) for r in laid.mapInArrow(_starts(budget), "lang string, " + ", ".join(f"{w} string" for w in WORDS)).collect())


def groups_of(lang: str, words: pa.Array, found: np.ndarray, starts: list[tuple]) -> np.ndarray:
    """The group of each suffix: looked up once for a word, and for the whole suffix only where a group starts inside the word's."""
    first, last = bisect_left(starts, (lang,)), bisect_left(starts, (lang + "\x00",))
    heads = [s[1].encode() for s in starts[first:last]]
    group, split = np.full(len(words), -1, np.int64), np.zeros(len(words), bool)
    used = np.unique(found[:, 0])
    for i, w in zip(used.tolist(), words.take(pa.array(used)).cast(pa.binary()).to_pylist(), strict=True):
        low, high = bisect_left(heads, w), bisect_right(heads, w)
        group[i] = first + high - 1
        split[i] = high - low > 1 or (high > low and starts[first + low][2] != "")
    out = group[found[:, 0]]
    inside = np.flatnonzero(split[found[:, 0]])
    suffixes = zip(*(words.take(pa.array(c)).to_pylist() for c in found[inside].T), strict=True)
    out[inside] = [bisect_right(starts, (lang, *s)) - 1 for s in suffixes]
    return out


def _subtree(min_count: int, hot1: dict, hot2: dict):
    """The nodes of two and three words of one group's subtree: leaves first, then each level from the totals of the one below.

    ``hot1`` and ``hot2`` have the whole counts of those nodes whose subtrees are spread over groups.
    """

    def of_lang(lang: str, t: pa.Table) -> pa.Table:
        leaves = pc.split_pattern(t["suffixes"], "\n").combine_chunks().flatten().dictionary_encode()
        a = np.bincount(leaves.indices, t["counts"].combine_chunks().flatten(), len(leaves.dictionary)).astype(np.int64)  # exact up to 2**53
        coded = pc.split_pattern(leaves.dictionary, " ").flatten().dictionary_encode()
        words, size = coded.dictionary, len(coded.dictionary)
        del leaves
        w1, w2, w3 = coded.indices.to_numpy().astype(np.int64).reshape(-1, DEPTH).T
        at = lambda w: pc.index(words, w).as_py()
        f1 = np.bincount(w1, a, size).astype(np.int64)
        pairs, pair = np.unique(w1 * size + w2, return_inverse=True)
        f2 = np.bincount(pair, a, len(pairs)).astype(np.int64)
        mine, held = [k for k in hot1 if k[0] == lang], [k for k in hot2 if k[0] == lang]
        ids = dict(zip(names := sorted({w for k in (*mine, *held) for w in k[1:]}), pc.index_in(pa.array(names, pa.string()), words).to_pylist(), strict=True))
        for key in mine:
            if ids[key[1]] is not None:
                f1[ids[key[1]]] = hot1[key]
        for key in held:
            if None not in (i := [ids[w] for w in key[1:]]):
                code = i[0] * size + i[1]
                k = int(np.searchsorted(pairs, code))
                if k < len(pairs) and pairs[k] == code:
                    f2[k] = hot2[key]
        none = at("")
        two = np.flatnonzero((f2 >= min_count) & (pairs % size != none))
        three = np.flatnonzero((a >= min_count) & (w3 != none))
        first, second = np.append(pairs[two] // size, w1[three]), np.append(pairs[two] % size, w2[three])
        third = pa.concat_arrays([pa.array([""] * len(two), pa.string()), words.take(pa.array(w3[three]))])
        columns = [pa.repeat(lang, len(first)), words.take(pa.array(first)), words.take(pa.array(second)), third, *map(pa.array, (np.append(f2[two], a[three]), f1[first], np.append(f2[two], f2[pair[three]])))]
        return pa.table(columns, ["lang", *WORDS, "a", "f1", "f2"])

    def run(t: pa.Table) -> pa.Table:
        out = pa.concat_tables([of_lang(lang, t.filter(pc.equal(t["lang"], lang))) for lang in pc.unique(t["lang"]).to_pylist()])
        pa.default_memory_pool().release_unused()
        return out

    return run


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, int]:
    """(words, nodes, budget): (lang, w1, n) of all words, (lang, w1, w2, w3, a, f1, f2) of the phrases of two and three words found ``min_count`` times: their count and those of their first word and first two; w3 is empty for two; and the budget that was kept to."""
    shared_dir(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = prefixes(texts, 1)
    total = words.agg(F.sum("n")).first()[0] or 0
    empty, budget = F.lit(""), min(budget, max(LEAST, total // PARTS))
    tops = [{(r["lang"], r["w1"]): r["n"] for r in words.where(F.col("n") > budget).collect()}]
    whole = words.where(F.col("n") <= budget).select("lang", "w1", empty.alias("w2"), empty.alias("w3"), "n")
    if tops[0]:
        pairs = prefixes(texts, 2, set(tops[0]))
        tops.append({(r["lang"], r["w1"], r["w2"]): r["n"] for r in pairs.where((F.col("n") > budget) & (F.col("w2") != "")).collect()})
        whole = whole.unionByName(pairs.where((F.col("n") <= budget) | (F.col("w2") == "")).select("lang", "w1", "w2", empty.alias("w3"), "n"))
        if tops[1]:
            whole = whole.unionByName(prefixes(texts, 3, set(tops[1])))
    starts = group_starts(whole, budget)
    hot = [*tops, {}][:2]

    def run(batches):
        for lang, names, found, n in suffixes(batches):
            group = groups_of(lang, names, found, starts)
            order = np.argsort(group, kind="stable")
            group, found, n = group[order], found[order], n[order]
            # A row for the suffixes of a group, cut at ROWS of them: neither words nor blanks hold a line end.
            starts_at = np.flatnonzero(np.append(True, group[1:] != group[:-1]) | (np.arange(len(group)) % ROWS == 0))
            for at in range(0, len(n), ROWS):
                mine = starts_at[(starts_at >= at) & (starts_at < at + ROWS)]
                ends = pa.array(np.append(mine, min(at + ROWS, len(n))) - at, pa.int32())
                part = slice(at, at + ROWS)
                suffix = pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in found[part].T), " ")
                lists = [pa.ListArray.from_arrays(ends, x) for x in (suffix, pa.array(n[part]))]
                yield pa.RecordBatch.from_arrays([pa.array(group[mine]), pa.repeat(lang, len(mine)), pc.binary_join(lists[0], "\n"), lists[1]], ["g", "lang", "suffixes", "counts"])

    shape = "lang string, w1 string, w2 string, w3 string"
    leaves = texts.mapInArrow(run, "g long, lang string, suffixes string, counts array<long>")
    nodes = leaves.groupBy("g").applyInArrow(_subtree(min_count, *hot), f"{shape}, a long, f1 long, f2 long").distinct()
    return words, saved(nodes, "nodes"), budget


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, share: int = 50, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line
    ends, and those into words at spaces and tabs. A phrase has two or three
    words of one piece and is found a >= ``min_count`` times. Cut in two, its
    parts are found l and r times; its score is floor(1000000 a a / (l r)) at
    the cut where that is least (the first such). A phrase goes if a longer
    one around it is found ``share`` percent as often or more. Ranks are by
    score, then a, both descending, then the phrase's bytes.

    A null language is ``und``; null, empty and blank texts have no words;
    rows that repeat count as often as they come; other columns are ignored.
    An empty table gives an empty table. Exact while counts are below 10**14.

    Texts are read twice, and once more for each further word by which
    frequent words are extended. Suffixes are counted in the tasks before
    they are shuffled. The driver and every task hold the first prefix of
    each group and the prefixes above the budget: no more than one for each
    ``budget`` words (PARTS at least), three times over, and one for each
    partition. So ``budget`` should be raised with the tasks' memory.
    """
    words, nodes, budget = phrases(docs, text_col, lang_col, min_count, budget)
    totals = few(words.groupBy("lang").agg(F.sum("n").alias("n")))
    two, three = nodes.where("w3 = ''"), nodes.where("w3 <> ''")
    inside = three.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a").groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    best = two.join(inside, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {share} * a").select("lang", "w1", "w2", "w3", "a", "f1", "f2", F.col("a").alias("tail"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("tail"))
    # A pair or word of more than ``budget`` places may end many phrases: those few counts are broadcast, the others meet by shuffle.
    both = best.unionByName(_met(three, tail, ["lang", "w2", "w3"], "tail", budget))
    ends = both.withColumn("end", F.when(F.col("w3") == "", F.col("w2")).otherwise(F.col("w3")))
    whole = _met(ends, words.select("lang", F.col("w1").alias("end"), F.col("n").alias("fe")), ["lang", "end"], "fe", budget)

    def score(left: str, right: str) -> F.Column:
        return F.expr(f"cast(1000000 * cast(a as decimal(14,0)) * a div (cast({left} as decimal(19,0)) * {right}) as long)")

    pair = F.col("w3") == ""
    first = F.when(pair, score("f1", "fe")).otherwise(score("f1", "tail"))
    later = F.when(~pair, score("f2", "fe"))
    at_two = F.coalesce(later < first, F.lit(False))
    rated = whole.select(
        "lang", F.when(pair, F.concat_ws(" ", "w1", "w2")).otherwise(F.concat_ws(" ", *WORDS)).alias("phrase"), "a",
        F.when(at_two, F.col("f2")).otherwise(F.col("f1")).alias("l"), F.when(pair | at_two, F.col("fe")).otherwise(F.col("tail")).alias("r"), F.when(at_two, later).otherwise(first).alias("score"),
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rated.withColumn("rank", place).where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _met(left: DataFrame, counts: DataFrame, on: list[str], count: str, budget: int) -> DataFrame:
    """``left`` with the counts of its keys; keys of more than ``budget`` are so few that they are broadcast."""
    hot = F.broadcast(counts.where(F.col(count) > budget).withColumnRenamed(count, "hot_count"))
    met = left.join(hot, on, "left")
    rest = met.where("hot_count is null").drop("hot_count").join(counts.where(F.col(count) <= budget), on)
    return rest.unionByName(met.where("hot_count is not null").withColumnRenamed("hot_count", count))


ship(__name__)
