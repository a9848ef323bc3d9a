import hashlib
import random
import re
import time
from collections import defaultdict

import numpy as np
import xxhash
from llm_data import prose

from lumenspec.llm import common, embeddings, linededup, simhash


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_print(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + n]).encode(), 42) for k in range(max(1, len(w) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(3000), r.randrange(3000)) for _ in range(1400)] + [(k, k + 1) for k in range(10_000, 10_400)] + [(5, None), (9, 9)]
    u = Union()
    for a, b in edges:
        if b is not None and a != b:
            u.join(a, b)
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: u.find(x) for x in u.up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_and_groups(spark, odd, empty):
    base = prose(300, 7).split()
    near = [(100 + k, " ".join(base[:k] + ["Changed"] + base[k + 1 :])) for k in range(0, 300, 2)]
    rows = near + [(50, "A b C d"), (51, "a B c D"), (52, None), (53, "one")]
    got = {r[0]: (r[1], r[2]) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    u = Union()
    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                u.join(i, j)
    assert {i: (f & (2**64 - 1), c) for i, (f, c) in got.items()} == {i: (prints[i], u.find(i)) for i in prints}
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["doc_id"] in (1, 2, 3)} == {1}
    assert {r["component_id"] for r in out if r["doc_id"] in (6, 7)} == {6}
    assert simhash.near_duplicates(empty).count() == 0


def test_hot_values_in_blocks(spark, monkeypatch):
    """A crowded segment value, cut into small blocks, loses no link."""
    monkeypatch.setattr(simhash, "HOT_BUCKET", 4)
    monkeypatch.setattr(simhash, "BLOCK", 8)
    r = random.Random(5)
    fps = list({0x1234567800000000 | sum(1 << r.randrange(32) for _ in range(r.randrange(8))) for _ in range(300)})
    rows = [(f, k) for k, f in enumerate(fps)]
    got = dict(map(tuple, common.components(simhash.links(spark.createDataFrame(rows, "fp long, node long"))).collect()))
    u = Union()
    for a, i in rows:
        for b, j in rows[:i]:
            if (a ^ b).bit_count() <= 3:
                u.join(i, j)
    assert got == {i: u.find(i) for i in u.up}


def jaccard(a, b, n=5):
    def s(t):
        w = low(t).split()
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}

    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_similar_groups(spark, odd, empty):
    r = random.Random(11)
    rows, i = [], 0
    for family in range(25):
        words = prose(120 + 10 * family, 1000 + family).split()
        for _ in range(6):
            copy = list(words)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(10**6)}"
            rows.append((i, " ".join(copy)))
            i += 1
    u = Union()
    for a, t in rows:
        for b, s in rows[:a]:
            if jaccard(t, s) >= 0.8:
                u.join(a, b)
    got = {x[0]: x[1] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {a: u.find(a) for a, _ in rows}
    assert sum(got[a] != want[a] for a in want) <= 0.02 * len(want)
    assert all(want[got[a]] == want[a] for a in want)  # nothing apart is joined
    out = {x[0]: x[1] for x in simhash.similar_groups(odd).collect()}
    assert out[6] == out[7] == 6 and 1 not in out and None not in out
    assert simhash.similar_groups(empty).count() == 0


def similar(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x[0]: x[1] for x in simhash.similar_groups(rows, **kw).collect()}


def test_repeated_words_link_nothing(spark):
    """Unrelated texts that repeat one word a lot stay apart."""
    r = random.Random(21)
    texts = []
    for k in range(30):
        words = [f"own{k}x{j}" for j in range(240)]
        at = r.randrange(240)
        texts.append(" ".join(words[:at] + ["ha"] * 60 + words[at:]))
    assert similar(spark, texts) == {k: k for k in range(30)}


def test_crowded_copies_link_exactly(spark, monkeypatch):
    """Many copies of one text, of which some pairs are similar and some are not: the groups are those of brute force."""
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 20_000, raising=False)
    r, base = random.Random(22), prose(300, 22).split()
    texts = []
    for k in range(200):
        copy = list(base)
        for at in r.sample(range(300), 6):
            copy[at] = f"edit{k}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(base[:150] + [f"tail{k}x{j}" for j in range(150)]) for k in range(40)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    u = Union()
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u.join(a, b)
    assert similar(spark, texts) == {k: u.find(k) for k in range(len(texts))}


def test_block_edits_are_found(spark):
    """Text added at the end, or cut from it, down to the similarity that links: every pair is found."""
    texts = []
    for k in range(150):
        words, n = prose(300, 3000 + k).split(), 62 + k % 11
        texts += [" ".join(words), " ".join(words + prose(n, 7000 + k).split() if k % 2 else words[: 300 - n])]
    got = similar(spark, texts)
    assert {k: got[2 * k + 1] == 2 * k for k in range(150)} == {k: jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8 for k in range(150)}


def test_lines(spark, odd, empty):
    line, short = "  The SAME line that many documents hold, é included ", "short line"
    rows = [(k, f"{prose(6, k)}\n{line if k % 2 else line.lower().strip()}\n{short}\n{line}") for k in range(1, 6)]
    rows += [(k, prose(12, 50) + "\nown " + prose(9, k)) for k in range(6, 10)] + [(20, None), (21, "")]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        assert (got[i]["text"] or "") == "\n".join(kept) and got[i]["n_lines"] == len((t or "").split("\n")) and got[i]["n_dropped"] == got[i]["n_lines"] - len(kept)
    assert got[20]["text"] is None and sum(r["n_dropped"] for r in got.values()) == 8
    out = linededup.dedup_lines(odd)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns) and out.agg({"n_dropped": "sum"}).first()[0] == 0
    assert linededup.dedup_lines(empty).count() == 0
    taken = linededup.dedup_lines(spark.createDataFrame([(1, "a", 9)], "doc_id long, text string, n_lines int")).first()
    assert (taken["n_lines"], taken["n_lines_"]) == (9, 1)
    twice = spark.createDataFrame([(1, line)] * 9, "doc_id long, text string")
    assert linededup.dedup_lines(twice).where("n_dropped > 0").count() == 0  # one document, however often it comes


def test_embeddings(spark):
    r = np.random.default_rng(5)
    hubs = r.standard_normal((20, 32))
    x = np.concatenate([h / np.linalg.norm(h) + 0.025 * r.standard_normal((12, 32)) for h in hubs] + [r.standard_normal((300, 32))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, x[0].tolist()), (1001, x[0].tolist()), (1002, (2 * x[1]).tolist())]
    u, n = Union(), defaultdict(int)
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for i, j in zip(*np.nonzero(m @ m.T >= 0.95), strict=True):
        if i != j:
            n[rows[i][0]] += 1
            u.join(rows[i][0], rows[j][0])
    bad = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] + [1.0] * 31), (2004, []), (2005, [1.0, 0.0]), (2006, [float("inf")] * 32)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()
    assert {(g["vec_id"], g["n_links"], g["component_id"], g["kept"]) for g in got} == {(i, n[i], u.find(i), u.find(i) == i) for i, _ in rows + bad}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_extreme_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.0001e200]), (3, [1e-200, 0.0]), (4, [2e-200, 0.0]), (5, [5.0, 0.0]), (6, [0.0, 1e-320]), (7, [1e-300, 1e200]), (8, [1.0, 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 8: (2, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (1, 6), 7: (1, 6)}


def test_lines_of_long_texts(spark):
    """Time follows the number of lines of one text, and rows that share an id but not a text lose their own lines."""
    own = lambda k, n: "\n".join(f"line {j} of {'many' if j % 2 else k} with enough characters to count" for j in range(n))
    took = []
    for n in (50_000, 200_000):
        rows = spark.createDataFrame([(k, own(k, n)) for k in range(5)], "doc_id long, text string").repartition(5)
        start = time.monotonic()
        got = {r["doc_id"]: r for r in linededup.dedup_lines(rows).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) h").collect()}
        took.append(time.monotonic() - start)
        assert [got[k]["n_dropped"] for k in range(5)] == [n // 2] * 4 + [0]
        assert got[0]["h"] == hashlib.sha256("\n".join(own(0, n).split("\n")[::2]).encode()).hexdigest()
    assert took[1] < 8 * took[0]
    line = "a line that stands in five documents, long enough"
    rows = [(1, f"{line}\nx"), (1, f"x\ny\n{line}")] + [(k, line) for k in range(2, 6)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, "x"), (1, "x\ny"), (2, ""), (3, ""), (4, ""), (5, line)]


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    r = np.random.default_rng(6)
    h = r.standard_normal(16)
    x = h / np.linalg.norm(h) + 0.035 * r.standard_normal((150, 16))
    m = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (m @ m.T >= 0.95).sum(1) - 1
    got = embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert [g["n_links"] for g in got.orderBy("vec_id").collect()] == want.tolist()


def test_digest_query(spark):
    from lumenspec.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_simhash"](spark, sf).collect():
        assert r["fingerprint"] == f"{brute_print(docs[r['doc_id']]):016x}"
    for r in QUERIES["op8_linededup"](spark, sf).where("n_dropped = 0").collect():
        assert r["kept_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()




def test_windows_reach_over_partition_borders(spark):
    """The pairs of a pass are the same however many partitions its order is cut into."""
    r = np.random.default_rng(9)
    hubs = r.standard_normal((60, 16))
    x = np.concatenate([h / np.linalg.norm(h) + 0.03 * r.standard_normal((25, 16)) for h in hubs])
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, v array<double>")
    got = []
    for parts in (1, 61):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = embeddings.candidates(nodes, 0.95, passes=1, window=5)
        got.append(dict(map(tuple, common.components(links).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got[0] == got[1] and len(got[0]) > 500


def test_fingerprint_components_of_a_table(spark):
    """The query's component_id against brute force over a whole table."""
    from lumenspec.llm.queries import QUERIES

    rows = QUERIES["op2_simhash"](spark, "/root/testdata/sf0.001").collect()
    fp = {x["doc_id"]: int(x["fingerprint"], 16) for x in rows}
    u = Union()
    for a in fp:
        for b in fp:
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                u.join(a, b)
    assert {x["doc_id"]: x["component_id"] for x in rows} == {a: u.find(a) for a in fp}


def test_edited_families_exactly(spark):
    """Two or five words changed of 200 in six families: the groups are those of brute force."""
    r, texts = random.Random(41), []
    for f in range(6):
        base = prose(200, 900 + f).split()
        for k in range(60):
            copy = list(base)
            for at in r.sample(range(200), 2 if k % 2 else 5):
                copy[at] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(copy))
    texts += ["na " * 200 + " ".join(f"o{k}x{j}" for j in range(90)) for k in range(3)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    u = Union()
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u.join(a, b)
    assert similar(spark, texts) == {k: u.find(k) for k in range(len(texts))}


def test_sketches_never_rule_out_wrongly():
    r = np.random.default_rng(3)
    for n in (5, 300, 511, 513, 2000):
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.2, 0.5):
            k = int(share * n)
            b = np.unique(np.concatenate([a[k:], r.integers(0, 2**63, k + n // 20, dtype=np.uint64)]))
            assert simhash._apart(simhash.sketch(a), simhash.sketch(b)) <= len(np.setxor1d(a, b))


def test_both_ways_of_verifying_agree(spark, monkeypatch):
    """Pairs one by one, or blocks with their sets: the same groups."""
    r, base, texts = random.Random(51), prose(260, 51).split(), []
    for k in range(60):
        copy = list(base)
        for at in r.sample(range(260), 3 + k % 3):
            copy[at] = f"z{k}x{at}"
        texts.append(" ".join(copy))
    got = []
    for most in (0, 10**6):
        monkeypatch.setattr(simhash, "FEW_PAIRS", most)
        got.append(similar(spark, texts))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    u = Union()
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                u.join(a, b)
    want = {k: u.find(k) for k in range(len(texts))}
    assert got == [want, want] and 1 < len(set(want.values())) < len(texts)
