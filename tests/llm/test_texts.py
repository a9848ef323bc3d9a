import base64
import gzip
import hashlib
import itertools
import random
import re
import sys
import time
import tracemalloc
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from llm_data import prose
from pyspark.sql import functions as F

from lumenspec.llm import chat, decontaminate, langid, packing, pii, secrets, toxicity

sys.path.insert(0, str(Path(__file__).parents[1]))
SF = "/root/testdata/sf0.001"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# --- toxicity


def brute_segments(s):
    """All maximal scoring subsequences by their recursive definition."""
    best = max(((sum(s[a:b]), -(b - a), -a, a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=None)
    if best is None or best[0] <= 0:
        return []
    a, b = best[3:]
    return brute_segments(s[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_segments(s[b:])]


def test_segments_match_definition():
    r = random.Random(2)
    for _ in range(300):
        s = [r.choice([-3, -2, -1, 1, 2, 4]) + r.random() / 100 for _ in range(r.randrange(14))]
        assert [x[:2] for x in toxicity.segments(np.array(s))] == brute_segments(s)
        assert all(abs(x[2] - sum(s[x[0] : x[1]])) < 1e-9 for x in toxicity.segments(np.array(s)))


def test_toxicity_held_out(spark, odd, empty):
    r = random.Random(4)
    bad = ["vilewort", "grimclod", "foulmuck"]
    rows = []
    for i in range(600):
        t = prose(r.randrange(5, 90), i)
        if i % 5 == 0:
            w = t.split()
            for _ in range(r.randrange(2, 5)):
                w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", "ing", "est"]))
            t = " ".join(w)
        rows.append((i, t, int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.where("doc_id % 3 <> 0").drop("toxic"), df.where("doc_id % 3 <> 0").select("doc_id", "toxic"))
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).collect()}
    held = [(got[i] >= 0.3, bool(y)) for i, _, y in rows if i % 3 == 0]
    assert sum(a == b for a, b in held) / len(held) >= 0.97
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= x["score"] <= 1 for x in out)
    kept = toxicity.accepted(odd, model, 0.3)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    none = toxicity.learn(empty, spark.createDataFrame([(1, None)], "doc_id long, toxic int"))
    assert toxicity.score(empty, none).count() == 0 and len({x["score"] for x in toxicity.score(odd, none).collect()}) == 1


# --- language


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    train = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    got = langid.identify(docs, langid.learn(train)).join(docs.select("doc_id", "lang"), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    assert got.where("lang is not null").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] >= 0.95
    out = {x["doc_id"]: x for x in langid.identify(odd, langid.learn(train)).collect()}
    assert {out[i]["lang_pred"] for i in (1, 2, 3)} == {"und"} and out[4]["lang_pred"] != "und" and all(0 <= x["score"] <= 1 for x in out.values())
    assert langid.learn(empty) == {} and {x["lang_pred"] for x in langid.identify(odd, {}).collect()} == {"und"}


def test_bundling_is_linear():
    s = langid.Space()
    a, b = s.grams("Ça va, été!"), s.grams("hello world")
    assert np.array_equal(s.bundle([np.concatenate([a, b])])[0], s.bundle([a])[0] + s.bundle([b])[0])
    assert len(s.grams("123 .,")) == 0 == len(s.grams(""))


# --- chat


NODES = "tree long, node long, parent long, role string, text string, score double"


def test_trees(spark):
    rows = [(1, 1, None, "user", "q <turn user>", 0.0), (1, 2, 1, "assistant", "a\\b", 1.0), (1, 3, 1, "assistant", "worse", 0.5), (1, 4, 2, "user", "</turn>\n", 0.0), (1, 5, 3, "user", None, 0.0)]
    rows += [(2, 10, 99, None, "root by a missing parent", None), (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "user", "x", 0.0), (1, 5, 3, "user", None, 0.0)]
    out = chat.read_back(chat.format_trees(spark.createDataFrame(rows, NODES), top=2)).orderBy("tree", "rank").collect()
    assert [(r["tree"], r["leaf"], r["rank"]) for r in out] == [(1, 4, 1), (1, 5, 2), (2, 10, 1)]
    assert [tuple(t) for t in out[0]["turns"]] == [("user", "q <turn user>"), ("assistant", "a\\b"), ("user", "</turn>\n")] and out[0]["learned"] == "a\\b"
    assert [tuple(t) for t in out[1]["turns"]] == [("user", "q <turn user>"), ("assistant", "worse"), ("user", "")]
    assert [tuple(t) for t in out[2]["turns"]] == [("", "root by a missing parent")]
    assert chat.format_trees(spark.createDataFrame([], NODES)).count() == 0


def test_long_chain_and_escapes(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("\\<>bgl/turn \n\U0001f600é") for _ in range(r.randrange(30))) for _ in range(200)]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    out = chat.read_back(chat.format_trees(chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).first()
    assert [t["text"] for t in out["turns"]] == texts and out["learned"] == "".join(texts[1::2])


@pytest.mark.parametrize("name", ["op3_embeddings", "op4_chat", "op5_decontaminate", "op8_linededup"])
def test_query_matches_sql(spark, name):
    from oracle import same

    from lumenspec.llm.queries import QUERIES, SQL

    same(spark, QUERIES[name], SQL[name], SF)


# --- decontamination


def test_decontamination(spark, odd, empty, monkeypatch):
    item = prose(40, 77)
    items = [(1, item), (2, "Rare pair"), (3, None), (4, "..."), (1, item)]
    docs = [(1, prose(30, 1) + " " + item.upper() + " " + prose(30, 2)), (2, "a RARE, pair of b " + prose(100, 3)), (3, " ".join(item.split()[:12])), (4, None), (5, ""), (6, item + " " + item), (6, item + " " + item), (7, "rare " + prose(5, 4) + " pair")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    win = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            win[tuple(w[k : k + 13])].add(str(i))
    want = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in win:
                    hit |= set(range(k, k + n))
                    got |= win[tuple(w[k : k + n])]
        want.append((i, len(w), len(hit), tuple(sorted(got)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 10):  # whole, and in blocks
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in decontaminate.match(d, b).collect()]
        assert sorted(got) == sorted(want)
    near = {r["doc_id"]: r["near_items"] for r in decontaminate.match(d, b, slop=6).collect()}
    assert "2" in near[7] and "2" not in near[3]
    assert decontaminate.match(odd, b).count() == odd.count() and decontaminate.match(empty, b).count() == 0
    assert decontaminate.match(d, b.where("false")).where("n_hit > 0").count() == 0


# --- personal data


def test_base_spans(spark, odd, empty):
    r = random.Random(9)
    al = ["a", "1", "23", "255", "256", ".", "@", "+", "-", " ", "(", ")", "_", "é", "\U0001f600", "4532015112830366", "+1 (555) 010-9999", "a@b.cc", "\n", "1.2.3.4"]
    texts = ["".join(r.choice(al) for _ in range(r.randrange(30))) for _ in range(1500)]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(s):
        return sum((v := int(c) * (1 + k % 2)) - 9 * (v > 9) for k, c in enumerate(reversed(s))) % 10 == 0

    def fine(k, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[k]()

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [tuple(s) for s in x["base"]] for x in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sorted((m.start(), n, m.end()) for n, k in enumerate(kinds) for m in re.finditer(kinds[k], t) if fine(k, m[0])), t
    out = pii.find_pii(odd)
    assert out.count() == odd.count() and pii.find_pii(empty).count() == 0
    hard = spark.createDataFrame([(1, "1-" * 60_000), (2, "a." * 60_000 + "@"), (3, "+1" + "(" * 60_000), (4, "a@b" + ".c" * 60_000)], "doc_id long, text string")
    assert {x["doc_id"]: len(x["base"]) for x in pii.find_pii(hard).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_bootstrapping(spark):
    seeds = [(k, f"{prose(5, k)} reach me under 10.0.0.{k} or else {prose(4, k)}") for k in range(1, 9)]
    unseen = [(50, "please reach me under 10:0:0:77 or else"), (51, "version 10:0:0:88 of it"), (None, "now reach me under 10:0:0:99 or else")]
    got = pii.find_pii(spark.createDataFrame(seeds + unseen, "doc_id long, text string")).collect()
    more = {r["doc_id"]: len(r["spans"]) - len(r["base"]) for r in got}
    assert more[50] == 1 and more[51] == 0 and more[None] == 1 and all(set(r["base"]) <= set(r["spans"]) for r in got)


def test_running_values(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEP", 4)
    r = random.Random(3)
    rows = [(k, [r.randrange(-50, 50) for _ in range(k)]) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, v array<bigint>")
    got = df.select("k", "v", pii.running(F.col("v"), 0, lambda a, b: a + b).alias("total"), pii.running(F.col("v"), -9, F.greatest).alias("most")).collect()
    for x in got:
        assert x["total"] == list(itertools.accumulate(x["v"])) and x["most"] == list(itertools.accumulate(x["v"], max, initial=-9))[1:]


def test_candidates_lie_beside_base_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "STEP", 3)
    r = random.Random(5)
    al = ["1.2.3.4", "5:6:7:8", "x@y.zz", "u [at] v.ww", "+1 555 010 9999", "555 010 9999", "4532015112830366", "4532-0151-1283-0366", " ", " say ", ".", "@", "\U0001f600"]
    texts = ["".join(r.choice(al) for _ in range(r.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = lambda m, n: (m.start(), n, m.end())
    for x in pii.occurrences(df).collect():
        base = [(b["start"], b["end"]) for b in x["base"]]
        every = [spans(m, n) for n, k in enumerate(pii.KINDS) for m in re.finditer(pii.LOOSE[k], x["text"])]
        want = sorted(c for c in every if not any(a < c[2] and c[0] < b for a, b in base))
        seen = x["seen"] or []
        assert sorted((y["start"], y["rank"], y["end"]) for y in seen if not y["seed"]) == want, x["text"]
        for y in seen:
            left = re.search(r"(\S+)\s*$", x["text"][max(0, y["start"] - pii.AROUND) : y["start"]])
            assert [p[7:] for p in y["patterns"] if p.startswith("before:")] == ([left[1].lower()] if left else [])


def test_many_matches_in_linear_time(spark):
    """Base spans, candidates and their contexts of one text: time follows their number."""
    took = []
    for n in (10_000, 40_000):
        text = "".join(f"call u{k}@ex.org or 10:0:{k % 250}:7 now; " for k in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.monotonic()
        got = pii.occurrences(df).selectExpr("size(base) n", "size(seen) k", "base[size(base) - 1].start at", "seen[size(seen) - 1].patterns p").first()
        took.append(time.monotonic() - start)
        assert (got["n"], got["k"], got["at"]) == (n, 2 * n, text.rindex("u")) and got["p"] == ["before:or", f"two before:u{n - 1}@ex.org or", "after:now;"]
    assert took[1] < 6 * took[0], took


def test_native_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (pii.find_pii(docs), chat.format_trees(chat.chain(spark.read.parquet(f"{SF}/conversations.parquet")))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# --- packing


def brute_first_fit(sizes, cap):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        b = next((k for k, v in enumerate(bins) if v + sizes[i] <= cap), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return out


def test_tournament_tree():
    r = random.Random(1)
    for n in (0, 1, 2, 3, 50, 257):
        sizes = [r.randrange(1, 101) for _ in range(n)]
        assert list(zip(*(x.tolist() for x in packing.first_fit_decreasing(np.array(sizes, np.int64), 100)), strict=True)) == brute_first_fit(sizes, 100)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal(tokenizer):
    r, e = random.Random(6), packing.Encoder()
    for _ in range(4000):
        t = "".join(r.choice(["a", "B", " ", "\n", "\t", ".", "'s", "é", "1", "²", "\u00a0", "\x1c", "\u3000", "the", "<|endoftext|>"]) for _ in range(r.randrange(14)))
        assert e.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_round_trip(spark, odd, empty, tokenizer):
    rows = packing.pack(odd).collect()
    want = sorted((i is None, i or 0, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in odd.select("doc_id", "text").collect())
    got, parts = [], defaultdict(list)
    for x in rows:
        assert x["length"] == len(x["ids"]) // 4 <= 2048
        parts[x["doc_id"]].append((x["start"], np.frombuffer(x["ids"], "<u4").tolist(), x["doc_tokens"]))
    for i, p in parts.items():
        copies = sum(s == 0 for s, *_ in p)
        whole = [t for s, t, _ in sorted(p)[:: copies]]
        got += [(i is None, i or 0, sum(whole, []))] * copies
    assert sorted(got) == want
    seqs = defaultdict(list)
    for x in rows:
        seqs[x["sequence_id"]].append((x["offset"], x["length"]))
    for s in seqs.values():
        end = 0
        for a, n in sorted(s):
            assert a == end
            end += n
        assert end <= 2048
    assert packing.pack(empty).count() == 0


def test_special_token_in_texts(spark):
    """Packed ids are those of the vocabulary file's tokenizer in its default state."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t, r, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), random.Random(8), packing.Encoder(specials=True)
    for _ in range(2000):
        x = "".join(r.choice(["a", "B", " ", "\n", ".", "'s", "é", "the", "<|endoftext|>", "<|endoftext|>", "<|endof"]) for _ in range(r.randrange(14)))
        assert e.encode(x) == t.encode(x, add_special_tokens=False).ids, repr(x)
    got = packing.pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")).first()
    assert np.frombuffer(got["ids"], "<u4").tolist() == [64, 220, 50256, 275, 1]


# --- secrets


def test_base_secrets_and_layers(spark, odd, empty):
    r = random.Random(12)
    al = ["password", "API_KEY", "apikey", "token", " ", "=", ":", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "x", ".", "-", "é", "\u017f", "\u212a", "secret"]
    kinds = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    fine = {"assign": lambda m: len(m[2]) >= 8 and m[1].isascii(), "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}
    for _ in range(3000):
        t = "".join(r.choice(al) for _ in range(r.randrange(25)))
        want = [(k, m.start(), m.end()) for k in kinds for m in re.finditer(kinds[k], t, re.ASCII) if fine[k](m)]
        assert sorted(secrets.scan(t)[0]) == sorted(want), t
    s = "password=abcdefgh1234 \u00e9"
    b64 = lambda x: base64.b64encode(x).decode()
    forms = [b64(s.encode()), b64(gzip.compress(s.encode())), b64(zlib.compress(s.encode())), "".join(f"%{c:02x}" for c in s.encode()), "".join(f"\\u{ord(c):04x}" for c in s), b64(b64(b64(s.encode()).encode()).encode()), "".join(f"%{c:02x}" for c in b64(s.encode()).encode())]
    for form in forms:
        t = f"h\u00e9 {form} end"
        base, spans = secrets.scan(t)
        assert base == [] and len(spans) == 1 and 3 <= spans[0][1] < spans[0][2] <= 3 + len(form)
    assert len(secrets.scan("blob-" + forms[0] + " end")[1]) == 1 == len(secrets.scan("my_key_" + forms[1])[1])
    url = "q=1 %70assword%3Dabcdefgh1234 z"
    assert secrets.scan(url)[1] == [("assign", 4, 29)]
    out = secrets.scan_secrets(odd)
    assert out.count() == odd.count() and secrets.scan_secrets(empty).count() == 0


def test_every_place_of_a_form_has_spans():
    s = b"password=abcdefgh1234 "
    one, two = base64.b64encode(s).decode(), base64.b64encode(gzip.compress(s)).decode()
    for a, b in ((one, one), (one, two), (two, two), (two, "".join(f"%{c:02x}" for c in s))):
        spans = secrets.scan(f"{a} and {b} end")[1]
        assert len(spans) == 2 and spans[0][2] <= len(a) and len(a) + 5 <= spans[1][1] < spans[1][2] <= len(a) + 5 + len(b), (a, b)


# --- the pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    kept, all_, texts = docs, [], lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns and out.count() <= kept.count()
        kept = out.cache()
        all_.append(texts(kept))
    toxic, lined, single, clean = all_
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in set(texts(docs)) - set(toxic)) <= 1
    # Lines: the brute-force rule over what the first stage kept.
    key, held = lambda x: low(x.strip(" \t\n\x0b\x0c\r")), defaultdict(set)
    for i, t in toxic.items():
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i
    assert lined == {i: t and "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in toxic.items()}
    # Copies: no two similar documents stay, and each that went has a similar one of a smaller id.
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in lined.items() if (w := low(t or "").split())}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert not [(a, b) for a in single for b in single if a < b and a in sets and b in sets and alike(a, b)]
    assert all(any(b != a and alike(a, b) for b in sets) for a in set(lined) - set(single))
    # Contamination: the contract's rule.
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    win = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}

    def dirty(t):
        w = words(t)
        hit = {p for n in {len(x) for x in win} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in win for p in range(k, k + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert set(clean) == {i for i, t in single.items() if not dirty(t)}
    packed = c.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}


def test_pipeline_odd_tables(spark, odd, empty):
    import corpus_pipeline as c

    for docs in (odd, empty):
        kept = docs
        for _, stage in c.STAGES:
            out = stage(spark, kept, SF)
            n = out.count()
            kept = out if out.columns == docs.columns else kept
        assert n >= kept.count()


def test_queries_have_columns(spark):
    from lumenspec.llm.queries import QUERIES

    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))
    digest = QUERIES["op10_secrets"](spark, SF).where("n_assign = 0 and n_access = 0 and n_hex = 0").select("base_sha256").distinct().collect()
    assert [r[0] for r in digest] == [hashlib.sha256(b"").hexdigest()]


def test_layers_of_any_kind_and_size():
    """Wrapped lines, several members, bytes that are no UTF-8, other compressors, and no work beyond a line in the length of a text."""
    import bz2
    import lzma
    import time

    s, b64 = b"xx password=abcdefgh1234 yy", lambda x: base64.b64encode(x).decode()
    lines = b64(prose(60, 3).encode() + s)
    wrapped = "\n".join(lines[k : k + 76] for k in range(0, len(lines), 76))
    for form in (wrapped, b64(gzip.compress(b"first ") + gzip.compress(s)), b64(bz2.compress(s)), b64(lzma.compress(s)), "%ff%70assword%3Dabcdefgh1234", b64(b"\xfe\xff " + s)):
        spans = secrets.scan(f"é {form} end")[1]
        assert [k for k, *_ in spans] == ["assign"] and 2 <= spans[0][1] < spans[0][2] <= 2 + len(form), form
    began = time.time()
    for t in ("a" * 1_000_000 + "%", "%41" * 300_000, "x%4" * 300_000, "\\u0041" * 100_000, "=%" + "b/" * 400_000):
        secrets.scan(t)
    # A bomb of 300 MB is read in pieces.
    bomb = zlib.compressobj(9)
    data = b"".join(bomb.compress(b"\0" * 1_000_000) for _ in range(300)) + bomb.compress(s) + bomb.flush()
    assert [k for k, *_ in secrets.scan(b64(data))[1]] == ["assign"]
    assert time.time() - began < 120


def test_layer_against_brute_force():
    """Secrets wrapped in random layers: every one is found, inside the span of its outermost form; plain texts gain none."""
    r = random.Random(31)
    wrap = [lambda x: base64.b64encode(x), lambda x: base64.b64encode(gzip.compress(x)), lambda x: base64.b64encode(zlib.compress(x)), lambda x: b"".join(b"%%%02x" % c for c in x), lambda x: b"".join(b"\\u%04x" % c for c in x)]
    for _ in range(150):
        t, want = "", []
        for _ in range(r.randrange(1, 4)):
            x = f"token: {r.randrange(10**9, 10**10)}".encode()
            for _ in range(r.randrange(1, 4)):
                x = r.choice(wrap)(x)
            t += prose(r.randrange(4), r.randrange(99)) + " "
            want.append((len(t), len(t) + len(x)))
            t += x.decode() + " "
        spans = secrets.scan(t)[1]
        assert len(spans) == len(want) and all(a <= s and e <= b for (_, s, e), (a, b) in zip(spans, want, strict=True)), t
    assert all(secrets.scan(prose(200, k))[1] == [] for k in range(20))


def test_long_conversation_in_linear_time(spark):
    """Time follows the turns of a path, when formatting and when reading back."""
    took = []
    for n in (20_000, 80_000):
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('<turn> é ', id, repeat(' word', 10)) text")
        start = time.monotonic()
        got = chat.read_back(chat.format_trees(chat.chain(rows))).selectExpr("size(turns) n", "size(loss) k", "sha2(learned, 256) h", "turns[1].text said").first()
        took.append(time.monotonic() - start)
        want = "".join(f"<turn> é {k}{' word' * 10}" for k in range(1, n, 2))
        assert (got["n"], got["k"], got["h"]) == (n, n // 2, hashlib.sha256(want.encode()).hexdigest()) and got["said"].startswith("<turn> é 1 word")
    assert took[1] < 6 * took[0]


@pytest.mark.parametrize("nested", ["%" + "25" * 500_000 + "3D", "\\u005c" + "u005c" * 200_000 + "u003d", "%5C" + "u00255C" * 140_000 + "u003d", "\\x5c" + "x5c" * 330_000 + "x3d"], ids=["url", "unicode", "both", "hex"])
def test_nested_escapes_in_linear_memory(nested):
    text = f"é token{nested}Zz12345678 end"
    tracemalloc.start()
    start = time.monotonic()
    base, spans = secrets.scan(text)
    took, peak = time.monotonic() - start, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ("assign", 2, len(text) - 4) in spans and not any(k == "assign" for k, _, _ in base)
    assert peak < 500e6 and took < 60  # tracing slows it down several times


def test_layers_between_are_scanned():
    """A secret that ends where a deeper escape begins stands in the layers between only, not in the last one."""
    for a, b in ((5, 7), (2, 9), (60, 90)):
        text = f"é token%{'25' * a}3Dabcdefgh%{'25' * b}41 end"
        end = text.index("abcdefgh") + 8
        assert [x for x in secrets.scan(text)[1] if x[0] == "assign"] == [("assign", 2, end), ("assign", 2, len(text) - 4)]
        deep = text.replace("%", "\\x5c" + "x5c" * 9 + "x25")
        assert ("assign", 2, deep.index("abcdefgh") + 8) in secrets.scan(deep)[1]


def test_no_layer_between_is_left_out(monkeypatch):
    """Thousands of layers in one another are all scanned, and steps taken at once find what steps one by one do."""
    text = f"é token%{'25' * 3000}3Dabcdefgh%{'25' * 4500}41 end"
    assert [x for x in secrets.scan(text)[1] if x[0] == "assign"] == [("assign", 2, text.index("abcdefgh") + 8), ("assign", 2, len(text) - 4)]
    r = random.Random(41)
    ends = ["3D", "41", "u003d", "x3d", "2a", "zz", "", "\\x41", "u000a", "%34%31"]
    plain = ["token", "=", ":", " ", "abcdefgh1", "AKIAABCDEFGHIJKL", "deadbeef" * 4, "\n", "é", "-", "_", "pi_key", base64.b64encode(b"xx token%2525253Dabcdefgh12").decode(), "\n".join(["QUJD" * 15] * 3)]
    for _ in range(300):
        t = ""
        for _ in range(r.randrange(1, 8)):
            t += r.choice(["%" + "25" * r.randrange(1, 9), "\\" + r.choice(["u005c", "x5c", "u{5C}"]) * r.randrange(1, 9), "%5Cu0025" + "5Cu0025" * r.randrange(4), ""]) + r.choice(ends) if r.random() < 0.5 else r.choice(plain)
        got = secrets.scan(t)
        with monkeypatch.context() as m:
            m.setattr(secrets, "_chains", lambda *_: None)
            assert secrets.scan(t) == got, t


def test_layers_lie_over_the_ends_of_pieces():
    """A layer in a decompressed one is found wherever it lies and however long it is."""
    r, b64 = random.Random(42), lambda x: base64.b64encode(x).decode()
    inner = b64(gzip.compress("".join(r.choice("ghijklmnop qrstuv,") for _ in range(400_000)).encode() + b" password=abcdefgh1234 "))
    for filler in ("some words, ", "no sign here\n", "wxyz"):
        text = b64(gzip.compress((filler * 90_000)[: secrets.PIECE - 5000].encode() + b" " + inner.encode() + b" end"))
        assert secrets.scan(text)[1] == [("assign", 0, len(text))], filler
    pieces = list(secrets._inflated(gzip.compress(b"some words, " * 400_000)))
    assert "".join(pieces) == "some words, " * 400_000 and max(map(len, pieces)) < 2 * secrets.PIECE


def test_settled_escapes():
    for text, want in [("%2541", "A"), ("%%34%31", "A"), ("a%25C3%25A9 b", "aé b"), ("\\u{5c}x41 \\u005cu{1F600}", "A \U0001f600"), ("%FFz%", "\udcffz%"), ("%5Cu00253D", "=")]:
        new, starts, ends = secrets._settled(text)
        assert new == want and starts[0] == 0 and ends[-1] == len(text) and list(starts[1:]) == list(ends[:-1])
    assert secrets._settled("no escape % here \\u12") is None


def test_cycle_in_a_large_table(spark):
    """A leaf that hangs on a cycle is followed no further than its tree is large."""
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, 2, "user", "leaf", 0.0), (3, 1, None, "user", "root", 0.0), (3, 2, 1, "assistant", "leaf", 0.0)]
    rows += [(2, k, k - 1 if k else None, "user", str(k), 0.0) for k in range(3000)]
    df = spark.createDataFrame(rows, NODES)
    way = chat.paths(df.select("tree", "node", "parent"))
    assert {(r["tree"], r["count"]) for r in way.groupBy("tree").count().collect()} == {(2, 3000), (3, 2)}


def test_letters_beyond_the_basic_planes(spark):
    got = langid.identify(spark.createDataFrame([(1, "\U00031350\U00031351\U00031352")], "doc_id long, text string"), {"xx": np.ones(langid.SIZE), "yy": -np.ones(langid.SIZE)}).first()
    assert got["lang_pred"] != "und"


def test_query_plans_are_native(spark):
    from lumenspec.llm.queries import QUERIES

    for name in ("op4_chat", "op7_pii", "op8_linededup"):
        assert not re.search("Python|Pandas|Arrow|ExistingRDD.*(conv_id|text)", QUERIES[name](spark, SF)._jdf.queryExecution().toString()), name


def test_equal_rows_are_packed_apart(spark, monkeypatch):
    """Many equal documents don't all land in one group."""
    monkeypatch.setattr(packing, "GROUP_CHARS", 20_000)
    docs = spark.createDataFrame([(None, "same " * 50)] * 800, "doc_id long, text string")
    groups = packing.pack(docs).selectExpr("shiftright(sequence_id, 32) g").groupBy("g").count().collect()
    assert len(groups) == 10 and max(g["count"] for g in groups) < 200


def test_stages_judge_rows_by_text(spark):
    """Null and shared ids: a row that only shares an id with a bad one stays, and of equal rows one stays."""
    import corpus_pipeline as c

    item = prose(40, 77)
    sf = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, item), (1, item), (1, prose(50, 1)), (2, prose(50, 2)), (2, prose(50, 2)), (3, prose(50, 2) + " end"), (None, prose(50, 2)), (None, prose(60, 9)), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in decontaminate.clean(docs, sf).collect()))
    assert out == sorted((i is None, i or 0, t or "") for i, t in rows if t != item)
    single = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in c.drop_copies(spark, docs, SF).collect())
    want = [(1, item), (1, prose(50, 1)), (2, prose(50, 2)), (None, prose(60, 9)), (4, None), (5, "")]
    assert single == sorted((i is None, i or 0, t or "") for i, t in want)
