"""Personal data by base patterns and bootstrapped contextual extraction, in
DataFrame functions only.

Base matches seed the search. The words around them are lexical patterns; the
graph of patterns and identifier-like instances is scored round by round, and
instances that trusted patterns surround become spans of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspec.llm.common import blocks, cut, few, let, saved, shared_dir

KINDS = ("email", "ip", "card", "phone")
#: Base patterns with possessive loops, so that no text makes the matcher recurse or retry; what needs counting is checked after.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must occur in a text for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Looser forms of the same identifiers: candidates, which need a trusted context.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?)[A-Za-z0-9-]{1,64}){1,8}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.:-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
LOOSE_NEEDS = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9][.:-][0-9]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Rounds of scoring; distinct seeds and the share of trusted instances that a pattern needs; the score that an instance needs.
ROUNDS, SEEDS, TRUST, ACCEPT = 3, 3, 0.8, 0.9
#: Characters on each side of an instance in which its context words are looked for.
AROUND = 64
#: Values that running() goes through at a time, and a place beyond every text.
STEP, FAR = 256, 1 << 40

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("m", T.StringType())]))


def running(values: Column, start: int, combine) -> Column:
    """An array's running values under an associative ``combine``, from ``start`` on.

    Steps of STEP values are run through by themselves, then their last values, so that what a step copies stays short.
    """
    longs = F.array().cast(T.ArrayType(T.LongType()))
    first = F.array(F.lit(start).cast("long"))

    def scan(v: Column) -> Column:
        return F.aggregate(v, first, lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def steps(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda i: scan(F.slice(v, i * STEP + 1, F.lit(STEP))))

    def joined(runs: Column) -> Column:
        heads = F.slice(scan(F.transform(runs, lambda r: F.element_at(r, -1))), F.lit(1), F.size(runs))
        return F.flatten(F.zip_with(runs, heads, lambda r, h: F.transform(F.slice(r, F.lit(2), F.lit(STEP)), lambda x: combine(h, x))))

    return let(values, lambda v: F.when(F.size(v) == 0, longs).otherwise(let(steps(v), joined)))


def matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches (start, end, m) of a pattern in code points: the pieces between them tell where they lie."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        ends = running(F.zip_with(gaps, found, lambda p, m: (F.length(p) + F.length(m)).cast("long")), 0, lambda a, b: a + b)
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))

    return F.when(text.rlike(needs), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed).cast(SPAN)).otherwise(F.array().cast(SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of 1 to 19 digits holds."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _octet(p: Column) -> Column:
    bare = F.ltrim(p, F.lit("0"))
    return F.when(F.length(bare) > 3, F.lit(False)).when(bare == "", F.lit(True)).otherwise(bare.cast("int") <= 255)


def holds(kind: str, m: Column) -> Column:
    digits = F.length(_digits(m))
    return {
        "email": F.lit(True),
        "ip": F.forall(F.split(m, r"\.", -1), _octet),
        "card": F.when(digits.between(14, 19), luhn(_digits(m))).otherwise(False),
        "phone": digits.between(10, 15),
    }[kind]


def _holding(kind: str):
    return lambda x: holds(kind, x["m"])


def _ranked(spans: Column, rank: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["m"].alias("m")))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base: array of (start, rank, end, m) in order of start, then kind; rank is the kind's place in KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs
    for k in KINDS:
        out = out.withColumn(f"_{k}", matches(t, BASE[k], NEEDS[k]))
    kinds = [_ranked(F.filter(f"_{k}", _holding(k)), r) for r, k in enumerate(KINDS)]
    return out.withColumn("base", F.array_sort(F.concat(*kinds))).drop(*(f"_{k}" for k in KINDS))


def _context(parts: Column, x: Column) -> Column:
    """Lexical patterns of an instance: the word before, the two words before, the word after."""

    def named(name: str, side: Column, pattern: str) -> Column:
        word = F.regexp_extract(side, pattern, 1)
        return F.when(word != "", F.concat(F.lit(f"{name}:"), F.regexp_replace(word, r"\s+", " ")))

    left = F.lower(cut(parts, F.greatest(x["start"] - AROUND, F.lit(0)), x["start"]))
    right = F.lower(cut(parts, x["end"], x["end"] + AROUND))
    before = let(left, lambda v: F.array(named("before", v, r"(\S+)\s*$"), named("two before", v, r"(\S+\s+\S+)\s*$")))
    return F.array_compact(F.concat(before, F.array(named("after", right, r"^\s*(\S+)"))))


def _sown(spans: Column, seed: bool) -> Column:
    return F.transform(spans, lambda x: F.struct(x.alias("x"), F.lit(seed).alias("seed")))


def _seen(parts: Column, x: Column, seed: Column) -> Column:
    return F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["m"]).alias("name"), seed.alias("seed"), _context(parts, x).alias("patterns"))


def _free(base: Column, loose: Column) -> Column:
    """The spans of ``loose`` that share no place with one of ``base``.

    In the order of starts, the largest end of the base spans up to a candidate and the first start beyond it decide.
    """

    def marked(spans: Column, candidate: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(candidate).alias("candidate"), x.alias("x")))

    def kept(marks: Column) -> Column:
        latest = running(F.transform(marks, lambda y: F.when(y["candidate"], 0).otherwise(y["x"]["end"])), 0, F.greatest)
        ahead = F.transform(F.reverse(marks), lambda y: F.when(y["candidate"], FAR).otherwise(y["start"]))
        near = F.zip_with(latest, F.reverse(running(ahead, FAR, F.least)), lambda a, b: F.struct(a.alias("latest"), b.alias("next")))
        free = lambda y, n: y["candidate"] & (n["latest"] <= y["start"]) & (n["next"] >= y["x"]["end"])
        return F.array_compact(F.zip_with(marks, near, lambda y, n: F.when(free(y, n), y["x"])))

    both = let(F.array_sort(F.concat(marked(base, False), marked(loose, True))), kept)
    return F.when((F.size(base) == 0) | (F.size(loose) == 0), loose).otherwise(both)


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with base and seen: every seed and candidate as (rank, start, end, name, seed, patterns), candidates only where no base span lies."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = base_spans(docs, text)
    for k in KINDS:
        out = out.withColumn(f"_{k}", matches(t, LOOSE[k], LOOSE_NEEDS[k]))
    out = out.withColumn("_loose", F.concat(*(_ranked(F.col(f"_{k}"), r) for r, k in enumerate(KINDS)))).withColumn("_loose", _free(F.col("base"), F.col("_loose")))
    out = out.withColumn("_both", F.concat(_sown(F.col("base"), True), _sown(F.col("_loose"), False)))
    found = F.when(F.size("_both") > 0, let(blocks(t), lambda parts: F.transform("_both", lambda y: _seen(parts, y["x"], y["seed"]))))
    return out.withColumn("seen", found).drop("_loose", "_both", *(f"_{k}" for k in KINDS))


def bootstrap(seen: DataFrame) -> DataFrame:
    """(rank, name) of accepted instances, from rows (rank, name, seed, pattern), one per occurrence and pattern.

    A seed scores 1. In each round a pattern scores the mean of its distinct
    instances' scores, and is trusted with SEEDS distinct seeds and TRUST;
    every other instance scores one minus the product of its trusted
    patterns' doubts. Only sums per pattern and per instance are shuffled.
    """
    edges = saved(seen.groupBy("rank", "name", "pattern").agg(F.max("seed").alias("seed")), "edges")
    is_seed = edges.groupBy("rank", "name").agg(F.max("seed").alias("seed"))
    scores = is_seed.selectExpr("rank", "name", "seed", "cast(seed as double) score")
    for _ in range(ROUNDS):
        joined = edges.drop("seed").join(scores, ["rank", "name"])
        trusted = joined.groupBy("rank", "pattern").agg(F.avg("score").alias("p"), F.count_if("seed").alias("n")).where((F.col("n") >= SEEDS) & (F.col("p") >= TRUST)).select("rank", "pattern", "p").checkpoint()
        # Trust that other instances lend is held below certainty, so that one pattern alone never accepts.
        new = joined.where("not seed").join(few(trusted), ["rank", "pattern"]).groupBy("rank", "name").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.85)))))).alias("new"))
        scores = scores.join(new, ["rank", "name"], "left").selectExpr("rank", "name", "seed", "if(seed, 1.0D, coalesce(new, 0.0D)) score").checkpoint()
    return scores.where(f"not seed and score >= {ACCEPT}").select("rank", "name")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, base and spans as arrays of (start, rank, end), by start, then kind; code points, end exclusive.

    A null or empty text has none. spans holds all of base, and the candidates
    that bootstrapping accepts. Rows are told apart by id and a hash of the
    text, so a repeated row gets the same spans; a null id is kept. Other
    columns are ignored. Texts are not shuffled, only identifiers and their
    context words.
    """
    shared_dir(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = saved(occurrences(d).select("id", F.xxhash64("text").alias("h"), F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))).alias("base"), "seen"), "pii")
    each = rows.select("id", "h", F.explode("seen").alias("x")).select("id", "h", "x.*")
    good = few(bootstrap(each.select("rank", "name", "seed", F.explode("patterns").alias("pattern"))).checkpoint())
    more = each.where("not seed").join(good, ["rank", "name"]).groupBy("id", "h").agg(F.collect_set(F.struct("start", "rank", "end")).alias("more"))
    met = rows.drop("seen").alias("r").join(more.alias("m"), F.col("r.id").eqNullSafe(F.col("m.id")) & (F.col("r.h") == F.col("m.h")), "left")
    return met.select(F.col("r.id").alias(id_col), "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))
