"""Toxicity by maximum-scoring segment search over token log-odds."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import shared_dir, ship

WORD = re.compile(r"[^\W\d_]+")
#: Features are hashed into so many counters, whatever the vocabulary, so the model has a fixed size.
BUCKETS = 1 << 21
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5)
#: Dirichlet prior over the two outcomes of a feature in a text, held or not: its count in the rarer class (the other's is larger in proportion); standard errors that a log-odds must exceed; its largest absolute value; what each token costs a segment.
PRIOR, DOUBT, MOST, DRIFT = 0.5, 2.5, 8.0, 0.4
#: Labelled documents that the final calibration is fitted on, about, where there are more: those with the lowest hashes.
CALIBRATION_ROWS = 20_000
CACHE_WORDS = 200_000


def features(word: str) -> list[int]:
    raw = [word, *(f"{word[:n]}\x00{n}" for n in BEGINNINGS if len(word) >= n)]
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in raw]


class Tokens:
    """Scores of the words of a text."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.cache = weights, {}

    def of(self, text: str) -> np.ndarray:
        words, cache, out = WORD.findall(text.lower()), self.cache, []
        for w in words:
            s = cache.get(w)
            if s is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                s = cache[w] = max(self.weights[features(w)].tolist(), key=abs)
            out.append(s)
        return np.array(out, np.float64) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), left to right, in linear time."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # start, end, sum before, sum after, and the last earlier one whose sum before is lower
    for a, b in edge.reshape(-1, 2).tolist():
        new = [a, b, total[a], total[b], -1]
        j = len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= new[2]:
                j = held[j][4]
            if j < 0 or held[j][3] >= new[3]:
                break
            new = [held[j][0], b, held[j][2], total[b], -1]
            del held[j:]
            j = len(held) - 1
        new[4] = j
        held.append(new)
    return [(a, b, after - before) for a, b, before, after, _ in held]


@dataclass
class Model:
    """Token weights, the extreme-value law of a clean text's segments, and the logistic calibration."""

    weights: np.ndarray
    rate: float = 1.0
    scale: float = 1.0
    fit: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def passages(self, scores: np.ndarray, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Segments with their excess: minus the log of the number of equal ones that a clean text of this length has."""
        base = math.log(self.scale * max(len(scores), 1))
        return [(a, b, self.rate * s - base) for a, b, s in found if self.rate * s > base]

    def inputs(self, scores: np.ndarray) -> tuple[float, float]:
        excess = [x for _, _, x in self.passages(scores, segments(scores))]
        return math.log1p(max(excess, default=0.0)), math.log1p(sum(excess))

    def score(self, scores: np.ndarray) -> float:
        a, b = self.inputs(scores)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.fit[0] + self.fit[1] * a + self.fit[2] * b))))


def _count(batches):
    """Documents of each class that hold each feature, and under -1 all documents, summed over the task's rows."""
    seen, docs, cache = np.zeros((2, BUCKETS), np.int32), [0, 0], {}
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            held = set()
            docs[toxic] += 1
            for w in set(WORD.findall((text.as_py() or "").lower())):
                f = cache.get(w)
                if f is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    f = cache[w] = features(w)
                held.update(f)
            seen[toxic, np.fromiter(held, np.int64, len(held))] += 1
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (-1, docs[1], docs[0])], ["bucket", "toxic", "clean"])
    at = np.flatnonzero(seen.any(0))
    for k in range(0, len(at), 1 << 17):
        part = at[k : k + (1 << 17)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(seen[1, part], pa.int64()), pa.array(seen[0, part], pa.int64())], ["bucket", "toxic", "clean"])


def _root(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1."""
    low, high = 0.0, 20.0
    with np.errstate(over="ignore"):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (weights * np.exp(np.minimum(mid * values, 600))).sum() < weights.sum() else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from all labelled documents (label 0 or 1; others are ignored; of several labels of an id the largest holds).

    Exact copies count once. Counting covers every labelled text; only the
    calibration uses about CALIBRATION_ROWS of them where there are more. Without labels the
    model gives every text the same low score.
    """
    shared_dir(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("toxic"))
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).where("i is not null")
    chosen = d.select("i", F.xxhash64("text").alias("h")).join(known, "i").groupBy("h").agg(F.min("i").alias("i"), F.max("toxic").alias("toxic"))
    rows = d.join(chosen.select("i", "toxic"), "i").select("text", "toxic")
    counts = rows.mapInArrow(_count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).checkpoint()
    model = Model(np.zeros(BUCKETS, np.float32))
    total = counts.where("bucket = -1").first()
    if not total or not total["t"] or not total["c"]:
        return model
    nt, nc = total["t"], total["c"]
    at, ac = (PRIOR * n / min(nt, nc) for n in (nt, nc))
    odds = f"ln((t + {at}) / ({nt} - t + {at})) - ln((c + {ac}) / ({nc} - c + {ac}))"
    spread = f"{DOUBT} * sqrt(1 / (t + {at}) + 1 / (c + {ac}))"
    sure = counts.where("bucket >= 0").selectExpr("bucket", f"{odds} o", f"{spread} e").selectExpr("bucket", f"least({MOST}, greatest(-{MOST}, signum(o) * greatest(abs(o) - e, 0))) w").where("w <> 0")
    found = sure.toPandas()  # BUCKETS rows at most
    model.weights[found["bucket"].to_numpy()] = found["w"].to_numpy(np.float32)
    _calibrate(model, rows, nt + nc)
    return model


def _calibrate(model: Model, rows: DataFrame, n: int) -> None:
    spark = rows.sparkSession
    share = min(1.0, CALIBRATION_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(1 << 30)) < int(share * (1 << 30)))
    weights = spark.sparkContext.broadcast(model.weights)

    def run(batches):
        tokens = Tokens(weights.value)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = tokens.of(text.as_py() or "")
                bins, n = np.unique(np.round(s, 1), return_counts=True)
                out.append((toxic, len(s), [x for _, _, x in segments(s)], bins.tolist(), n.tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())), strict=True)], ["toxic", "n", "s", "bins", "counts"])

    got = sample.mapInArrow(run, "toxic int, n long, s array<double>, bins array<double>, counts array<long>").checkpoint()
    clean = got.where("toxic = 0")
    law = clean.select(F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("x.bins").agg(F.sum("x.counts").alias("n")).toPandas()
    if len(law):
        model.rate = _root(law["bins"].to_numpy(float), law["n"].to_numpy(float))
        floor = 1.0  # segments above it are counted to scale the law
        over, size = clean.agg(F.sum(F.size(F.filter("s", lambda x: x >= floor))), F.sum("n")).first()
        model.scale = max((over + 1) * math.exp(min(model.rate * floor, 50)) / max(size, 1), 1e-9)
    x, y = [], []
    for toxic, n, s in got.select("toxic", "n", "s").collect():
        base = math.log(model.scale * max(n, 1))
        excess = [e for e in (model.rate * v - base for v in s) if e > 0]
        x.append((math.log1p(max(excess, default=0.0)), math.log1p(sum(excess))))
        y.append(toxic)
    model.fit = tuple(_logistic(np.array(x).reshape(-1, 2), np.array(y, float)).tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, score (0 to 1), passages (array of start, end, excess; counted in words).

    Null and empty texts have no passage and get the base score. Each row is
    scored where it lies; other columns are ignored, repeated rows repeat.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))

    def run(batches):
        m = held.value
        tokens = Tokens(m.weights)
        for batch in batches:
            out, spans = [], []
            for text in batch.column(1):
                s = tokens.of(text.as_py() or "")
                out.append(m.score(s))
                spans.append([{"start": a, "end": b, "excess": float(x)} for a, b, x in m.passages(s, segments(s))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(spans, span)], ["i", "score", "passages"])

    shape = "i long, score double, passages array<struct<start:long,end:long,excess:double>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, shape).withColumnRenamed("i", id_col)


def accepted(docs: DataFrame, model: Model, below: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below a limit; nothing is shuffled.

    A null or empty text has the base score. Null ids and repeated rows are judged like any other, each by its text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        tokens = Tokens(m.weights)
        for batch in batches:
            texts = batch.column("row").field(place)
            fine = [m.score(tokens.of(t.as_py() or "")) < below for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("row")], ["row"]).filter(pa.array(fine, pa.bool_()))

    place, rows = docs.columns.index(text_col), docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select(*(F.col("row")[c].alias(c) for c in docs.columns))


ship(__name__)
