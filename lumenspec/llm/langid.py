"""Language identification with hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import shared_dir, ship

#: Components of a hypervector; letter vectors (code points share them by remainder); letters of an n-gram; seed of the letter vectors.
SIZE, LETTERS, GRAM, SEED = 1024, 1021, 3, 20240607
#: Characters of text, and distinct n-grams, that are bundled at a time.
CHARS, GRAMS = 400_000, 4096


class Space:
    """The random letter vectors, and n-gram vectors bound from permuted ones."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        letters = rng.integers(0, 2, (LETTERS + 1, SIZE), dtype=np.int8) * 2 - 1
        self.shifted = [np.roll(letters, GRAM - 1 - k, axis=1) for k in range(GRAM)]
        fold = np.zeros(0x110000, np.int32)
        for cp in range(0x40000):  # all planes that have letters
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                fold[cp] = 1 + ord(low[0]) % LETTERS
        self.fold = fold

    def grams(self, text: str) -> np.ndarray:
        """Codes of the n-grams of a text's letters, runs of other characters being one space; empty without letters."""
        if not text:
            return np.empty(0, np.int64)
        x = self.fold[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not x.any():
            return np.empty(0, np.int64)
        x = np.concatenate([[0], x, [0]])
        x = x[(x > 0) | np.concatenate([[True], x[:-1] > 0])].astype(np.int64)
        code = x[: len(x) - GRAM + 1].copy()
        for k in range(1, GRAM):
            code = code * 1024 + x[k : len(x) - GRAM + 1 + k]
        return code

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), SIZE), np.int8)
        for k in range(GRAM):
            out *= self.shifted[k][(codes >> (10 * (GRAM - 1 - k))) & 1023]
        return out.astype(np.float32)

    def bundle(self, texts: list[np.ndarray]) -> np.ndarray:
        """The sum of the n-gram vectors of each list of codes."""
        out = np.zeros((len(texts), SIZE), np.float64)
        codes, at = np.unique(np.concatenate(texts), return_inverse=True) if texts else (np.empty(0, np.int64), np.empty(0, np.int64))
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for low in range(0, len(codes), GRAMS):
            part = (at >= low) & (at < low + GRAMS)
            width = min(GRAMS, len(codes) - low)
            count = np.bincount(row[part] * width + at[part] - low, minlength=len(texts) * width).reshape(len(texts), width)
            out += count.astype(np.float32) @ self.vectors(codes[low : low + width])
        return out


def _chunks(batches, space: Space):
    """(rows of a batch, their texts' codes) of about CHARS characters each."""
    for batch in batches:
        at, codes, held = 0, [], 0
        texts = batch.column(0)
        for k in range(len(texts)):
            codes.append(space.grams(texts[k].as_py() or ""))
            held += len(codes[-1])
            if held >= CHARS:
                yield batch.slice(at, k + 1 - at), codes
                at, codes, held = k + 1, [], 0
        if codes:
            yield batch.slice(at), codes


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language prototypes: the bundle of all n-grams of each language's texts. Rows without a language are ignored.

    A null or empty text, or one without letters, adds nothing; a language of which no text has a letter has the zero
    prototype, which no document gets. Repeated rows count as often as they come. An empty table has no prototypes.
    The sums, SIZE numbers a language, are what the driver gets.
    """

    def run(batches):
        space, total = Space(), {}
        for batch, codes in _chunks(batches, space):
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                mine = [c for c, x in zip(codes, langs, strict=True) if x == lang]
                total[lang] = total.get(lang, 0) + space.bundle([np.concatenate(mine)])[0]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    shared_dir(docs.sparkSession)
    parts = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()  # SIZE rows a language
    out: dict[str, np.ndarray] = {}
    for lang, pos, v in sums:
        out.setdefault(lang, np.zeros(SIZE))[pos] = v
    return {k: out[k] for k in sorted(out)}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, lang_pred, score.

    lang_pred is the prototype with the largest cosine, the first by name on a
    tie, and score that cosine, at least 0; a text that is null or has no
    letter, or any text if there is no prototype, is ``und`` with score 0.
    What all languages share is taken from both sides before comparing. Rows
    are handled where they lie; other columns are ignored.
    """
    shared_dir(docs.sparkSession)
    names = [k for k, v in prototypes.items() if np.linalg.norm(v) > 0]
    unit = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, SIZE))
    shared = unit.mean(0) if len(names) > 1 else np.zeros(SIZE)
    profile = unit - shared
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)

    def run(batches):
        space = Space()
        for batch, codes in _chunks(batches, space):
            h = space.bundle(codes)
            norm = np.linalg.norm(h, axis=1, keepdims=True)
            h = h / np.maximum(norm, 1e-12) - shared
            cos = (h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)) @ profile.T
            some = np.array([len(c) > 0 for c in codes]) & bool(names)
            best = cos.argmax(1) if names else np.zeros(len(codes), int)
            lang = [names[b] if s else "und" for b, s in zip(best, some, strict=True)]
            value = np.where(some, np.clip(cos[np.arange(len(codes)), best], 0, 1), 0.0) if names else np.zeros(len(codes))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lang, pa.string()), pa.array(value, pa.float64())], ["i", "lang_pred", "score"])

    return docs.select(F.col(text_col), F.col(id_col).cast("long")).mapInArrow(run, "i long, lang_pred string, score double").withColumnRenamed("i", id_col)


ship(__name__)
