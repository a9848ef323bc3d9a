"""Packing of documents into fixed-length token sequences: first-fit
decreasing with a tournament tree, run apart in randomised groups of pieces."""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import shared_dir, ship

#: Characters of text for which one group is made; a group's tokens fit in a task's memory many times over.
GROUP_CHARS = 4_000_000
#: Encoded words that a task keeps; the cache starts anew when full, which changes no id.
CACHE_WORDS = 200_000
#: A space that white space or the end follows.
LOOSE = re.compile(r" (?:\s|\Z)")
#: The vocabulary file's only special token and its id.
END, END_ID = "<|endoftext|>", 50256


class Encoder:
    """Ids of the byte-level BPE vocabulary, equal to those of the ``tokenizers`` file (computed by tiktoken, from the same ranks).

    With ``specials``, the literal END in a text is one token, as in that
    file's default state; without, it is text like any other, as with its
    ``encode_special_tokens``.

    A space before a character that is no white space always begins a token
    of the vocabulary's pattern, so a text with no other spaces falls into
    chunks at its spaces that encode alike wherever they stand, and are
    cached.
    """

    def __init__(self, ranks_path: str | None = None, specials: bool = False):
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, list[int]] = {}
        self.specials = specials

    def encode(self, text: str) -> list[int]:
        if self.specials and END in text:
            first, *rest = text.split(END)
            out = self._plain(first)
            for part in rest:
                out += [END_ID, *self._plain(part)]
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        if LOOSE.search(text):
            return self.bpe.encode_ordinary(text)
        first, *rest = text.split(" ")
        out = self.bpe.encode_ordinary(first)
        cache, slow = self.cache, self.bpe.encode_ordinary
        for chunk in rest:
            ids = cache.get(chunk)
            if ids is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                ids = slow(" " + chunk)
                if len(chunk) < 64:
                    cache[chunk] = ids
            out += ids
        return out


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size: largest first, each into the first bin with room.

    The tree's leaves hold the room of the bins and each inner node the most
    room below it, so the first bin that fits is found from the root down.
    Ties keep their order.
    """
    order = np.argsort(-sizes, kind="stable").tolist()
    leaves = 1 << max(0, len(order) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    which, offset = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    listed = sizes.tolist()
    for i in order:
        size, at = listed[i], 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        which[i], offset[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            most = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == most:
                break
            tree[at] = most
    return which, offset


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, place): each document's ids (END_ID for a literal END in it) plus end_id, cut after every ``capacity`` ids; ids are unsigned 32-bit little-endian bytes, and place numbers the pieces."""
    shape = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary(), "place": pa.int64()}

    def run(batches):
        from pyspark import TaskContext

        encoder, place = Encoder(ranks_path, specials=True), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.encode(text.as_py() or ""), end_id], "<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, at, len(part), len(ids), part.tobytes(), place))
                    place += 1
                    held += len(part)
                    if held >= 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.values(), strict=True)], list(shape))
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.values(), strict=True)], list(shape))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, place long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (binary), sequence_id, offset.

    Every document, a null or empty text included, ends with end_id. Pieces
    are dealt by a hash of their number to groups whose number follows the
    total length of all texts, so a document however long or often repeated
    spreads over the groups; each group is packed by first-fit decreasing.
    Offsets in a sequence have no gaps; sequences other than full ones are
    left short, padding is the reader's. Repeated rows are packed as often as
    they come; null ids stay null. Other columns are ignored.
    """
    shared_dir(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    groups = max(1, -(-chars // GROUP_CHARS))
    pieces = tokenize_pieces(docs, id_col, text_col, capacity, end_id, ranks_path)

    def run(t: pa.Table) -> pa.Table:
        which, offset = first_fit_decreasing(t["length"].to_numpy(), capacity)
        seq = (t["g"].to_numpy() << 32) + which
        return t.drop_columns(["g"]).append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long")).drop("place")
    return dealt.groupBy("g").applyInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")


ship(__name__)
