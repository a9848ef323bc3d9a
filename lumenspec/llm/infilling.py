"""Fill-in-the-middle over texts that are stored as seekable compressed frames.

A text is a list of independent zstandard frames, each with the units (lines)
and code points before it. A cut after so many units is found by the frames'
counts; only the frame that holds it is decompressed. Prefix, middle and suffix
are then lists of frames, whole ones as they are and parts of cut ones
compressed anew, and the output is such a list, too. Digests stream the frames
in order, so a task never holds more than a frame of plain text beside the
compressed row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspec.llm.common import saved, shared_dir, ship
from lumenspec.llm.linededup import free_name

#: Bytes of text in a frame, but for the bytes of a code point that would be cut.
FRAME = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Frames: line ends, code points and bytes before the frame, and the frame.
FRAMES = "array<struct<ends:bigint,chars:bigint,bytes:bigint,data:binary>>"
SHAPE = pa.list_(pa.struct([("ends", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))


def code_points(data) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80)) if len(data) else 0


class Writer:
    """Builds a list of frames from bytes and from frames of other lists."""

    def __init__(self, codec: zstandard.ZstdCompressor):
        self.codec, self.frames, self.loose = codec, [], bytearray()
        self.ends = self.chars = self.bytes = 0

    def write(self, data) -> None:
        self.loose += data
        while len(self.loose) >= 2 * FRAME:
            self._cut(FRAME)

    def _cut(self, size: int) -> None:
        while size < len(self.loose) and self.loose[size] & 0xC0 == 0x80:
            size += 1
        data = bytes(self.loose[:size])
        del self.loose[:size]
        self._add(data.count(b"\n"), code_points(data), len(data), self.codec.compress(data))

    def _add(self, ends: int, chars: int, size: int, frame: bytes) -> None:
        self.frames.append({"ends": self.ends, "chars": self.chars, "bytes": self.bytes, "data": frame})
        self.ends, self.chars, self.bytes = self.ends + ends, self.chars + chars, self.bytes + size

    def add(self, ends: int, chars: int, size: int, frame: bytes) -> None:
        """A whole frame, as it is."""
        if self.loose:
            self._cut(len(self.loose))
        self._add(ends, chars, size, frame)

    def close(self) -> list[dict]:
        if self.loose:
            self._cut(len(self.loose))
        return self.frames


class Reader:
    """A text in frames: ``total`` holds its line ends, code points and bytes."""

    def __init__(self, frames: list[dict], total: tuple[int, int, int], codec: zstandard.ZstdDecompressor):
        self.frames, self.total, self.codec = frames, total, codec
        self.ends = [f["ends"] for f in frames]
        self.held: tuple[int, bytes] = (-1, b"")

    def plain(self, k: int) -> bytes:
        if self.held[0] != k:
            self.held = (k, self.codec.decompress(self.frames[k]["data"]))
        return self.held[1]

    def cut(self, units: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before) where the first ``units`` lines end."""
        if not units:
            return 0, 0, 0
        if units > self.total[0]:  # the last line has no end
            return len(self.frames), 0, self.total[1]
        k = bisect_left(self.ends, units) - 1  # the last frame with fewer line ends before it
        data = self.plain(k)
        at = int(np.flatnonzero(np.frombuffer(data, np.uint8) == 10)[units - self.ends[k] - 1])
        return k, at + 1, self.frames[k]["chars"] + code_points(data[: at + 1])

    def copy(self, a: tuple[int, int, int], b: tuple[int, int, int], to: Writer) -> None:
        """What lies between two cuts."""
        (k, x, _), (end, y, _) = a, b
        while k < end or (k == end and x < y):
            if k == end:
                to.write(self.plain(k)[x:y])
                return
            if x:
                to.write(self.plain(k)[x:])
            else:
                here = self.frames[k]
                after = self.frames[k + 1] if k + 1 < len(self.frames) else dict(zip(("ends", "chars", "bytes"), self.total, strict=True))
                size = after["bytes"] - here["bytes"]
                if 2 * size < FRAME:  # small ones are joined to their neighbours
                    to.write(self.plain(k))
                else:
                    to.add(after["ends"] - here["ends"], after["chars"] - here["chars"], size, here["data"])
            k, x = k + 1, 0


def _rows(batch: pa.RecordBatch):
    return zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced by frames, n_ends, n_chars_, n_bytes and marked (a sentinel occurs in the text); written to the shared folder.

    The new columns' names get underscores at their ends where they are taken.
    A null text is an empty one, which has no frame. Rows stay as they are
    and are not shuffled.
    """
    shared_dir(docs.sparkSession)
    plain = [f"_{k}" for k in range(len(docs.columns))]
    text = plain[docs.columns.index(text_col)]
    rest = [p for p in plain if p != text]
    schema = docs.toDF(*plain).select(*rest).schema
    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema), f"frames {FRAMES}", "n_ends bigint", "n_chars bigint", "n_bytes bigint", "marked boolean"])

    def run(batches):
        codec = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            frames, ends, chars, size, marked = [], [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                data = memoryview(value.as_buffer()) if value.is_valid else b""
                to = Writer(codec)
                for at in range(0, len(data), FRAME):
                    to.write(data[at : at + FRAME])
                frames.append(to.close())
                ends.append(to.ends)
                chars.append(to.chars)
                size.append(to.bytes)
                whole = bytes(data)
                marked.append(any(m in whole for m in MARKS))
            more = [pa.array(frames, SHAPE), *(pa.array(x, pa.int64()) for x in (ends, chars, size)), pa.array(marked, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*rest, "frames", "n_ends", "n_chars", "n_bytes", "marked"])

    out = docs.toDF(*plain).select(*rest, text).mapInArrow(run, shape)
    names = {p: c for p, c in zip(plain, docs.columns, strict=True) if p != text}
    more = [(c, free_name(docs, c)) for c in ("frames", "n_ends", "n_chars", "n_bytes", "marked")]
    return saved(out, "frames").select(*(F.col(p).alias(c) for p, c in names.items()), *(F.col(c).alias(n) for c, n in more))


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hex SHA-256 of ``seed:id``; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, n_ends, n_chars, n_bytes): each text with its middle moved to the end.

    A text of n lines is cut after two drawn numbers of lines into prefix,
    middle and suffix. Form ``psm`` is <P>prefix<S>suffix<M>middle, ``spm``
    <S>suffix<P>prefix<M>middle (``spm_rate`` percent); ``plain`` is the text
    as it is: an empty or null one, one that holds a sentinel, and, by draw,
    100 - ``rate`` percent of the others. prefix_chars and middle_chars are null for
    plain. ``output`` is a list of independent zstandard frames with the line
    ends, code points and bytes before each; joined, they are one zstandard
    stream. The last three columns are the output's totals.

    Draws depend on id and seed alone, so rows that repeat an id are cut at
    the same draws of their own lines; a null id counts as an empty one, and
    stays null. Other columns are ignored. Nothing is shuffled.
    """
    shared_dir(docs.sparkSession)
    stored = store(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    id_type = stored.schema["id"].dataType.simpleString()
    h = draws(F.col("id"), seed)
    asked = stored.select("id", "frames", "n_ends", "n_chars", "n_bytes", (F.col("marked") | (F.col("n_bytes") == 0) | (h[2] % 100 >= rate)).alias("plain"), (h[3] % 100 < spm_rate).alias("spm"), h[0].alias("h1"), h[1].alias("h2"))
    shape = f"id {id_type}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output {FRAMES}, n_ends bigint, n_chars bigint, n_bytes bigint"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), SHAPE, pa.int64(), pa.int64(), pa.int64()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "n_ends", "n_chars", "n_bytes"]

    def run(batches):
        codec, back = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for frames, *total, plain, spm, h1, h2 in _rows(batch.drop_columns(["id"])):
                text = Reader(frames, tuple(total), back)
                n = total[0] + bool(frames and text.plain(len(frames) - 1)[-1:] != b"\n")
                if plain:
                    rows.append((n, "plain", None, None, frames, *total))
                    continue
                start, end = (0, 0, 0), (len(frames), 0, total[1])
                p, q = (text.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                to = Writer(codec)
                parts = [(PREFIX, start, p), (SUFFIX, q, end), (MIDDLE, p, q)]
                for mark, a, b in [parts[1], parts[0], parts[2]] if spm else parts:
                    to.write(mark)
                    text.copy(a, b, to)
                out = to.close()
                rows.append((n, "spm" if spm else "psm", p[2], q[2] - p[2], out, to.ends, to.chars, to.bytes))
            cols = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["id", *names])

    return asked.mapInArrow(run, shape)


def stream(frames: list[dict], codec: zstandard.ZstdDecompressor):
    return (codec.decompress(f["data"]) for f in frames)


def restored(frames: list[dict], form: str, codec: zstandard.ZstdDecompressor):
    """The bytes of the text before its middle moved, from output and form alone.

    Sentinels are searched for in the stream, with the two bytes before each
    frame, as they may lie across frames. The text holds none, so each occurs
    once, in the order of the form.
    """
    if form == "plain":
        yield from stream(frames, codec)
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    places, tail, done = [], b"", 0
    for data in stream(frames, codec):
        seen = tail + data
        at = 0
        while len(places) < 3 and (found := seen.find(order[len(places)], at)) >= 0:
            places.append(done - len(tail) + found)
            at = found + 3
        done += len(data)
        tail = seen[max(at, len(seen) - 2) :]
    ends = [*places[1:], done]
    parts = {mark: (a + 3, b) for mark, a, b in zip(order, places, ends, strict=True)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        a, b = parts[mark]
        for k, f in enumerate(frames):  # only frames that hold some of the part
            low, high = f["bytes"], frames[k + 1]["bytes"] if k + 1 < len(frames) else done
            if low < b and high > a:
                yield codec.decompress(f["data"])[max(a - low, 0) : b - low]


def digests(out: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with output_sha256 and restored_sha256 in place of the frames, both streamed from the output."""
    keep = ["id", "n", "form", "prefix_chars", "middle_chars"]
    shape = f"id {out.schema['id'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            of_output, of_text = [], []
            for form, frames in zip(batch.column("form").to_pylist(), batch.column("output"), strict=True):
                frames = frames.as_py()
                for parts, to in ((stream(frames, codec), of_output), (restored(frames, form, codec), of_text)):
                    digest = hashlib.sha256()
                    for data in parts:
                        digest.update(data)
                    to.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(of_output, pa.string()), pa.array(of_text, pa.string())], [*keep, "output_sha256", "restored_sha256"])

    return out.select(*keep, "output").mapInArrow(run, shape)


def texts(out: DataFrame, original: bool = False) -> DataFrame:
    """(id, form, text) of the rows of ``fill_in_middle``: the outputs, or with ``original`` the texts restored from them."""
    shape = f"id {out.schema['id'].dataType.simpleString()}, form string, text string"

    def run(batches):
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = zip(batch.column("form").to_pylist(), batch.column("output"), strict=True)
            plain = [b"".join(restored(f.as_py(), form, codec) if original else stream(f.as_py(), codec)) for form, f in rows]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "form"]).columns, pa.array(plain, pa.binary()).cast(pa.string())], ["id", "form", "text"])

    return out.select("id", "form", "output").mapInArrow(run, shape)


ship(__name__)
