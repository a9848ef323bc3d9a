"""One Parquet file from row groups that tasks have encoded.

A task writes each of its row groups as a file of its own in memory. The
driver puts their bytes one after the other and writes one footer: the first
group's, with the row groups of all and their byte offsets moved. No row is
decoded there, and no more than a few encoded groups are held.
"""

from __future__ import annotations

from io import BytesIO

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenspec.storage import saved

#: Fixed values of the format: its mark; types of the footer's compact protocol; fields of the footer, of a row group, of a column chunk and its metadata; those that hold byte offsets.
MARK = b"PAR1"
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
FILE_ROWS, FILE_GROUPS = 3, 4
GROUP_COLUMNS, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 3, 5, 7
CHUNK_OFFSET, CHUNK_META = 2, 3
CHUNK_OFFSETS, META_OFFSETS = (CHUNK_OFFSET, 4, 6), (9, 10, 11, 14)
#: Row groups that the driver fetches at a time.
FETCHED = 8


class Footer:
    """The compact protocol, read into {field: (type, value)}, lists as (type, values)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self) -> int:
        n = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    def signed(self) -> int:
        n = self.number()
        return n >> 1 ^ -(n & 1)

    def bytes(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def struct(self) -> dict:
        out, field = {}, 0
        while head := self.bytes(1)[0]:
            field = field + (head >> 4) if head >> 4 else self.signed()
            out[field] = (head & 15, self.value(head & 15))
        return out

    def list(self) -> tuple:
        head = self.bytes(1)[0]
        n, kind = head >> 4, head & 15
        n = self.number() if n == 15 else n
        return kind, [self.bytes(1)[0] if kind in (TRUE, FALSE) else self.value(kind) for _ in range(n)]

    def value(self, kind: int):
        if kind in (TRUE, FALSE):
            return kind == TRUE
        if kind == BYTE:
            return self.bytes(1)
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            return self.bytes(8)
        if kind == BINARY:
            return self.bytes(self.number())
        if kind in (LIST, SET):
            return self.list()
        if kind == STRUCT:
            return self.struct()
        raise ValueError(f"a footer with a value of type {kind}")


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _value(kind: int, v) -> bytes:
    if kind in (TRUE, FALSE):
        return b""
    if kind in (I16, I32, I64):
        return _number(v << 1 if v >= 0 else (-v << 1) - 1)
    if kind == BINARY:
        return _number(len(v)) + v
    if kind in (LIST, SET):
        inner, items = v
        head = bytes([len(items) << 4 | inner]) if len(items) < 15 else bytes([240 | inner]) + _number(len(items))
        return head + b"".join(bytes([x]) if inner in (TRUE, FALSE) else _value(inner, x) for x in items)
    if kind == STRUCT:
        return _struct(v)
    return v


def _struct(fields: dict) -> bytes:
    out, before = b"", 0
    for field, (kind, v) in sorted(fields.items()):
        kind = (TRUE if v else FALSE) if kind in (TRUE, FALSE) else kind
        step = field - before
        out += (bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _value(I16, field)) + _value(kind, v)
        before = field
    return out + b"\0"


def _moved(group: dict, shift: int, ordinal: int) -> dict:
    """A row group with its offsets moved; an offset of 0 is none."""

    def move(fields: dict, names) -> dict:
        return fields | {f: (fields[f][0], fields[f][1] + shift) for f in names if f in fields and fields[f][1]}

    kind, chunks = group[GROUP_COLUMNS][1]
    chunks = [move(c, CHUNK_OFFSETS) | {CHUNK_META: (STRUCT, move(c[CHUNK_META][1], META_OFFSETS))} for c in chunks]
    out = move(group, (GROUP_OFFSET,)) | {GROUP_COLUMNS: (LIST, (kind, chunks)), GROUP_ORDINAL: (I16, ordinal)}
    if ordinal >= 1 << 15:  # the field is optional and has no room for more
        del out[GROUP_ORDINAL]
    return out


def join(files, target: str) -> int:
    """Writes the row groups of Parquet ``files`` (bytes, of one schema, one after the other) as one file; their number of rows."""
    first, groups, rows = None, [], 0
    with open(target, "wb") as out:
        out.write(MARK)
        for data in files:
            end = len(data) - 8 - int.from_bytes(data[-8:-4], "little")
            footer = Footer(data[end:-8]).struct()
            first = first or footer
            shift = out.tell() - len(MARK)
            out.write(data[len(MARK) : end])
            for group in footer[FILE_GROUPS][1][1]:
                groups.append(_moved(group, shift, len(groups)))
                rows += group[GROUP_ROWS][1]
        if first is None:
            raise ValueError("no file to join")
        footer = _struct(first | {FILE_ROWS: (I64, rows), FILE_GROUPS: (LIST, (STRUCT, groups))})
        out.write(footer + len(footer).to_bytes(4, "little") + MARK)
    return rows


def encode(table: pa.Table, encoding: dict[str, str], level: int) -> bytes:
    """A file of one row group; plain where a column refuses its encoding."""

    def write(coded: dict[str, str]) -> bytes:
        sink = BytesIO()
        pq.write_table(table, sink, compression="zstd", compression_level=level, use_dictionary=[n for n in table.column_names if n not in coded], column_encoding=coded or None, row_group_size=max(1, len(table)))
        return sink.getvalue()

    try:
        return write(encoding)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return write({})


def write(ordered: DataFrame, file: str, schema: pa.Schema, encoding: dict[str, str], level: int, rows: int) -> int:
    """Writes a sorted table as one file with row groups of ``rows`` rows, but for the last of each partition; the number of rows."""

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]).cast(schema))
            n += batch.num_rows
            while n >= rows:
                whole = pa.concat_tables(held)
                yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": pa.array([encode(whole.slice(0, rows), encoding, level)], pa.binary())})
                held, n, seq = [whole.slice(rows)], n - rows, seq + 1
        if n:
            yield pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": pa.array([encode(pa.concat_tables(held), encoding, level)], pa.binary())})

    groups = saved(ordered.mapInArrow(run, "part long, seq long, file binary"), "groups")
    n = groups.count()
    if not n:
        return join([encode(schema.empty_table(), {}, level)], file)
    laid = groups.repartitionByRange(-(-n // FETCHED), "part", "seq").sortWithinPartitions("part", "seq")
    return join((bytes(r["file"]) for r in laid.select("file").toLocalIterator()), file)
