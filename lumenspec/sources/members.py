"""Parquet members of an archive, scanned where they lie.

Members are stored uncompressed, so a member is a range of the archive's
bytes. A task maps that range and reads its own row groups, no more columns
than asked for; groups whose statistics exclude a condition have no task, and
counts come from footers. Nothing is extracted.
"""

from __future__ import annotations

import os
import struct
import zipfile
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

#: Fixed values of the ZIP format: a local header's length and where the lengths of its name and extra field stand.
LOCAL, LENGTHS = 30, 26
#: Rows of a batch.
ROWS = 1 << 16


@dataclass(frozen=True)
class Member:
    """Bytes of a file; ``path`` is one that executors see."""

    path: str
    start: int
    size: int

    def open(self) -> pq.ParquetFile:
        """The member by mapped memory: only what is read is loaded."""
        with pa.memory_map(self.path) as f:
            f.seek(self.start)
            return pq.ParquetFile(pa.BufferReader(f.read_buffer(self.size)))

    def copy_to(self, target) -> None:
        """The member's bytes, a megabyte at a time."""
        left = self.size
        with open(self.path, "rb") as f:
            f.seek(self.start)
            while left:
                part = f.read(min(left, 1 << 20))
                if not part:
                    raise ValueError(f"{self.path} is cut off")
                target.write(part)
                left -= len(part)

    def rows(self) -> int:
        return self.open().metadata.num_rows

    def footer(self) -> dict[str, str]:
        return {k.decode(): v.decode("utf-8", "replace") for k, v in (self.open().metadata.metadata or {}).items()}


def whole(path: str) -> Member:
    return Member(path, 0, os.path.getsize(path))


def members(path: str) -> dict[str, Member]:
    """The Parquet members of an archive; a compressed one is an error, as it has no rows in place."""
    out = {}
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        for info in z.infolist():
            if not info.filename.endswith(".parquet"):
                continue
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{info.filename} is compressed")
            f.seek(info.header_offset + LENGTHS)
            out[info.filename] = Member(path, info.header_offset + LOCAL + sum(struct.unpack("<HH", f.read(4))), info.file_size)
    return out


def _plain(kind: pa.DataType) -> pa.DataType:
    """A type that Spark has: signed for unsigned (64 bits stay 64), small offsets, values for dictionaries."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _plain(f.type), f.nullable) for f in kind])
    if pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_fixed_size_list(kind):
        return pa.list_(_plain(kind.value_type))
    if pa.types.is_dictionary(kind):
        return _plain(kind.value_type)
    fixed = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.int64(), pa.large_string(): pa.string(), pa.large_binary(): pa.binary(), pa.float16(): pa.float32()}
    return fixed.get(kind, kind)


def row_groups(file: pq.ParquetFile, ranges: dict[str, tuple] | None = None) -> list[tuple[int, int]]:
    """(group, rows before it) of the groups that may hold a row within all ``ranges`` (bounds of columns by dotted path, both included; None is open).

    A group goes only if its statistics show that no value lies within the
    range and that none is null.
    """
    meta, out, before = file.metadata, [], 0
    at = {meta.schema.column(c).path: c for c in range(len(meta.schema))}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        fits = True
        for column, (low, high) in (ranges or {}).items():
            stats = group.column(at[column]).statistics if column in at else None
            if stats is None or not stats.has_min_max or not stats.has_null_count or stats.null_count:
                continue
            fits &= (low is None or stats.max >= low) and (high is None or stats.min <= high)
        if fits:
            out.append((g, before))
        before += group.num_rows
    return out


def scan(spark: SparkSession, member: Member, columns: list[str] | None = None, ranges: dict[str, tuple] | None = None, row: str | None = None) -> DataFrame:
    """The member's rows in file order, one partition for each row group left by ``ranges``; ``row`` names a column for the rows' numbers in the file.

    ``ranges`` skip row groups and drop no row of the others. ``columns`` are
    whole columns or children of structs by dotted path.
    """
    file = member.open()
    groups = row_groups(file, ranges)
    asked = [c for c in file.schema_arrow.names if columns is None or any(x.split(".")[0] == c for x in columns)]
    read = file.schema_arrow if columns is None else file.read_row_groups([], columns=columns).schema
    kept = pa.schema([pa.field(c, _plain(read.field(c).type)) for c in asked])
    shape = pa.schema([*kept, pa.field(row, pa.int64())] if row else list(kept))

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                group, at = groups[i]
                for part in member.open().iter_batches(ROWS, row_groups=[group], columns=columns):
                    arrays = [pa.Table.from_batches([part.select([f.name])]).cast(pa.schema([f])).column(0).combine_chunks() for f in kept]
                    if row:
                        arrays.append(pa.array(range(at, at + len(part)), pa.int64()))
                        at += len(part)
                    yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(run, from_arrow_schema(shape))
