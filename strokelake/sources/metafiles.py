"""Metafiles as tables: binary files or columns become framed records, and malformed ones become issues."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary

PLACEABLE, SIGNATURE, PLUS_COMMENT = 0x9AC6CDD7, 0x464D4520, 0x2B464D45


@dataclass(frozen=True)
class Limits:
    """Finite bounds on what a file may hold."""

    file_bytes: int = 64 << 20
    record_bytes: int = 16 << 20
    records: int = 1_000_000


class Malformed(Exception):
    def __init__(self, offset: int, field: str, kind: str = "MALFORMED"):
        super().__init__(offset, field, kind)
        self.offset, self.field, self.kind = offset, field, kind


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of binary files; Spark prunes by path and length before reading."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sniff(content: Column) -> Column:
    """WMF, EMF or null, from the first bytes."""
    first, low, high = binary.unsigned(content, 0, 4), binary.unsigned(content, 0, 2), binary.unsigned(content, 2, 2)
    return F.when(first == PLACEABLE, "WMF").when(first == 1, "EMF").when(low.isin(1, 2) & (high == 9), "WMF")


class _Frames:
    """Checks sizes in a fixed order: least and alignment, largest, end of the data, number of records."""

    def __init__(self, data: bytes, limits: Limits):
        self.data, self.limits, self.rows = data, limits, []

    def add(self, form: str, kind: int, flags: int, at: int, parent: int, size: int, least: int, align: int, end: int) -> None:
        if size < least or size % align:
            raise Malformed(at, "size")
        if size > self.limits.record_bytes:
            raise Malformed(at, "size", "LIMIT")
        if at + size > end:
            raise Malformed(at, "truncated")
        if len(self.rows) >= self.limits.records:
            raise Malformed(at, "records", "LIMIT")
        self.rows.append((form, kind, flags, at, parent, self.data[at : at + size]))


def _wmf(f: _Frames, d: bytes) -> None:
    at = 0
    if struct.unpack_from("<I", d)[0] == PLACEABLE:
        if len(d) < 40:
            raise Malformed(0, "placeable header")
        total = 0
        for w in struct.unpack_from("<10H", d):
            total ^= w
        if total != struct.unpack_from("<H", d, 20)[0]:
            raise Malformed(20, "checksum")
        if struct.unpack_from("<I", d, 16)[0] or not struct.unpack_from("<H", d, 14)[0]:
            raise Malformed(14, "placeable header")
        at = 22
    if len(d) < at + 18:
        raise Malformed(at, "header")
    kind, head, version, words, _, most = struct.unpack_from("<HHHIHI", d, at)
    if kind not in (1, 2) or head != 9 or version not in (0x100, 0x300):
        raise Malformed(at, "header")
    if 2 * words != len(d) - at:
        raise Malformed(at + 6, "file size")
    start, largest, at = at, 0, at + 18
    while True:
        if at + 6 > len(d):
            raise Malformed(at, "missing end")
        size, code = struct.unpack_from("<IH", d, at)
        f.add("WMF", code, 0, at, -1, 2 * size, 6, 2, len(d))
        largest, at = max(largest, size), at + 2 * size
        if code == 0:
            if size != 3 or at != len(d):
                raise Malformed(at, "end")
            break
    if largest != most:
        raise Malformed(start + 12, "largest record")


def _emf(f: _Frames, d: bytes) -> None:
    if len(d) < 88:
        raise Malformed(0, "header")
    size = struct.unpack_from("<I", d, 4)[0]
    signature, _, total, count = struct.unpack_from("<IIII", d, 40)
    if size < 88 or signature != SIGNATURE:
        raise Malformed(40, "signature")
    if total != len(d):
        raise Malformed(48, "file size")
    chars, where = struct.unpack_from("<II", d, 60)
    if chars and (where < 88 or where + 2 * chars > size):
        raise Malformed(60, "description")
    at, n, plus, ended = 0, 0, None, False
    while at < len(d):
        if ended or at + 8 > len(d):
            raise Malformed(at, "after end")
        kind, size = struct.unpack_from("<II", d, at)
        f.add("EMF", kind, 0, at, -1, size, 8, 4, len(d))
        n += 1
        if kind == 1 and at:
            raise Malformed(at, "second header")
        if kind == 14:
            if size < 20 or struct.unpack_from("<I", d, at + size - 4)[0] != size:
                raise Malformed(at, "last size")
            entries, where = struct.unpack_from("<II", d, at + 8)
            if entries and (entries != struct.unpack_from("<I", d, 68)[0] or where < 16 or where + 4 * entries > size - 4):
                raise Malformed(at + 8, "palette")
            ended = True
        if kind == 70:
            if size < 12 or (held := struct.unpack_from("<I", d, at + 8)[0]) > size - 12:
                raise Malformed(at + 8, "comment size")
            if held >= 4 and struct.unpack_from("<I", d, at + 12)[0] == PLUS_COMMENT:
                plus = _plus(f, d, at, at + 16, at + 12 + held, plus, n)
        at += size
    if not ended or n != count or plus is False:
        raise Malformed(at, "end" if not ended else "record count" if n != count else "EMF+ end")


def _plus(f: _Frames, d: bytes, parent: int, at: int, end: int, state: bool | None, n: int) -> bool | None:
    """state: None before the EMF+ header, False after it, True after the end."""
    while at < end:
        if end - at < 12:
            raise Malformed(at, "EMF+ record")
        kind, flags, size, held = struct.unpack_from("<HHII", d, at)
        f.add("EMF+", kind, flags, at, parent, size, 12, 4, end)
        if held > size - 12 or size - 12 - held > 3:
            raise Malformed(at + 8, "EMF+ data size")
        if state is None and (kind != 0x4001 or size != 28 or n != 2):
            raise Malformed(at, "EMF+ header")
        if state is False and kind == 0x4001 or state is True:
            raise Malformed(at, "EMF+ order")
        if kind == 0x4001 and struct.unpack_from("<I", d, at + 12)[0] >> 12 != 0xDBC01:
            raise Malformed(at + 12, "EMF+ version")
        state = kind == 0x4002
        at += size
    return state


def frame(data: bytes, limits: Limits = Limits()) -> tuple[list[tuple], tuple | None]:
    """Framed records of one file up to its first fault, and that fault as (offset, field, kind)."""
    f = _Frames(data, limits)
    try:
        if len(data) > limits.file_bytes:
            raise Malformed(0, "file", "LIMIT")
        head = struct.unpack_from("<I", data)[0] if len(data) >= 4 else 0
        if head == 1:
            _emf(f, data)
        elif head == PLACEABLE or head in (0x90001, 0x90002):
            _wmf(f, data)
        else:
            raise Malformed(0, "format", "FORMAT")
    except Malformed as e:
        return f.rows, (e.offset, e.field, e.kind)
    return f.rows, None


WALKED = "file string, seq int, format string, type int, flags int, offset long, parent_offset long, raw binary, kind string, field string"


#: Rows and bytes of records to give out at once; more only if a file alone has more.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20


def walk_batches(batches: Iterator[pa.RecordBatch], limits: Limits = Limits()) -> Iterator[pa.RecordBatch]:
    """Batches of columns ``WALKED`` from batches of ``file, content``; many small files share one."""
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    names = WALKED.replace(",", "").split()[::2]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    out, held = [], 0
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = content.as_py() or b""
            rows, fault = frame(data, limits)
            out += [(name, k, *r, None, None) for k, r in enumerate(rows)]
            if fault:
                out.append((name, len(rows), None, None, None, fault[0], None, None, fault[2], fault[1]))
            held += len(data)
            if len(out) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield made(out)
                out, held = [], 0
    if out:
        yield made(out)


def _walk(files: DataFrame, file_col: str, content_col: str, limits: Limits) -> DataFrame:
    return files.select(F.col(file_col).cast("string").alias("file"), F.col(content_col).cast("binary").alias("content")).mapInArrow(lambda batches: walk_batches(batches, limits), WALKED)


def records(files: DataFrame, file_col: str = "path", content_col: str = "content", limits: Limits = Limits()) -> DataFrame:
    """``file, seq, format, type, flags, offset, parent_offset, raw``: framed records, one file a row; those before a fault included."""
    return _walk(files, file_col, content_col, limits).filter("kind is null").drop("kind", "field")


def issues(files: DataFrame, file_col: str = "path", content_col: str = "content", limits: Limits = Limits()) -> DataFrame:
    """``file, offset, field, kind``: the first fault of each file that has one."""
    return _walk(files, file_col, content_col, limits).filter("kind is not null").select("file", "offset", "field", "kind")


def build_wmf(rows: DataFrame, keys: list[str], order: list[str], record_col: str = "record") -> DataFrame:
    """``keys, content``: WMF files made of the records of each key in order, with header and end, as native concatenation."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(record_col).alias("_r"))))
    files = rows.groupBy(*keys).agg(parts.alias("_parts"))
    body = F.concat(binary.joined(F.col("_parts._r")), binary.little(F.lit(3), 4), binary.little(F.lit(0), 2))
    most = F.greatest(F.lit(3), F.array_max(F.transform("_parts", lambda p: (F.octet_length(p["_r"]) / 2).cast("long"))))
    files = files.select(*keys, body.alias("_body"), most.alias("_most"))
    head = [(F.lit(2), 2), (F.lit(9), 2), (F.lit(0x300), 2), (9 + F.octet_length("_body") / 2, 4), (F.lit(0), 2), (F.col("_most"), 4), (F.lit(0), 2)]
    return files.select(*keys, F.concat(*[binary.little(v, w) for v, w in head], F.col("_body")).alias("content"))


def _ordered(order: list[str], record_col: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*order, F.col(record_col).alias("_r"))))


def _joined(parts: str) -> Column:
    return binary.joined(F.col(f"{parts}._r"))


def build_emf(rows: DataFrame, keys: list[str], order: list[str], record_col: str = "record") -> DataFrame:
    """``keys, content``: EMF files made of the records of each key in order, with an 88-byte header and the end, as native concatenation.

    A key's records become one row, so keys should name files of bounded size.
    """
    files = rows.groupBy(*keys).agg(_ordered(order, record_col).alias("_parts"))
    files = files.select(*keys, _joined("_parts").alias("_body"), F.size("_parts").alias("_n"))
    number = lambda v: binary.little(v if isinstance(v, Column) else F.lit(v), 4)
    bounds = [number(v) for v in (0, 0, 100, 100, 0, 0, 2540, 2540)]
    counts = [number(SIGNATURE), number(0x10000), number(F.octet_length("_body") + 108), number(F.col("_n") + 2), number(1), number(0), number(0), number(0)]
    device = [number(v) for v in (1000, 1000, 250, 250)]
    end = [number(v) for v in (14, 20, 0, 0, 20)]
    return files.select(*keys, F.concat(number(1), number(88), *bounds, *counts, *device, F.col("_body"), *end).alias("content"))


def plus_comment(records: Column) -> Column:
    """An EMF comment that carries EMF+ records, which are a multiple of four bytes."""
    size = F.octet_length(records)
    return F.concat(binary.little(F.lit(70), 4), binary.little(size + 16, 4), binary.little(size + 4, 4), binary.little(F.lit(PLUS_COMMENT), 4), records)


def plus_record(kind: Column, flags: Column, data: Column) -> Column:
    """One EMF+ record; its data is filled up to a multiple of four bytes."""
    size = F.octet_length(data)
    padded = F.rpad(data, (F.ceil(size / 4) * 4).cast("int"), F.lit(b"\0"))
    return F.concat(binary.little(kind, 2), binary.little(flags, 2), binary.little(F.octet_length(padded) + 12, 4), binary.little(size, 4), padded)


def build_emfplus(rows: DataFrame, keys: list[str], order: list[str], record_col: str = "record") -> DataFrame:
    """``keys, content``: dual EMF files whose EMF+ records stand in one comment between those of the EMF+ header and end."""
    body = rows.groupBy(*keys).agg(_ordered(order, record_col).alias("_parts")).select(*keys, _joined("_parts").alias("_body"))
    head = F.concat(*[binary.little(F.lit(v), w) for v, w in ((0x4001, 2), (1, 2), (28, 4), (16, 4), (0xDBC01002, 4), (1, 4), (96, 4), (120, 4))])
    end = F.concat(*[binary.little(F.lit(v), w) for v, w in ((0x4002, 2), (0, 2), (12, 4), (0, 4))])
    comments = F.array(*[plus_comment(x) for x in (head, F.col("_body"), end)])
    return build_emf(body.select(*keys, F.posexplode(comments).alias("_at", "_comment")), keys, ["_at"], "_comment")


def emf_header(files: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``description``, ``opengl``, ``pixel_format`` and ``micrometers`` of EMF headers; null where a header has no such part.

    The first extension stands from byte 88 on if neither the description nor the records begin before byte 100, the second
    from byte 100 on if nothing, the pixel format included, begins before byte 108.
    """
    c = F.col(content_col)
    number = lambda at: binary.unsigned(c, at, 4)
    size, chars, where = number(4), number(60), number(64)
    first = F.when(chars > 0, where).otherwise(size)
    extended = first >= 100
    length, offset = number(88), number(92)
    has_format = extended & (length > 0) & (offset >= 100) & (offset + length <= size)
    second = extended & (F.when(has_format, F.least(first, offset)).otherwise(first) >= 108)
    found = {
        "description": F.when(chars > 0, F.decode(F.substring(c, where + 1, 2 * chars), "UTF-16LE")),
        "opengl": F.when(extended, number(96) != 0),
        "pixel_format": F.when(has_format, F.substring(c, offset + 1, length)),
        "micrometers": F.when(second, F.struct(number(100).alias("width"), number(104).alias("height"))),
    }
    return files.withColumns({k: F.when(sniff(c) == "EMF", v) for k, v in found.items()})
