"""Points of records of variable size: counts first, then coordinates, never beyond the record's end."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import binary

# Where the counts and coordinates of poly records stand: (offset of the number of polygons or None, offset of the
# number of points, offset of the first count or point, bytes of a count, bytes of a coordinate).
WMF_POLY = {0x24: (None, 6, 8, 0, 2), 0x25: (None, 6, 8, 0, 2), 0x38: (6, None, 8, 2, 2)}
EMF_POLY = {
    **{t: (None, 24, 28, 0, 4) for t in (2, 3, 4, 5, 6)},
    **{t: (24, 28, 32, 4, 4) for t in (7, 8)},
    **{t: (None, 24, 28, 0, 2) for t in (85, 86, 87, 88, 89)},
    **{t: (24, 28, 32, 4, 2) for t in (90, 91)},
}


def _many(n: Column, f) -> Column:
    """f of 0 to n - 1; an empty array of its type for none."""
    return F.slice(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), f), F.lit(1), n.cast("int"))


class _Polygons:
    """Polygons of records, a batch at a time; null for other types and where counts don't fit the record."""

    def __init__(self, form: int, kind: int, raw: int, names: list[str]):
        self.form, self.kind, self.raw, self.names = form, kind, raw, names
        self.layouts = {("WMF", t): x for t, x in WMF_POLY.items()} | {("EMF", t): x for t, x in EMF_POLY.items()}

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [self.read(*row) for row in zip(batch.column(self.form).to_pylist(), batch.column(self.kind).to_pylist(), batch.column(self.raw))]
            counts = np.concatenate([np.zeros(0, "int64"), *[c for c, _ in filter(None, read)]])
            places = np.concatenate([np.zeros((0, 2), "int64"), *[p for _, p in filter(None, read)]])
            point = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(places[:, k])) for k in (0, 1)], ["x", "y"])
            polygons = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype("int32")), point)
            ends = np.append(0, np.cumsum([len(r[0]) if r else 0 for r in read])).astype("int32")
            listed = pa.ListArray.from_arrays(pa.array(ends), polygons, mask=pa.array([r is None for r in read], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=self.names)

    def read(self, form: str | None, kind: int | None, value) -> tuple[np.ndarray, np.ndarray] | None:
        """How many points each polygon has, and the points of all."""
        layout = self.layouts.get((form, math.fmod(kind, 256) if form == "WMF" else kind)) if kind is not None else None
        if layout is None or not value.is_valid:
            return None
        groups_at, points_at, at, count_width, width = layout
        raw, number = value.as_py(), 4 if form == "EMF" else 2
        where = points_at if groups_at is None else groups_at
        if len(raw) < where + number:
            return None
        n = int.from_bytes(raw[where : where + number], "little")
        first = at
        if groups_at is None:
            counts = np.array([n], "int64")
        else:
            first += n * count_width
            if first > len(raw):
                return None
            counts = np.frombuffer(raw, f"<u{count_width}", n, at).astype("int64")
        total = int(counts.sum())
        if first + total * 2 * width > len(raw):
            return None
        return counts, np.frombuffer(raw, f"<i{width}", 2 * total, min(first, len(raw) - 1)).astype("int64").reshape(-1, 2) if total else np.zeros((0, 2), "int64")


def polygons(records: DataFrame) -> DataFrame:
    """Adds ``polygons``, ``array<array<struct<x, y>>>``, to records of poly types; null for other types and where counts don't fit the record."""
    kind = StructType([*records.schema.fields, *StructType.fromDDL("polygons array<array<struct<x: bigint, y: bigint>>>").fields])
    return records.mapInArrow(_Polygons(*[records.columns.index(c) for c in ("format", "type", "raw")], kind.names).run, kind)


def let(value: Column, f) -> Column:
    """f(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(values: Column) -> Column:
    """The sums of an array of doubles up to each place. Pieces of the root of its length are summed apart, so that no long array is copied for each value."""
    zero = F.array().cast("array<double>")
    grow = lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x))

    def sums(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / step).cast("int") - 1), lambda k: F.aggregate(F.slice(v, k * step + 1, step), zero, grow))
        both = lambda p: let(F.aggregate(p, zero, lambda a, x: grow(a, F.element_at(x, -1))), lambda ends: F.flatten(F.transform(p, lambda x, k: F.transform(x, lambda s: s + F.coalesce(F.get(ends, k - 1), F.lit(0.0))))))
        return let(pieces, both)

    return let(values, lambda v: F.when(F.size(v) == 0, zero).otherwise(sums(v)))


def relative_bytes(raw: Column, at: Column, n: Column) -> Column:
    """How many bytes the ``n`` relative points from a byte on take; null where they don't fit."""
    tokens = F.regexp_extract_all(F.decode(F.substring(raw, (at + 1).cast("int"), F.octet_length(raw)), "ISO-8859-1"), F.lit(r"(?s)[\x00-\x7f]|[\x80-\xff]."), F.lit(0))
    return let(F.slice(tokens, F.lit(1), (2 * n).cast("int")), lambda t: F.when(F.size(t) == 2 * n, F.length(F.array_join(t, ""))))


def _relative(raw: bytes, at: int, n: int) -> list[float] | None:
    """Sums of ``2 n`` steps, x and y by turns, from a byte on."""
    out, sums, end, k = [], [0.0, 0.0], len(raw), 0
    while k < 2 * n:
        if at >= end:
            return None
        v = raw[at]
        at += 1
        if v < 128:
            v = v if v < 64 else v - 128
        elif at >= end:
            return None
        else:
            v = (v - 128) * 256 + raw[at]
            v = v if v < 1 << 14 else v - (1 << 15)
            at += 1
        sums[k & 1] += v
        out.append(sums[k & 1])
        k += 1
    return out


def _plus_values(raw: pa.Array, at: pa.Array, n: pa.Array, flags: pa.Array) -> pa.Array:
    values, ends, none = [], [0], []
    for data, where, many, flag in zip(raw.to_pylist(), at.to_pylist(), n.to_pylist(), flags.to_pylist()):
        found = None
        if data is not None and where is not None and many is not None and many >= 0:
            flag = flag or 0
            width = 2 if flag & 0x800 else 4 if flag & 0x4000 else 8
            if where + many * width <= len(data):
                found = _relative(data, where, many) if flag & 0x800 else struct.unpack_from(f"<{2 * many}{'h' if width == 4 else 'f'}", data, where)
        none.append(found is None)
        values.extend(found or ())
        ends.append(len(values) // 2)
    pairs = np.array(values, "float64").reshape(-1, 2)
    axes = [pa.array(np.ascontiguousarray(pairs[:, k]), mask=~np.isfinite(pairs[:, k])) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(axes, ["x", "y"]), mask=pa.array(none, pa.bool_()))


def plus_points(raw: Column, at: Column, n: Column, flags: Column) -> Column:
    """The ``n`` points of an EMF+ record from a byte on, in the coding that its flags name; null where they don't fit.

    Flag 0x0800: steps from point to point, each number in one byte (seven bits) or two (fifteen, first byte with its top bit
    set); 0x4000: 16-bit integers; else singles. A batch of records is read in one pass over their bytes.
    """
    return F.arrow_udf(_plus_values, "array<struct<x: double, y: double>>")(raw, at.cast("bigint"), n.cast("bigint"), flags.cast("bigint"))
