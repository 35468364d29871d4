"""Small byte codecs, batch-wise inside Arrow functions, and the extraction of embedded files by ordered concatenation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.functions import binary

from .packbits import pack, unpack


def packbits(data: str) -> Column:
    """PackBits encoding of one row of bytes; null stays null."""
    return F.arrow_udf(pack, "binary")(data)


def unpackbits(data: Column) -> Column:
    """PackBits decoding; null for data that end inside a run."""
    return F.arrow_udf(unpack, "binary")(data)


def _encode_rle(pixels: list[int], width: int, bits: int) -> bytes:
    """Rows, the last one first, as encoded runs and, for three pixels or more without one, absolute runs."""
    out, height = bytearray(), len(pixels) // width if width else 0
    for y in range(height - 1, -1, -1):
        row, i = [int(v) for v in pixels[y * width : (y + 1) * width]], 0
        while i < width:
            run = 1
            while run < 255 and i + run < width and row[i + run] == row[i]:
                run += 1
            end = i + run
            while run == 1 and end < width and end - i < 255 and (end + 1 >= width or row[end + 1] != row[end]):
                end += 1
            n = end - i
            if run > 1 or n < 3:
                for k, v in [(run, row[i])] if run > 1 else [(1, v) for v in row[i:end]]:
                    out += bytes((k, v if bits == 8 else v << 4 | v))
            else:
                part = row[i:end]
                data = bytes(part) if bits == 8 else bytes(a << 4 | b for a, b in zip(part[::2], [*part[1::2], 0]))
                out += bytes((0, n)) + data + bytes(len(data) % 2)
            i = end
        out += b"\0\0"
    return bytes(out + b"\0\1")


def _decode_rle(data: bytes, width: int, height: int, bits: int) -> tuple[list[int | None] | None, int | None, str | None]:
    """Pixels from the top row on, null where nothing was written, or the place and kind of the first fault."""
    out: list[int | None] = [None] * (width * height)
    x = y = at = 0
    while at < len(data):
        if len(data) - at < 2:
            return None, at, "command"
        count, value = data[at], data[at + 1]
        at += 2
        if count == 0 and value == 0:
            if y >= height:
                return None, at, "row overflow"
            x, y = 0, y + 1
        elif count == 0 and value == 1:
            return out, None, None
        elif count == 0 and value == 2:
            if len(data) - at < 2:
                return None, at, "delta"
            dx, dy = data[at], data[at + 1]
            at += 2
            if dx > width - x or dy >= height - y:
                return None, at, "delta outside image"
            x, y = x + dx, y + dy
        else:
            n = count or value
            if y >= height or n > width - x:
                return None, at, "run outside row"
            if count:
                run = [value] * n if bits == 8 else [value >> 4 if k % 2 == 0 else value & 15 for k in range(n)]
            else:
                held = n if bits == 8 else (n + 1) // 2
                if held + held % 2 > len(data) - at:
                    return None, at, "absolute bytes"
                run = list(data[at : at + n]) if bits == 8 else [data[at + k // 2] >> (0 if k % 2 else 4) & 15 for k in range(n)]
                at += held + held % 2
            first = (height - 1 - y) * width + x
            out[first : first + n] = run
            x += n
    return None, at, "missing end"


def encode_rle(pixels: Column, width: Column, bits: Column) -> Column:
    """RLE8 or RLE4 bytes of an image of colour numbers, row by row from the top; null stays null."""
    return F.pandas_udf(lambda p, w, b: pd.Series([None if x is None else _encode_rle(x, n, k) for x, n, k in zip(p, w, b)], dtype=object), "binary")(pixels, width, bits)


def decode_rle(data: Column, width: Column, height: Column, bits: Column) -> Column:
    """``struct<pixels, offset, fault>``: the image row by row from the top, or where and why its bytes are malformed."""

    def run(d: pd.Series, w: pd.Series, h: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else _decode_rle(x, *size) for x, *size in zip(d, w, h, b)]
        return pd.DataFrame({"pixels": [r[0] for r in rows], "offset": pd.array([r[1] for r in rows], "Int32"), "fault": [r[2] for r in rows]})

    return F.pandas_udf(run, "pixels array<int>, offset int, fault string")(data, width, height, bits)


def expand_runs(runs: Column) -> Column:
    """Values of runs ``array<struct<n, value>>``, each as often as its count, as RLE8 and path types hold them; native."""
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


def fragments(data: Column, size: int) -> Column:
    """``array<struct<current, remaining, bytes>>`` of a binary cut into fragments, as an embedded file is carried; an empty one is one empty fragment, null stays null."""
    n = F.octet_length(data)
    starts = F.sequence(F.lit(0), F.when(n > 0, n - 1).otherwise(n), F.lit(size))
    return F.transform(starts, lambda s: F.struct(F.least(F.lit(size), n - s).alias("current"), F.greatest(F.lit(0), n - s - size).alias("remaining"), F.substring(data, s + 1, F.lit(size)).alias("bytes")))


def join_fragments(rows: DataFrame, keys: list[str], order: str, part_col: str = "part") -> DataFrame:
    """``keys, content, checksum, whole``: fragments put together in order; whole tells whether every remaining count agrees.

    The keys name one file. A null part stands for none (``posexplode_outer`` gives one for null data); content is null without parts.
    The checksum is the complement of the exclusive or of all words of an even-sized content.
    """
    listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, part_col))).alias("_parts"))
    parts = F.filter(F.transform("_parts", lambda p: p[part_col]), lambda p: p.isNotNull())
    listed = listed.select(*keys, parts.alias("_parts"))
    content = F.when(F.size("_parts") > 0, binary.joined(F.col("_parts.bytes")))
    listed = listed.select(*keys, "_parts", content.alias("content"))
    total = F.octet_length("content")
    # What remains after a fragment is the total less all bytes up to it.
    step = F.aggregate("_parts", F.struct(F.lit(0).alias("seen"), F.lit(True).alias("fine")), lambda a, p: F.struct((a["seen"] + p["current"]).alias("seen"), (a["fine"] & (p["remaining"] == total - a["seen"] - p["current"]) & (F.octet_length(p["bytes"]) == p["current"])).alias("fine")))
    return listed.select(*keys, "content", F.when(total % 2 == 0, F.lit(0xFFFF).bitwiseXOR(binary.xor_words(F.col("content")))).alias("checksum"), step["fine"].alias("whole"))
