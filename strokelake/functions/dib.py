"""Device-independent bitmaps, packed as in WMF: heads checked by native expressions, and rows of pixels unpacked by whole arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binary

#: Pixels of an image at most.
IMAGE_PIXELS = 16_000_000

#: Pixels to work on at once.
PIXELS = 1 << 18

OPAQUE = 0xFF000000


def _low(mask: Column) -> Column:
    """The lowest bit of a mask."""
    return mask.bitwiseAND(-mask)


def _bad_masks(masks: list[Column], bits: Column) -> Column:
    """An empty colour mask, one with gaps, two that overlap, or one beyond 16 bits."""
    gaps = [F.when(m > 0, (m / _low(m) + 1).cast("long").bitwiseAND((m / _low(m)).cast("long")) != 0).otherwise(False) for m in masks]
    overlap = [masks[i].bitwiseAND(masks[j]) != 0 for i in range(4) for j in range(i)]
    tests = [m == 0 for m in masks[:3]] + gaps + overlap + [(bits == 16) & (m > 0xFFFF) for m in masks]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def heads(images: DataFrame, content_col: str = "content", usage: int = 0, logical_col: str | None = None) -> DataFrame:
    """Adds ``dib`` {width, height, top_down, bits, compression, masks, colors, palette_at, pixels_at, stride} and ``fault`` to packed DIBs.

    ``usage`` 0 takes colours from the image, 1 takes numbers of the logical palette (an array of 0xAARRGGBB) from it, 2 means that pixels are such numbers.
    ``fault`` is the first thing wrong: header, header version, header size, dimensions, pixel count, top-down compression, compression, bit count,
    bitfield depth, bitfields, masks, palette length, logical palette, pixel buffer; null for a sound image. Null content is the fault header.
    """
    c, size = F.col(content_col), F.coalesce(F.octet_length(content_col), F.lit(0))
    u = lambda at, width: binary.unsigned(c, at, width)
    rows = images.withColumn("_hs", u(0, 4))
    core = F.col("_hs") == 12
    by = lambda a, b: F.when(core, a).otherwise(b)
    rows = rows.withColumns(
        {
            "_w": by(u(4, 2), binary.signed(c, 4, 4)),
            "_h": by(u(6, 2), binary.signed(c, 8, 4)),
            "_planes": by(u(8, 2), u(12, 2)),
            "_bits": by(u(10, 2), u(14, 2)),
            "_comp": by(F.lit(0).cast("long"), u(16, 4)),
            "_used": by(F.lit(0).cast("long"), u(32, 4)),
        }
    )
    bits, comp = F.col("_bits"), F.col("_comp")
    fields, extended = comp == 3, F.col("_hs") >= 108
    usual = [F.when(bits == 16, a).when(bits == 32, b) for a, b in ((0x7C00, 0xFF0000), (0x3E0, 0xFF00), (0x1F, 0xFF))]
    masks = [F.coalesce(F.when(fields, u(40 + 4 * i, 4)).otherwise(m.cast("long")), F.lit(0)) for i, m in enumerate(usual)]
    masks.append(F.coalesce(F.when(extended & (bits.isin(16, 32)) & (fields | (bits == 32)), u(52, 4)), F.lit(0)))
    most = F.when(bits <= 8, F.pow(F.lit(2), bits).cast("long")).otherwise(F.lit(None))
    count = F.when(bits <= 8, F.when((F.col("_used") == 0) | (F.col("_used") > most), most).otherwise(F.col("_used"))).otherwise(F.col("_used"))
    width = F.lit(2) if usage == 1 else F.when(core, 3).otherwise(4)
    rows = rows.withColumns({"_masks": F.array(*masks), "_n": F.lit(0).cast("long") if usage == 2 else count.cast("long"), "_at": (F.col("_hs") + F.when(fields & (F.col("_hs") == 40), 12).otherwise(0)).cast("long"), "_entry": width, "_stride": F.floor((F.col("_w") * bits + 31) / 32) * 4})
    m = [F.get("_masks", F.lit(i)) for i in range(4)]
    end = F.col("_at") + F.col("_n") * F.col("_entry")
    fault = (
        F.when(size < 4, "header")
        .when(~F.col("_hs").isin(12, 40, 108, 124), "header version")
        .when(size < F.col("_hs"), "header size")
        .when((F.col("_w") <= 0) | (F.col("_h") == 0) | (F.col("_planes") != 1), "dimensions")
        .when(F.col("_w") * F.abs("_h") > IMAGE_PIXELS, "pixel count")
        .when((F.col("_h") < 0) & ~comp.isin(0, 3), "top-down compression")
        .when(~comp.isin(0, 3), "compression")
        .when(~bits.isin(1, 4, 8, 16, 24, 32), "bit count")
        .when(fields & ~bits.isin(16, 32), "bitfield depth")
        .when(fields & (F.col("_hs") == 40) & (size < 52), "bitfields")
        .when(bits.isin(16, 32) & _bad_masks(m, bits), "masks")
        .when(end > size, "palette length")
    )
    if usage and logical_col:
        fault = fault.when((bits <= 8) & (F.coalesce(F.size(logical_col), F.lit(0)) == 0), "logical palette")
    fault = fault.when(end + F.col("_stride") * F.abs("_h") > size, "pixel buffer")
    parts = {"width": F.col("_w"), "height": F.abs("_h"), "top_down": F.col("_h") < 0, "bits": bits, "compression": comp, "masks": F.col("_masks"), "colors": F.col("_n"), "entry": F.col("_entry"), "palette_at": F.col("_at"), "pixels_at": end, "stride": F.col("_stride")}
    head = F.struct(*[v.alias(k) for k, v in parts.items()])
    done = rows.withColumn("fault", fault).withColumn("dib", F.when(F.col("fault").isNull(), head))
    return done.select(*images.columns, "dib", "fault")


def pixel_values(row: Column, bits: Column, width: Column) -> Column:
    """The first ``width`` numbers of 1, 4, 8, 16, 24 or 32 bits in the bytes of a row, an array of integers."""
    at = lambda i: F.get(row, i.cast("int")).cast("long")

    def one(x: Column) -> Column:
        few = lambda n: F.floor(at(F.floor(x * n / 8)) / F.pow(F.lit(2), 8 - n - x * n % 8)).cast("long").bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        wide = lambda n: sum((at(x * n + k) * (1 << 8 * k) for k in range(1, n)), at(x * n))
        return F.when(bits == 1, few(1)).when(bits == 4, few(4)).when(bits == 8, at(x)).when(bits == 16, wide(2)).when(bits == 24, wide(3)).when(bits == 32, wide(4))

    return F.transform(F.sequence(F.lit(0), width.cast("int") - 1), one)


class _Lines:
    """Lines of pixels out of the bytes of sound images, by whole arrays; a bounded number of pixels at once."""

    def __init__(self, keys: int, usage: int, names: list[str]):
        self.keys, self.usage, self.names = keys, usage, names

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pixels = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                content, head, logical = (batch.column(self.keys + k)[i] for k in range(3))
                if not head.is_valid:
                    continue
                for y, colors in self.image(np.frombuffer(content.as_buffer(), "uint8"), head.as_py(), logical.as_py()):
                    made.append((batch, i, y, colors))
                    pixels += colors.size
                    if pixels >= PIXELS:
                        yield self.rows(made)
                        made, pixels = [], 0
        if made:
            yield self.rows(made)

    def rows(self, made: list[tuple]) -> pa.RecordBatch:
        keys = [pa.concat_arrays([pa.repeat(batch.column(k)[i], len(colors)) for batch, i, _, colors in made]) for k in range(self.keys)]
        beyond = np.concatenate([(colors < 0).any(axis=1) for *_, colors in made])
        y = np.concatenate([y + np.arange(len(colors), dtype="int32") for _, _, y, colors in made])
        ends = np.cumsum(np.concatenate([np.full(len(colors), colors.shape[1]) for *_, colors in made]))
        places = np.concatenate([[0], ends]).astype("int32")
        lists = pa.ListArray.from_arrays(pa.array(places), pa.array(np.concatenate([colors.ravel() for *_, colors in made])), mask=pa.array(beyond))
        fault = pa.array(np.where(beyond, "palette index", None), pa.string())
        arrays = [*keys, pa.array(y, pa.int32()), lists, fault]
        return pa.RecordBatch.from_arrays(arrays, names=self.names)

    def image(self, data: np.ndarray, d: dict, logical: list | None) -> Iterator[tuple[int, np.ndarray]]:
        """The first line and the colours of some lines at a time; -1 stands for numbers beyond the palette."""
        bits, width, height, stride = d["bits"], d["width"], d["height"], d["stride"]
        lines = data[d["pixels_at"] : d["pixels_at"] + stride * height].reshape(height, stride)
        lines = lines if d["top_down"] else lines[::-1]
        palette = self.palette(data, d, logical) if bits <= 8 else None
        step = max(1, PIXELS // width)
        for y in range(0, height, step):
            v = _numbers(lines[y : y + step], bits, width)
            if bits <= 8:
                yield y, palette[v]
            elif bits == 24:
                yield y, v | OPAQUE
            else:
                red, green, blue, alpha = (_scaled(v, m) if m else None for m in d["masks"])
                yield y, (OPAQUE if alpha is None else alpha << 24) + (red << 16) + (green << 8) + blue

    def palette(self, data: np.ndarray, d: dict, logical: list | None) -> np.ndarray:
        out = np.full(256, -1, "int64")
        named = np.array([-1 if c is None else c for c in logical or []], "int64")
        entries = data[d["palette_at"] : d["palette_at"] + d["colors"] * d["entry"]].reshape(d["colors"], d["entry"]).astype("int64")
        if self.usage == 2:
            found = named[:256]
        elif self.usage == 1:
            number = entries[:, 0] + entries[:, 1] * 256
            found = np.where(number < len(named), np.append(named, -1)[np.minimum(number, len(named))], -1)
        else:
            found = OPAQUE + entries[:, 0] + entries[:, 1] * 256 + entries[:, 2] * 65536
        out[: len(found)] = found
        return out


def _numbers(lines: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The first ``width`` numbers of 1, 4, 8, 16, 24 or 32 bits of each line."""
    if bits == 1:
        return np.unpackbits(lines, axis=1)[:, :width]
    if bits == 4:
        return np.stack([lines >> 4, lines & 15], axis=2).reshape(len(lines), -1)[:, :width]
    if bits == 8:
        return lines[:, :width]
    if bits == 24:
        v = lines[:, : 3 * width].reshape(len(lines), width, 3).astype("int64")
        return v[..., 0] | v[..., 1] << 8 | v[..., 2] << 16
    return np.ascontiguousarray(lines[:, : bits // 8 * width]).view(f"<u{bits // 8}").astype("int64")


def _scaled(v: np.ndarray, mask: int) -> np.ndarray:
    """The part of numbers under a mask, scaled to 0..255 and rounded."""
    low = mask & -mask
    most = mask // low
    part = (v & mask) // low
    return part if most == 255 else (part * 255 + most // 2) // most


def pixel_rows(images: DataFrame, keys: list[str], content_col: str = "content", usage: int = 0, logical_col: str | None = None) -> DataFrame:
    """``keys, y, colors, fault``: one row a line of each image from the top down, its pixels as 0xAARRGGBB.

    An image is spread over as many rows as it has lines. Palettes hold up to 256 colours; a number beyond the palette makes the
    line's ``fault`` ``palette index`` and its colours null. Images with a fault give no lines.
    """
    sound = heads(images, content_col, usage, logical_col)
    logical = F.col(logical_col).cast("array<bigint>") if logical_col else F.lit(None).cast("array<bigint>")
    # Images with a fault go as nulls; a filter would be pushed below the projections with copies of their expressions.
    given = sound.select(*keys, F.when(F.col("dib").isNotNull(), F.col(content_col)).alias("_content"), "dib", logical.alias("_logical"))
    kinds = [f"{k} {images.schema[k].dataType.simpleString()}" for k in keys]
    return given.mapInArrow(_Lines(len(keys), usage, [*keys, "y", "colors", "fault"]).run, ", ".join([*kinds, "y int, colors array<bigint>, fault string"]))


def mono_rows(images: DataFrame, keys: list[str], content_col: str = "content") -> DataFrame:
    """``keys, y, bits`` of uncompressed images of one bit a pixel, from the top down; other images and those with a fault give no rows."""
    c, d = F.col(content_col), F.col("dib")
    rows = heads(images, content_col)
    rows = rows.withColumn("y", F.explode(F.when((d["bits"] == 1) & (d["compression"] == 0), F.sequence(F.lit(0), d["height"].cast("int") - 1))))
    line = F.when(d["top_down"], F.col("y")).otherwise(d["height"] - 1 - F.col("y"))
    rows = rows.withColumn("_row", binary.byte_values(F.substring(c, (d["pixels_at"] + line * d["stride"] + 1).cast("int"), d["stride"].cast("int"))))
    return rows.select(*keys, "y", F.transform(pixel_values(F.col("_row"), F.lit(1), d["width"]), lambda v: v == 1).alias("bits"))
