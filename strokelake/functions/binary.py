"""Little-endian integers as native expressions, and checksums, over binary columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def unsigned(data: Column, at, width: int) -> Column:
    """The unsigned little-endian integer of ``width`` bytes (at most 4) at a 0-based offset; null beyond the end."""
    part = F.substring(data, _c(at) + 1, F.lit(width))
    digits = F.hex(part)
    turned = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))])
    return F.when(F.octet_length(part) == width, F.conv(turned, 16, 10).cast("long"))


def signed(data: Column, at, width: int) -> Column:
    value = unsigned(data, at, width)
    return F.when(value >= 1 << (8 * width - 1), value - (1 << (8 * width))).otherwise(value)


def real32(data: Column, at) -> Column:
    """An IEEE single as a double; null where it isn't finite or beyond the end."""
    bits = unsigned(data, at, 4)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
    mantissa = bits.bitwiseAND(F.lit((1 << 23) - 1))
    size = F.when(exponent == 0, mantissa * F.pow(F.lit(2.0), F.lit(-149))).otherwise((mantissa + (1 << 23)) * F.pow(F.lit(2.0), exponent - 150))
    return F.when(exponent < 255, F.when(F.shiftright(bits, 31) == 1, -size).otherwise(size))


def little(value: Column, width: int) -> Column:
    """The low ``width`` bytes of an integer, little-endian."""
    masked = value.cast("long").bitwiseAND(F.lit((1 << (8 * width)) - 1))
    digits = F.lpad(F.hex(masked), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))]))


def small_real(value: Column) -> Column:
    """The four bytes of an integer from 0 to 2^24 as an IEEE single."""
    power = F.floor(F.log2(F.greatest(value, F.lit(1)))).cast("int")
    bits = (power + 127) * (1 << 23) + (value - F.pow(F.lit(2.0), power)).cast("long") * F.pow(F.lit(2.0), 23 - power).cast("long")
    return little(F.when(value == 0, 0).otherwise(bits), 4)


def words(data: Column) -> Column:
    """The 16-bit words of an even-sized binary."""
    n = (F.octet_length(data) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: unsigned(data, i * 2, 2))).otherwise(F.array().cast("array<bigint>"))


def _xor(values: pa.Array) -> pa.Array:
    """Reads the words where they lie in the batch, without taking the values out of it."""
    wide = values.cast(pa.large_binary())
    ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1].tolist()
    content = np.frombuffer(wide.buffers()[2] or b"", np.uint8)
    totals = [int(np.bitwise_xor.reduce(content[a : b - (b - a) % 2].view("<u2"))) ^ (int(content[b - 1]) if (b - a) % 2 else 0) for a, b in zip(ends, ends[1:])]
    return pa.array(totals, pa.int64(), mask=wide.is_null().to_numpy(zero_copy_only=False))


def xor_words(data: Column) -> Column:
    """Exclusive or of all 16-bit words of a binary; an odd byte at the end is a word of its own. By whole arrays, batch-wise."""
    return F.arrow_udf(_xor, "long")(data)


def byte_values(data: Column) -> Column:
    """All bytes as an array of integers; empty for none."""
    letters = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.when(F.octet_length(data) > 0, F.transform(letters, lambda c: F.ascii(c))).otherwise(F.array().cast("array<int>"))


def joined(parts: Column) -> Column:
    """The binaries of an array one behind the other, in time proportional to their bytes."""
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))
