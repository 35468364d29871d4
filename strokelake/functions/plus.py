"""What EMF+ records hold besides their fixed fields: values in their flags, boxes and points in the coding of the flags, and faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import binary, points
from .layouts import RESERVED

#: Objects of a file have numbers from 0 up to this one.
LAST_OBJECT = 63

# Types whose low flag byte names an object: what is drawn with or drawn, clips, fonts.
OBJECT = (0x400B, 0x400D, 0x400F, 0x4011, 0x4012, 0x4013, 0x4014, 0x4015, 0x4017, 0x4018, 0x4019, 0x401A, 0x401B, 0x401C, 0x4033, 0x4034, 0x4036, 0x4008)
# Types with a brush at byte 12, a colour if flag 0x8000 is set; StrokeFillPath is none of them in files that are drawn.
BRUSH = (0x400A, 0x400C, 0x400E, 0x4010, 0x4016, 0x401C, 0x4036)
# FillRegion and FillPath have their brush there too, besides the object.
PAINT = (0x4013, 0x4014)
# Types with boxes: place of their number (none: one box) and of the first box.
BOXES = {0x400A: (16, 20), 0x400B: (12, 16), 0x400E: (None, 16), 0x400F: (None, 12), 0x4010: (None, 24), 0x4011: (None, 20), 0x4012: (None, 20), 0x401A: (None, 36)}
# Types with points: place of their number and of the first point, and the least number.
POINTS = {0x400C: (16, 20, 3), 0x400D: (12, 16, 2), 0x4016: (20, 24, 3), 0x4017: (16, 20, 3), 0x4018: (24, 28, 2), 0x4019: (12, 16, 4), 0x401B: (36, 40, 3)}
# Types whose flags are their value.
PROPERTIES = tuple(range(0x401E, 0x4025))


def decode_bodies(records: DataFrame) -> DataFrame:
    """Adds ``object, solid, closed, winding, append, effect, mode, unit, value, boxes, points, fault`` to EMF+ records ``type, flags, raw``.

    Each is null where a type has none: ``object`` is the number in the flags, ``solid`` whether the brush is a colour, ``closed`` of
    lines and curves, ``winding`` the fill rule of closed curves, ``append`` whether a matrix goes behind the world, ``effect`` of images, ``mode`` how
    a clip is combined, ``unit`` of pages and containers, ``value`` of properties. Boxes are {x, y, width, height}, points {x, y}, as
    doubles. ``fault``: object number, brush number, pen number, count, curve range, source unit, container flags, body (what doesn't fit the record), reserved
    type; null where nothing is wrong.
    """
    kind, flags, raw = F.col("type"), F.col("flags"), F.col("raw")
    bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    u = lambda at: binary.unsigned(raw, at, 4)
    number = flags.bitwiseAND(F.lit(255))
    size = F.octet_length(raw)
    closed = F.when(kind == 0x400D, bit(0x2000)).when(kind.isin(0x400C, 0x4016, 0x4017), True).when(kind.isin(0x4018, 0x4019), False)

    def box(at: Column, width: int, read) -> Column:
        return F.struct(*[read(raw, at + i * width).alias(n) for i, n in enumerate(("x", "y", "width", "height"))])

    def boxes(n: Column, first: Column) -> Column:
        many = lambda width, read: F.when((n > 0) & (first + n * 4 * width <= size), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)).cast("int") - 1), lambda i: box(first + i * 4 * width, width, read)))
        return F.when(bit(0x4000), many(2, lambda d, at: binary.signed(d, at, 2).cast("double"))).otherwise(many(4, binary.real32))

    # Where boxes and points stand, how many there are and must be goes by the type, so that one expression reads those of all types.
    of = lambda table, pick: F.coalesce(*[F.when(kind == code, F.lit(pick(row))) for code, row in table.items()]).cast("bigint")
    counted = {code: row for code, row in BOXES.items() if row[0] is not None} | {code: row for code, row in POINTS.items()}
    rows = records.withColumns({"_count": of(counted, lambda r: r[0]), "_least": of(counted, lambda r: r[2] if len(r) > 2 else 1), "_box": of(BOXES, lambda r: r[1]), "_at": of(POINTS, lambda r: r[1])})
    rows = rows.withColumn("_n", u(F.col("_count")))
    rows = rows.withColumn("_boxes", F.when(F.col("_box").isNotNull() & (F.coalesce("_n", F.lit(0)) <= size), boxes(F.when(F.col("_count").isNull(), 1).otherwise(F.col("_n")), F.col("_box"))))
    coding = F.when(kind == 0x4018, flags.bitwiseAND(F.lit(0x4000))).otherwise(flags)
    fits = F.col("_n") <= size
    rows = rows.withColumn("_points", F.when(F.col("_at").isNotNull() & fits, points.plus_points(raw, F.col("_at"), F.col("_n"), coding)))
    brush = F.when(kind.isin(*BRUSH, *PAINT), u(12))
    bad = lambda xs, names: F.exists(xs, lambda b: F.array_contains(F.array(*[b[n].isNull() for n in names]), True))
    body = (kind.isin(*BOXES) & (F.col("_boxes").isNull() | F.coalesce(bad(F.col("_boxes"), ("x", "y", "width", "height")), F.lit(False)))) | (F.col("_at").isNotNull() & (F.col("_points").isNull() | F.coalesce(bad(F.col("_points"), ("x", "y")), F.lit(False))))
    fault = (
        F.when(kind.isin(*RESERVED), "reserved type")
        .when(kind.isin(*OBJECT) & (number > LAST_OBJECT), "object number")
        .when((kind == 0x4008) & ~F.shiftright(flags, 8).bitwiseAND(F.lit(127)).between(1, 9), "object number")
        .when(kind.isin(*BRUSH, *PAINT) & ~bit(0x8000) & (brush > LAST_OBJECT), "brush number")
        .when((kind == 0x4015) & (u(12) > LAST_OBJECT), "pen number")
        .when((F.col("_n") < F.col("_least")) | ((kind == 0x4019) & (F.col("_n") % 3 != 1)) | ((kind == 0x401B) & (F.col("_n") != 3)), "count")
        .when((kind == 0x4018) & (u(16) + u(20) >= F.col("_n")), "curve range")
        .when(kind.isin(0x401A, 0x401B) & (u(16) != 2), "source unit")
        .when((kind == 0x4027) & (number != 0), "container flags")
        .when(body, "body")
    )
    values = {
        "object": F.when(kind.isin(*OBJECT), number),
        "solid": F.when(kind.isin(*BRUSH, *PAINT), bit(0x8000)),
        "closed": closed,
        "winding": F.when(kind == 0x4016, bit(0x2000)),
        "append": F.when(kind.isin(0x402C, 0x402D, 0x402E, 0x402F), bit(0x2000)),
        "effect": F.when(kind == 0x401B, bit(0x2000)),
        "mode": F.when(kind.isin(0x4032, 0x4033, 0x4034), F.shiftright(flags, 8).bitwiseAND(F.lit(15))),
        "unit": F.when(kind == 0x4030, number).when(kind == 0x4027, F.shiftright(flags, 8).bitwiseAND(F.lit(255))),
        "value": F.when(kind.isin(*PROPERTIES), flags),
        "boxes": F.col("_boxes"),
        "points": F.col("_points"),
    }
    done = rows.withColumn("fault", fault)
    return done.select(*records.columns, *[v.alias(k) for k, v in values.items()], "fault")
