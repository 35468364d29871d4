"""A query over the fields of all record types whose SQL has its own table of places, widths and signs.

Records are bytes that a rule makes of an event's id and the place of each byte; neither the layouts nor anything built of them has a
part in that. The SQL reads fields from the same rule by the table below, written from the published formats.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary, layouts, plus
from strokelake.sources import metafiles

from .registry import query, table

# Types of records, then fields with the place of their first byte and their kind (i, u and f of so many bytes).
# "box" is left, top, right and bottom from byte 8 on, "world" six singles of a matrix.
_WMF = """
0102 0103 0104 0106 0107 012E: mode 6 u2
0108: extra 6 i2
0127: level 6 i2
012A 012B 012C: region 6 u2
012D 01F0: object 6 u2
0139: n 6 u2
0149: layout 6 u2
0142: style 6 u2, usage 8 u2
0201 0209: color 6 u4
0231: flags 6 u4
020A: count 6 u2, extra 8 u2
020B 020C 020D 020E 020F 0211 0213 0214 0220: y 6 i2, x 8 i2
0228: region 6 u2, brush 8 u2
0234: palette 6 u2
02FA: style 6 u2, width 8 i2, height 10 i2, color 12 u4
02FB: height 6 i2, width 8 i2, escapement 10 i2, orientation 12 i2, weight 14 i2, italic 16 u1, underline 17 u1, strikeout 18 u1, charset 19 u1, outprecision 20 u1, clipprecision 21 u1, quality 22 u1, pitch 23 u1
02FC: style 6 u2, color 8 u4, hatch 12 u2
0324 0325: n 6 i2
0521: length 6 i2
0538: n 6 u2
0410 0412: ydenom 6 i2, ynum 8 i2, xdenom 10 i2, xnum 12 i2
0415 0416 0418 041B: bottom 6 i2, right 8 i2, top 10 i2, left 12 i2
0419 041F: color 6 u4, y 10 i2, x 12 i2
0429: region 6 u2, brush 8 u2, height 10 i2, width 12 i2
0037 00F7 0436: start 6 u2, n 8 u2
0548: mode 6 u2, color 8 u4, y 12 i2, x 14 i2
061C: height 6 i2, width 8 i2, bottom 10 i2, right 12 i2, top 14 i2, left 16 i2
061D: rop 6 u4, height 10 i2, width 12 i2, y 14 i2, x 16 i2
0626: function 6 u2, bytes 8 u2
06FF: next 6 i2, kind 8 i2, objects 10 i4, bytes 14 i2, scans 16 i2, longest 18 i2, left 20 i2, top 22 i2, right 24 i2, bottom 26 i2
0817 081A 0830: yend 6 i2, xend 8 i2, ystart 10 i2, xstart 12 i2, bottom 14 i2, right 16 i2, top 18 i2, left 20 i2
0922 0940: rop 6 u4, ysrc 10 i2, xsrc 12 i2, height 14 i2, width 16 i2, y 18 i2, x 20 i2
0A32: y 6 i2, x 8 i2, length 10 i2, options 12 u2
0B23 0B41: rop 6 u4, hsrc 10 i2, wsrc 12 i2, ysrc 14 i2, xsrc 16 i2, height 18 i2, width 20 i2, y 22 i2, x 24 i2
0D33: usage 6 u2, scans 8 u2, start 10 u2, ysrc 12 u2, xsrc 14 u2, height 16 u2, width 18 u2, y 20 u2, x 22 u2
0F43: rop 6 u4, usage 10 u2, hsrc 12 i2, wsrc 14 i2, ysrc 16 i2, xsrc 18 i2, height 20 i2, width 22 i2, y 24 i2, x 26 i2
"""
_EMF = """
2 3 4 5 6 56 85 86 87 88 89 92: box, n 24 u4
7 8 90 91: box, groups 24 u4, n 28 u4
9 10 11 12 13 26 27 54: x 8 i4, y 12 i4
15: x 8 i4, y 12 i4, color 16 u4
16: flags 8 u4
17 18 19 20 21 22 67 98: mode 8 u4
24 25: color 8 u4
23: size 8 u2, flags 10 u2, illuminant 12 u2, redgamma 14 u2, greengamma 16 u2, bluegamma 18 u2, black 20 u2, white 22 u2, contrast 24 i2, brightness 26 i2, colourfulness 28 i2, tint 30 i2
29 30 42 43 62 63 64: box
31 32: xnum 8 i4, xdenom 12 i4, ynum 16 i4, ydenom 20 i4
34: level 8 i4
35: world 8
36: world 8, mode 32 u4
37 40 99 100 101 122: object 8 u4
48: palette 8 u4
38: object 8 u4, style 12 u4, width 16 i4, unused 20 i4, color 24 u4
39: object 8 u4, style 12 u4, color 16 u4, hatch 20 u4
41: x 8 i4, y 12 i4, radius 16 u4, start 20 f4, sweep 24 f4
44: box, width 24 i4, height 28 i4
45 46 47 55: box, xstart 24 i4, ystart 28 i4, xend 32 i4, yend 36 i4
49: palette 8 u4, version 12 u2, n 14 u2
50: palette 8 u4, start 12 u4, n 16 u4
51: palette 8 u4, n 12 u4
53: x 8 i4, y 12 i4, color 16 u4, mode 20 u4
57: direction 8 u4
58: limit 8 f4
71: box, bytes 24 u4, brush 28 u4
72: box, bytes 24 u4, brush 28 u4, width 32 i4, height 36 i4
73 74 103: box, bytes 24 u4
75: bytes 8 u4, mode 12 u4
76: box, x 24 i4, y 28 i4, width 32 i4, height 36 i4, rop 40 u4, xsrc 44 i4, ysrc 48 i4, world 52, bkcolor 76 u4, usage 80 u4, bmi 84 u4, bmibytes 88 u4, bits 92 u4, bitbytes 96 u4
77: box, x 24 i4, y 28 i4, width 32 i4, height 36 i4, rop 40 u4, xsrc 44 i4, ysrc 48 i4, world 52, bkcolor 76 u4, usage 80 u4, bmi 84 u4, bmibytes 88 u4, bits 92 u4, bitbytes 96 u4, wsrc 100 i4, hsrc 104 i4
114: box, x 24 i4, y 28 i4, width 32 i4, height 36 i4, blend 40 u4, xsrc 44 i4, ysrc 48 i4, world 52, bkcolor 76 u4, usage 80 u4, bmi 84 u4, bmibytes 88 u4, bits 92 u4, bitbytes 96 u4, wsrc 100 i4, hsrc 104 i4
116: box, x 24 i4, y 28 i4, width 32 i4, height 36 i4, color 40 u4, xsrc 44 i4, ysrc 48 i4, world 52, bkcolor 76 u4, usage 80 u4, bmi 84 u4, bmibytes 88 u4, bits 92 u4, bitbytes 96 u4, wsrc 100 i4, hsrc 104 i4
78: box, x 24 i4, y 28 i4, width 32 i4, height 36 i4, rop 40 u4, xsrc 44 i4, ysrc 48 i4, world 52, bkcolor 76 u4, usage 80 u4, bmi 84 u4, bmibytes 88 u4, bits 92 u4, bitbytes 96 u4, xmask 100 i4, ymask 104 i4, maskusage 108 u4, maskbmi 112 u4, maskbmibytes 116 u4, maskbits 120 u4, maskbitbytes 124 u4
79: box, x0 24 i4, y0 28 i4, x1 32 i4, y1 36 i4, x2 40 i4, y2 44 i4, xsrc 48 i4, ysrc 52 i4, wsrc 56 i4, hsrc 60 i4, world 64, bkcolor 88 u4, usage 92 u4, bmi 96 u4, bmibytes 100 u4, bits 104 u4, bitbytes 108 u4, xmask 112 i4, ymask 116 i4, maskusage 120 u4, maskbmi 124 u4, maskbmibytes 128 u4, maskbits 132 u4, maskbitbytes 136 u4
80: box, x 24 i4, y 28 i4, xsrc 32 i4, ysrc 36 i4, wsrc 40 i4, hsrc 44 i4, bmi 48 u4, bmibytes 52 u4, bits 56 u4, bitbytes 60 u4, usage 64 u4, start 68 u4, scans 72 u4
81: box, x 24 i4, y 28 i4, xsrc 32 i4, ysrc 36 i4, wsrc 40 i4, hsrc 44 i4, bmi 48 u4, bmibytes 52 u4, bits 56 u4, bitbytes 60 u4, usage 64 u4, rop 68 u4, width 72 i4, height 76 i4
82: object 8 u4, height 12 i4, width 16 i4, escapement 20 i4, orientation 24 i4, weight 28 i4, italic 32 u1, underline 33 u1, strikeout 34 u1, charset 35 u1, outprecision 36 u1, clipprecision 37 u1, quality 38 u1, pitch 39 u1
83 84: box, mode 24 u4, xscale 28 f4, yscale 32 f4, x 36 i4, y 40 i4, length 44 u4, text 48 u4, options 52 u4, cleft 56 i4, ctop 60 i4, cright 64 i4, cbottom 68 i4, advances 72 u4
93 94: object 8 u4, usage 12 u4, bmi 16 u4, bmibytes 20 u4, bits 24 u4, bitbytes 28 u4
95: object 8 u4, bmi 12 u4, bmibytes 16 u4, bits 20 u4, bitbytes 24 u4, style 28 u4, width 32 u4, brushstyle 36 u4, color 40 u4, hatch 44 u4, n 48 u4
96 97: box, mode 24 u4, xscale 28 f4, yscale 32 f4, n 36 u4
102: bytes 8 u4
104: size 8 u2, version 10 u2, flags 12 u4
105 106: escape 8 u4, bytes 12 u4
108: x 8 i4, y 12 i4, length 16 u4, options 20 u4, mode 24 u4, xscale 28 f4, yscale 32 f4
109: checksum 8 u4, index 12 u4
110: escape 8 u4, driver 12 u4, bytes 16 u4
111: palette 8 u4, first 12 u4, n 16 u4, unused 20 u4
112 113: flags 8 u4, namebytes 12 u4, bytes 16 u4
115: layout 8 u4
118: box, vertices 24 u4, shapes 28 u4, mode 32 u4
119: n 8 u4
120: extra 8 i4, count 12 i4
121: action 8 u4, flags 12 u4, namebytes 16 u4, bytes 20 u4
"""
_EMFPLUS = """
4009: color 12 u4
400A 400C: brush 12 u4, n 16 u4
400B 400D 4019: n 12 u4
400E 4013 4014 4037: brush 12 u4
4010: brush 12 u4, start 16 f4, sweep 20 f4
4011 4012: start 12 f4, sweep 16 f4
4015: pen 12 u4
4016: brush 12 u4, tension 16 f4, n 20 u4
4017: tension 12 f4, n 16 u4
4018: tension 12 f4, offset 16 u4, segments 20 u4, n 24 u4
401A: attributes 12 u4, unit 16 i4, sx 20 f4, sy 24 f4, sw 28 f4, sh 32 f4
401B: attributes 12 u4, unit 16 i4, sx 20 f4, sy 24 f4, sw 28 f4, sh 32 f4, n 36 u4
401C: brush 12 u4, format 16 u4, length 20 u4, x 24 f4, y 28 f4, width 32 f4, height 36 f4
401D: x 12 i4, y 16 i4
4025 4026 4028 4029: index 12 u4
4027: dx 12 f4, dy 16 f4, dw 20 f4, dh 24 f4, sx 28 f4, sy 32 f4, sw 36 f4, sh 40 f4, index 44 u4
402A 402C: world 12
402D 4035: dx 12 f4, dy 16 f4
402E: sx 12 f4, sy 16 f4
402F: angle 12 f4
4030: scale 12 f4
4032: x 12 f4, y 16 f4, width 20 f4, height 24 f4
4036: brush 12 u4, options 16 u4, matrix 20 u4, n 24 u4
4038: guid1 12 u4, guid2 16 u4, guid3 20 u4, guid4 24 u4, bytes 28 u4
4039: modes 12 u4, xorigin 16 i2, yorigin 18 i2, contrast 20 u2
"""

#: Bytes of a record of each format, the longest layout included.
_BYTES = {"WMF": 70, "EMF": 160, "EMF+": 60}


def _sql_rows() -> str:
    """The table above as SQL rows (format, type, label, place, kind, width)."""
    out = []
    for form, text, base in (("WMF", _WMF, 16), ("EMF", _EMF, 10), ("EMF+", _EMFPLUS, 16)):
        for line in text.strip().splitlines():
            codes, fields = line.split(": ")
            listed = []
            for field in fields.split(", "):
                if field == "box":
                    listed += [f"{n} {8 + 4 * i} i4" for i, n in enumerate(("left", "top", "right", "bottom"))]
                elif field.startswith("world"):
                    listed += [f"{n} {int(field.split()[1]) + 4 * i} f4" for i, n in enumerate(("m11", "m12", "m21", "m22", "dx", "dy"))]
                else:
                    listed.append(field)
            for code in codes.split():
                out += ["('{}', {}, '{}', {}, '{}', {})".format(form, int(code, base), *re.match(r"(\w+) (\d+) (\w)(\d)$", f).groups()) for f in listed]
    return ", ".join(out)


_RULE = "case when ({at}) % 4 = 3 then 64 + 128 * ((event_id + {at}) % 2) else (event_id * 37 + ({at}) * 101 + 13) % 256 end"


@query(f"""with f(format, code, label, place, kind, width) as (values {_sql_rows()}), t as (select format, code, row_number() over (order by format, code) - 1 as k, count(*) over () as n from (select distinct format, code from f)),
 e as (select event_id, t.format, t.code, f.label, f.kind, f.width, {' + '.join(f"case when f.width > {k} then ({_RULE.format(at=f'f.place + {k}')}) * {256**k} else 0 end" for k in range(4))} as u from events join t on event_id % t.n = t.k join f on f.format = t.format and f.code = t.code),
 v as (select *, case kind when 'i' then case when u >= cast(1 as bigint) << (8 * width - 1) then u - (cast(1 as bigint) << (8 * width)) else u end * cast(4194304 as bigint) when 'u' then u * cast(4194304 as bigint) else (1 - 2 * (u // 2147483648)) * (u % 8388608 + 8388608) * (cast(1 as bigint) << (u // 8388608 % 256 - 128)) end as v from e)
 select format, cast(code as int) as code, label, count(*) as n, cast(sum((v % 1000003 + 1000003) % 1000003) as bigint) as total, count(*) filter (v < 0) as n_negative from v group by format, code, label""")
def decode_record_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of every record type that has fields, read from bytes of all values; scaled so that singles are whole numbers too."""
    skipped = {("EMF", 1), ("EMF", 14), ("EMF", 70), ("EMF+", 0x4001), ("EMF+", 0x4002)}
    types = sorted((form, code) for form, code, _, fields in layouts.layout_rows() if fields and (form, code) not in skipped)
    listed = spark.createDataFrame([(k, form, code, _BYTES[form]) for k, (form, code) in enumerate(types)], "_k int, format string, type int, size int")
    at = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda j: F.when(j % 4 == 3, 64 + 128 * ((F.col("_m") + j) % 2)).otherwise((F.col("_m") * 37 + j * 101 + 13) % 256))
    raw = F.unhex(F.array_join(F.transform(at, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))
    # The bytes of a record go by its type and its event's id modulo 256, so each such pair is written once.
    written = listed.crossJoin(spark.range(256).select(F.col("id").alias("_m"))).select("_k", "_m", "format", "type", raw.alias("raw"))
    e = table(spark, sf_dir, "events").select((F.col("event_id") % len(types)).cast("int").alias("_k"), (F.col("event_id") % 256).alias("_m")).join(F.broadcast(written), ["_k", "_m"])
    fields = layouts.decode(e.select("format", "type", "raw")).select("format", F.col("type").alias("code"), F.explode("fields").alias("label", "value"))
    scaled = (F.col("value") * (1 << 22)).cast("long")
    return fields.groupBy("format", "code", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(scaled, F.lit(1000003))).alias("total"), F.count_if(scaled < 0).alias("n_negative"))


# EMF+ types with something in their flags or a body of boxes or points.
_PLUS = "[16394, 16395, 16396, 16397, 16398, 16399, 16400, 16401, 16402, 16403, 16404, 16405, 16406, 16407, 16408, 16409, 16410, 16411, 16414, 16420, 16423, 16428, 16431, 16432, 16435, 16436]"


@query(f"""with e as (select event_id, {_PLUS}[event_id % 26 + 1] as t, event_id // 26 as m from events),
 f as (select *, (m * 5 % 67) as id, case when t in (16423) then m % 3 else m * 5 % 67 end as low, m % 2 = 0 as b8, m % 3 = 0 as b4, m % 5 < 2 as b2, 3 + m % 5 as n, m * 11 % 80 as brush, m % 7 as r from e),
 g as (select *, b8 or t not in (16394, 16396, 16398, 16400, 16403, 16404, 16406) as brushed from f),
 x as (select *, case when t in (16395, 16397, 16399, 16401, 16402, 16403, 16404, 16405, 16407, 16408, 16409, 16410, 16411, 16435, 16436) and low > 63 then 'object number' when t in (16394, 16396, 16398, 16400, 16403, 16404, 16406) and not b8 and brush > 63 then 'brush number' when t = 16405 and brush > 63 then 'pen number'
   when t = 16409 and n % 3 <> 1 then 'count' when t = 16411 and n <> 3 then 'count' when t = 16408 and 1 + m % 3 + m % 4 >= n then 'curve range' when t in (16410, 16411) and m % 4 = 3 then 'source unit' when t = 16423 and low <> 0 then 'container flags' end as fault from g),
 s as (select *, case when t in (16394, 16395) then n when t in (16398, 16399, 16400, 16401, 16402, 16410) then 1 end as n_boxes, case when t in (16396, 16397, 16406, 16407, 16408, 16409, 16411) then n end as n_points from x)
 select t as type, fault, count(*) as n, cast(sum(case when t in (16395, 16397, 16399, 16401, 16402, 16403, 16404, 16405, 16407, 16408, 16409, 16410, 16411, 16435, 16436) then low end) as bigint) as objects,
  count(*) filter (b8 and t in (16394, 16396, 16398, 16400, 16403, 16404, 16406)) as n_solid, count(*) filter (t in (16396, 16406, 16407) or t = 16397 and b2) as n_closed, count(*) filter (t = 16406 and b2) as n_winding, count(*) filter (t in (16428, 16431) and b2) as n_append, count(*) filter (t = 16411 and b2) as n_effect,
  cast(sum(case when t in (16435, 16436) then r end) as bigint) as modes, cast(sum(case when t = 16432 then low when t = 16423 then r + case when b8 then 128 else 0 end + case when b4 then 64 else 0 end + case when b2 then 32 else 0 end end) as bigint) as units,
  cast(sum(case when t in (16414, 16420) then low + 256 * r + case when b8 then 32768 else 0 end + case when b4 then 16384 else 0 end + case when b2 then 8192 else 0 end end) as bigint) as property_values,
  cast(sum(case when n_boxes > 0 then list_sum(list_transform(range(0, 4 * n_boxes), lambda i: (i + 1) * ((m + i) % 200 - case when b4 then 100 else 0 end))) end) as bigint) as box_sum,
  cast(sum(case when n_points > 0 then list_sum(list_transform(range(0, 2 * n_points), lambda i: (i + 1) * ((m + i) % 200 - case when b4 then 100 else 0 end))) end) as bigint) as point_sum
 from s group by t, fault""")
def plus_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMF+ records of all kinds of bodies: what their flags say, their boxes and points in both codings, and their faults."""
    types = [int(x) for x in re.findall(r"\d+", _PLUS)]
    m, kind = F.col("m"), F.col("type")
    e = table(spark, sf_dir, "events").select(F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("event_id") % 26 + 1).cast("int")).alias("type"), F.floor(F.col("event_id") / 26).alias("m"))
    short = m % 3 == 0
    flags = F.when(kind == 0x4027, m % 3).otherwise(m * 5 % 67) + 256 * (m % 7) + F.when(m % 2 == 0, 0x8000).otherwise(0) + F.when(short, 0x4000).otherwise(0) + F.when(m % 5 < 2, 0x2000).otherwise(0)
    n, brush = 3 + m % 5, m * 11 % 80
    word = lambda v: binary.little(v if not isinstance(v, int) else F.lit(v), 4)
    zero = F.lit(bytes(4))
    values = lambda many: binary.joined(F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda i: F.when(short, binary.little((m + i) % 200 - 100, 2)).otherwise(binary.small_real((m + i) % 200))))
    unit = word(F.when(m % 4 == 3, 1).otherwise(2))
    source = F.concat(word(0), unit, *[zero] * 4)
    head = (
        F.when(kind.isin(0x400A, 0x400C), F.concat(word(brush), word(n)))
        .when(kind.isin(0x400B, 0x400D, 0x4019), word(n))
        .when(kind.isin(0x400E, 0x4013, 0x4014, 0x4015), word(brush))
        .when(kind == 0x400F, F.lit(b""))
        .when(kind == 0x4010, F.concat(word(brush), zero, zero))
        .when(kind.isin(0x4011, 0x4012), F.concat(zero, zero))
        .when(kind == 0x4016, F.concat(word(brush), zero, word(n)))
        .when(kind == 0x4017, F.concat(zero, word(n)))
        .when(kind == 0x4018, F.concat(zero, word(1 + m % 3), word(m % 4), word(n)))
        .when(kind == 0x401A, source)
        .when(kind == 0x401B, F.concat(source, word(n)))
        .otherwise(F.lit(bytes(36)))
    )
    many = F.when(kind.isin(0x400A, 0x400B), 4 * n).when(kind.isin(0x400C, 0x400D, 0x4016, 0x4017, 0x4018, 0x4019, 0x401B), 2 * n).when(kind.isin(0x400E, 0x400F, 0x4010, 0x4011, 0x4012, 0x401A), 4)
    parts = e.select("m", "type", flags.cast("int").alias("flags"), head.alias("head"), many.alias("many")).withColumn("body", F.when(F.col("many").isNull(), F.col("head")).otherwise(F.concat("head", values(F.col("many")))))
    rows = parts.select("m", "type", "flags", metafiles.plus_record(kind, F.col("flags"), F.col("body")).alias("raw"))
    d = plus.decode_bodies(rows)
    total = lambda column, names: F.aggregate(F.flatten(F.transform(column, lambda b: F.array(*[b[x] for x in names]))), F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("i")), lambda a, v: F.struct((a["s"] + a["i"] * v).alias("s"), (a["i"] + 1).alias("i")), lambda a: a["s"])
    d = d.withColumns({"_boxes": total("boxes", ("x", "y", "width", "height")), "_points": total("points", ("x", "y"))})
    return d.groupBy("type", "fault").agg(
        F.count(F.lit(1)).alias("n"), F.sum("object").alias("objects"), F.count_if("solid").alias("n_solid"), F.count_if("closed").alias("n_closed"), F.count_if("winding").alias("n_winding"), F.count_if("append").alias("n_append"), F.count_if("effect").alias("n_effect"),
        F.sum("mode").alias("modes"), F.sum("unit").alias("units"), F.sum("value").alias("property_values"), F.sum("_boxes").cast("long").alias("box_sum"), F.sum("_points").cast("long").alias("point_sum"),
    )
