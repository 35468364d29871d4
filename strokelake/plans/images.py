"""Queries over bitmaps: the bytes of whole documents stand for the pixels of an image of every depth and header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary, dib

from .registry import query, table

#: Depth, header, width and order of lines go by the document's id; lines are as many as the bytes fill.
_IMAGE = """d as (select doc_id, hex(encode(coalesce(text, ''))) as hx, octet_length(encode(coalesce(text, ''))) as n, case doc_id % 6 when 0 then 1 when 1 then 4 when 2 then 8 when 3 then 16 when 4 then 24 else 32 end as bits, 1 + doc_id % 37 as w,
  case when doc_id % 6 in (3, 5) then case doc_id % 4 when 0 then 40 when 1 then 108 else 124 end else case doc_id % 4 when 0 then 12 when 1 then 40 when 2 then 108 else 124 end end as hs from documents),
 i as (select *, (w * bits + 31) // 32 * 4 as stride, hs <> 12 and doc_id % 5 = 0 as down, bits in (16, 32) and doc_id % 7 < 3 as fields from d), j as (select *, cast(ceil(n / stride) as bigint) as h from i where n > 0)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    pick = lambda of, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (of + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"), pick(k % 6, 1, 4, 8, 16, 24, 32).alias("bits"), (1 + k % 37).alias("w"))
    masked = F.col("bits").isin(16, 32)
    d = d.withColumn("hs", F.when(masked, pick(k % 4, 40, 108, 124, 124)).otherwise(pick(k % 4, 12, 40, 108, 124)))
    d = d.withColumn("stride", F.floor((F.col("w") * F.col("bits") + 31) / 32) * 4).withColumn("h", F.ceil(F.octet_length("bytes") / F.col("stride")))
    d = d.withColumns({"down": (F.col("hs") != 12) & (k % 5 == 0), "fields": masked & (k % 7 < 3)})
    n = lambda v, width=4: binary.little(v if isinstance(v, Column) else F.lit(v), width)
    core = F.concat(n(12), n(F.col("w"), 2), n(F.col("h"), 2), n(1, 2), n(F.col("bits"), 2))
    masks = [F.when(F.col("bits") == 16, a).otherwise(b) for a, b in ((0xF800, 0x3FF00000), (0x7E0, 0xFFC00), (0x1F, 0x3FF))]
    masks = F.concat(*[n(m) for m in masks])
    head = F.concat(n(F.col("hs")), n(F.col("w")), n(F.when(F.col("down"), -F.col("h")).otherwise(F.col("h"))), n(1, 2), n(F.col("bits"), 2), n(F.when(F.col("fields"), 3).otherwise(0)), *[n(0)] * 5)
    # Behind 40 bytes: three masks of bit fields, which longer headers hold themselves, with an alpha mask behind them.
    alpha = F.when(F.col("fields"), F.when(F.col("bits") == 32, 0xC0000000).otherwise(0)).otherwise(F.when(F.col("bits") == 32, 0xFF000000).otherwise(0))
    behind = F.when(F.col("hs") == 40, F.when(F.col("fields"), masks).otherwise(F.lit(b""))).otherwise(F.rpad(F.concat(F.when(F.col("fields"), masks).otherwise(F.lit(bytes(12))), n(alpha)), (F.col("hs") - 40).cast("int"), F.lit(b"\0")))
    colors = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), F.least("bits", F.lit(8))).cast("int") - 1), lambda i: F.concat(*[F.lpad(F.hex(((i * a + k) % 256).cast("long")), 2, "0") for a in (7, 11, 13)], F.when(F.col("hs") == 12, "").otherwise("00"))), ""))
    palette = F.when(F.col("bits") <= 8, colors).otherwise(F.lit(b""))
    data = F.rpad("bytes", (F.col("stride") * F.col("h")).cast("int"), F.lit(b"\0"))
    return d.select("doc_id", F.concat(F.when(F.col("hs") == 12, core).otherwise(F.concat(head, behind)), palette, data).alias("content"))


_BYTE = "((instr('0123456789ABCDEF', substr(hx, 2 * ({i}) + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hx, 2 * ({i}) + 2, 1)) - 1)"


@query(rf"""with {_IMAGE}, l as (select *, unnest(range(h)) as y from j), q as (select * exclude (hx), rpad(substr(hx, 2 * stride * case when down then y else h - 1 - y end + 1, 2 * stride), cast(2 * stride as int), '0') as hx from l), p as (select *, unnest(range(w)) as x from q),
 b as (select *, case bits when 1 then x // 8 when 4 then x // 2 else x * (bits // 8) end as o from p),
 v as (select *, {_BYTE.format(i='o')} as b0, case when bits >= 16 then {_BYTE.format(i='o + 1')} end as b1, case when bits >= 24 then {_BYTE.format(i='o + 2')} end as b2, case when bits = 32 then {_BYTE.format(i='o + 3')} end as b3 from b),
 k as (select *, case bits when 1 then b0 // (1 << (7 - x % 8)) % 2 when 4 then case x % 2 when 0 then b0 // 16 else b0 % 16 end when 8 then b0 when 16 then b0 + 256 * b1 when 32 then b0 + 256 * b1 + 65536 * b2 + 16777216 * b3 end as v from v),
 c as (select doc_id, x, y, case when bits <= 8 then (v * 13 + doc_id) % 256 when bits = 24 then b2 when bits = 16 and fields then ((v // 2048) * 255 + 15) // 31 when bits = 16 then ((v // 1024 % 32) * 255 + 15) // 31 when fields then ((v // 1048576 % 1024) * 255 + 511) // 1023 else b2 end as r,
  case when bits <= 8 then (v * 11 + doc_id) % 256 when bits = 24 then b1 when bits = 16 and fields then ((v // 32 % 64) * 255 + 31) // 63 when bits = 16 then ((v // 32 % 32) * 255 + 15) // 31 when fields then ((v // 1024 % 1024) * 255 + 511) // 1023 else b1 end as g,
  case when bits <= 8 then (v * 7 + doc_id) % 256 when bits = 24 then b0 when bits = 16 then ((v % 32) * 255 + 15) // 31 when fields then ((v % 1024) * 255 + 511) // 1023 else b0 end as b,
  case when bits = 32 and hs > 40 then case when fields then (v // 1073741824 * 255 + 1) // 3 else b3 end else 255 end as a from k)
 select doc_id, count(*) as n_pixels, cast(sum(r * (1 + (x + 7 * y) % 11)) as bigint) as red, cast(sum(g * (1 + (x + 7 * y) % 11)) as bigint) as green, cast(sum(b * (1 + (x + 7 * y) % 11)) as bigint) as blue, cast(sum(a * (1 + (x + 7 * y) % 11)) as bigint) as alpha from c group by doc_id""")
def dib_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of bitmaps of all depths, headers, masks and orders of lines; sums weigh each pixel by its place."""
    rows = dib.pixel_rows(_images(spark, sf_dir), ["doc_id"])
    pixels = rows.select("doc_id", "y", F.posexplode("colors").alias("x", "v"))
    weight = 1 + (F.col("x") + 7 * F.col("y")) % 11
    part = lambda shift: F.sum(F.shiftright("v", shift).bitwiseAND(F.lit(255).cast("long")) * weight)
    return pixels.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pixels"), *[part(s).alias(c) for c, s in (("red", 16), ("green", 8), ("blue", 0), ("alpha", 24))])
