"""Queries over pixels and palettes, all native."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import pixels
from strokelake.operators import paint

from .registry import query, table

_PIXEL = "select l_returnflag, l_partkey % 256 as r, l_suppkey % 256 as g, cast(l_quantity as bigint) * 5 % 256 as b, l_orderkey % 256 as a, l_linenumber from lineitem"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), (F.col("l_quantity").cast("long") * 5 % 256).cast("int").alias("b"), (F.col("l_orderkey") % 256).cast("int").alias("a"), "l_linenumber", "l_orderkey")


@query(f"""with p as ({_PIXEL}), c as (select unnest([0, 15, 51, 60, 85, 90, 102, 136, 165, 187, 192, 204, 226, 240, 238, 255]) as code)
 select code, cast(sum(case when (code >> 7) & 1 = 1 then r & g & b else 0 end | case when (code >> 6) & 1 = 1 then r & g & (255 - b) else 0 end | case when (code >> 5) & 1 = 1 then r & (255 - g) & b else 0 end | case when (code >> 4) & 1 = 1 then r & (255 - g) & (255 - b) else 0 end
 | case when (code >> 3) & 1 = 1 then (255 - r) & g & b else 0 end | case when (code >> 2) & 1 = 1 then (255 - r) & g & (255 - b) else 0 end | case when (code >> 1) & 1 = 1 then (255 - r) & (255 - g) & b else 0 end | case when code & 1 = 1 then (255 - r) & (255 - g) & (255 - b) else 0 end) as bigint) as total from p, c group by code""")
def rop3_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen ternary codes on pattern, source and target bytes."""
    codes = [0, 15, 51, 60, 85, 90, 102, 136, 165, 187, 192, 204, 226, 240, 238, 255]
    rows = _pixels(spark, sf_dir).select(*[pixels.rop3(F.lit(c), F.col("r"), F.col("g"), F.col("b")).alias(str(c)) for c in codes])
    sums = rows.agg(*[F.sum(str(c)).alias(str(c)) for c in codes])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(str(c)).alias("total")) for c in codes])))


@query(f"""with p as ({_PIXEL}) select mode, count(v) as n, cast(sum(v) as bigint) as total from (select unnest([1, 2, 4, 11, 13, 16]) as mode, r, g from p) q, lateral (select case mode when 1 then 0 when 4 then 255 - r when 11 then g when 13 then r when 16 then 255 end as v) group by mode""")
def rop2_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = F.explode(F.array(*[F.lit(m) for m in (1, 2, 4, 11, 13, 16)])).alias("mode")
    rows = _pixels(spark, sf_dir).select("r", "g", modes).withColumn("v", pixels.rop2(F.col("mode"), F.col("r"), F.col("g")))
    return rows.groupBy("mode").agg(F.count("v").alias("n"), F.sum("v").cast("long").alias("total"))


@query("""with v as (select l_returnflag, (l_partkey * 31 + l_suppkey * 7) % 65536 as v from lineitem) select l_returnflag, cast(sum((((v & 63488) >> 11) * 255 + 15) // 31) as bigint) as r, cast(sum((((v & 2016) >> 5) * 255 + 31) // 63) as bigint) as g, cast(sum(((v & 31) * 255 + 15) // 31) as bigint) as b from v group by l_returnflag""")
def mask_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 7) % 65536).alias("v"))
    return rows.groupBy("l_returnflag").agg(*[F.sum(pixels.mask_channel(F.col("v"), m)).alias(c) for c, m in (("r", 0xF800), ("g", 0x07E0), ("b", 0x001F))])


@query(f"""with p as ({_PIXEL}) select l_returnflag, cast(sum(least(255, greatest(0, round((r / 255.0::double * 0.3 + g / 255.0::double * 0.59 + b / 255.0::double * 0.11 + 0.05) * 255)))) as bigint) as gray, cast(sum(least(255, greatest(0, round((r / 255.0::double * -1 + 1.0) * 255)))) as bigint) as negative from p group by l_returnflag""")
def color_matrix_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = [[0.3, -1.0, 0, 0], [0.59, 0, 0, 0], [0.11, 0, 0, 0], [0, 0, 0, 1.0], [0.05, 1.0, 0, 0]]
    gray, negative, _, _ = pixels.color_matrix([F.col(c) for c in "rgba"], matrix)
    return _pixels(spark, sf_dir).groupBy("l_returnflag").agg(F.sum(gray).alias("gray"), F.sum(negative).alias("negative"))


@query(f"""with p as ({_PIXEL}), lut as (select p_partkey - 1 as i, p_size as v from part where p_partkey <= 256) select l_returnflag, cast(sum(coalesce(v, r)) as bigint) as total from p left join lut on r = i group by l_returnflag""")
def lut_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A look-up table, joined by pixel value; Spark broadcasts it where its measured size allows."""
    lut = table(spark, sf_dir, "part").filter("p_partkey <= 256").select((F.col("p_partkey") - 1).cast("int").alias("r"), F.col("p_size").alias("v"))
    rows = _pixels(spark, sf_dir).join(lut, "r", "left")
    return rows.groupBy("l_returnflag").agg(F.sum(F.coalesce("v", "r")).alias("total"))


@query(f"""with p as ({_PIXEL}) select l_returnflag, count(*) filter (greatest(r, g, b) <= a) as valid, count(*) filter (greatest(r, g, b) > a) as malformed from p group by l_returnflag""")
def alpha_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = pixels.alpha_valid(*[F.col(c) for c in "rgba"])
    return _pixels(spark, sf_dir).groupBy("l_returnflag").agg(F.count_if(fine).alias("valid"), F.count_if(~fine).alias("malformed"))


@query(f"""with p as ({_PIXEL}) select l_returnflag, cast(sum((r * a + g * (255 - a) + 127) // 255) as bigint) as total from p group by l_returnflag""")
def blend_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).groupBy("l_returnflag").agg(F.sum(pixels.blend(F.col("r"), F.col("g"), F.col("a"))).alias("total"))


@query("""select l_returnflag, count(p_partkey) as resolved, count(*) - count(p_partkey) as missing, cast(coalesce(sum(p_size), 0) as bigint) as total from (select *, l_orderkey % 5000 as i from lineitem) left join part on i = p_partkey group by l_returnflag""")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette indices to colours; an index beyond the palette finds none."""
    palette = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").alias("color"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") % 5000).alias("i")).join(palette, "i", "left")
    return rows.groupBy("l_returnflag").agg(F.count("color").alias("resolved"), F.count_if(F.col("color").isNull()).alias("missing"), F.coalesce(F.sum("color"), F.lit(0)).alias("total"))


@query("""select p_partkey, case when p_partkey % 4 = 0 and p_size % 2 = 1 then p_partkey % 97 else p_size end as color from part""")
def palette_animate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animation changes the entries given to it that are flagged as reserved, and no others."""
    old = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("old"), (F.col("p_size") % 2).alias("flags"))
    new = table(spark, sf_dir, "part").filter("p_partkey % 4 = 0").select("p_partkey", (F.col("p_partkey") % 97).alias("new"))
    return old.join(new, "p_partkey", "left").select("p_partkey", F.coalesce(F.when(F.col("flags") == 1, F.col("new")), F.col("old").cast("long")).alias("color"))


@query("""with v as (select o_orderkey, o_orderkey * 40503 % 16777216 + (o_custkey % 3) * 16777216 as v from orders) select o_orderkey, case when v >> 24 in (0, 2) then v & 255 end as r, case when v >> 24 in (0, 2) then (v >> 8) & 255 end as g, case when v >> 24 in (0, 2) then (v >> 16) & 255 end as b from v""")
def colorref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("o_orderkey") * 40503 % 16777216 + F.col("o_custkey") % 3 * 16777216
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(c) for c, v in pixels.colorref(value).items()])


_GRID = "select event_id % 200 as x, event_id // 200 as y, cast(floor(value) as bigint) % 256 as v, cast(floor(value * 1.02) as bigint) % 256 as w from events"


@query(f"""with g as ({_GRID}), n as (select a.x, a.y, a.w as v, min(b.v) as lo, max(b.v) as hi from g a join g b on b.x between a.x - 1 and a.x + 1 and b.y between a.y - 1 and a.y + 1 group by all)
 select y, count(*) filter (v < lo - 3 or v > hi + 3) as mismatched, count(*) as pixels from n group by y""")
def neighborhood_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of one image outside the range of the other's 3 x 3 neighbourhood by more than 3."""
    v, w = F.floor("value") % 256, F.floor(F.col("value") * 1.02) % 256
    g = table(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("x"), F.floor(F.col("event_id") / 200).alias("y"), v.alias("v"), w.alias("w"))
    # Each pixel is sent to its nine neighbours: a group-by instead of a join.
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    sent = g.select("x", "y", "v", "w", F.explode(shifts).alias("s"))
    own = F.when((F.col("s.dx") == 0) & (F.col("s.dy") == 0), F.col("w"))
    near = sent.groupBy((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(own).alias("own"))
    near = near.filter("own is not null")
    return near.groupBy("y").agg(F.count_if((F.col("own") < F.col("lo") - 3) | (F.col("own") > F.col("hi") + 3)).alias("mismatched"), F.count(F.lit(1)).alias("pixels"))


_STOPS = "[{'at': 0.0::double, 'r': p_partkey % 256, 'g': p_size * 5, 'b': 10}, {'at': 0.25 + p_size % 3 * 0.125, 'r': 255 - p_partkey % 200, 'g': 40, 'b': p_partkey % 97}, {'at': 0.25 + p_size % 3 * 0.125, 'r': 7, 'g': 200, 'b': p_size * 3}, {'at': 1.0::double, 'r': p_partkey % 50, 'g': 255, 'b': 128}]"


@query(f"""with b as (select p_partkey, (1 + p_partkey % 3)::double as a, (p_partkey % 2)::double as b, (-(p_partkey % 2))::double as c, (1 + p_size % 2)::double as d, (p_size % 7)::double as e, (p_partkey % 5)::double as f, (p_size % 4)::double as x0, (3 + p_partkey % 6)::double as w, p_partkey % 5 as mode, {_STOPS} as stops from part),
 p as (select *, unnest(range(0, 96)) as i from b), q as (select *, i % 12 + 0.5::double as x, i // 12 + 0.5::double as y, a * d - b * c as det from p),
 t as (select *, (x * (d / det) + y * (-c / det) + -(e * (d / det) + f * (-c / det))) / w - x0 / w as raw from q),
 u as (select *, case when mode = 4 then greatest(0.0, least(1.0, raw)) when mode in (1, 3) then case when raw - 2 * floor(raw / 2) > 1 then 2 - (raw - 2 * floor(raw / 2)) else raw - 2 * floor(raw / 2) end else raw - floor(raw) end as v from t),
 s as (select *, list_filter(stops, lambda s: s.at <= v)[-1] as low, coalesce(list_filter(stops, lambda s: s.at > v)[1], list_filter(stops, lambda s: s.at <= v)[-1]) as high from u),
 m as (select *, case when high.at > low.at then (v - low.at) / (high.at - low.at) else 0.0 end as part from s)
 select p_partkey, """ + ", ".join(f"cast(sum(cast(floor(low.{c} + (high.{c} - low.{c}) * part + 0.5) as bigint) * (1 + i % 7)) as bigint) as {n}" for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))) + " from m group by p_partkey")
def linear_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brush for each part over 96 pixels: its matrix is inverted, the parameter wrapped in five ways and looked up among four stops."""
    k, size = F.col("p_partkey"), F.col("p_size")
    brush = {"a": 1 + k % 3, "b": k % 2, "c": -(k % 2), "d": 1 + size % 2, "e": size % 7, "f": k % 5, "x": size % 4, "width": 3 + k % 6}
    number = lambda v, kind: (F.lit(v) if isinstance(v, int | float) else v).cast(kind)
    stop = lambda at, r, g, b: F.struct(number(at, "double"), number(r, "long"), number(g, "long"), number(b, "long")).cast("struct<at:double,r:bigint,g:bigint,b:bigint>")
    middle = 0.25 + size % 3 * 0.125
    stops = F.array(stop(0.0, k % 256, size * 5, 10), stop(middle, 255 - k % 200, 40, k % 97), stop(middle, 7, 200, size * 3), stop(1.0, k % 50, 255, 128))
    rows = paint.linear_gradients(table(spark, sf_dir, "part").select("p_partkey", *[v.cast("double").alias(n) for n, v in brush.items()], (k % 5).alias("mode"), stops.alias("stops")), ["p_partkey"], 12, 8)
    weight = 1 + (F.col("py") * 12 + F.col("px")) % 7
    return rows.groupBy("p_partkey").agg(*[F.sum(F.col(c).cast("long") * weight).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
