"""Queries over points, matrices and regions, all native."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import geometry
from strokelake.operators import regions

from .registry import query, table


@query("""select l_returnflag, l_linestatus, round(sum(round(l_quantity * 0.5 + l_extendedprice * -0.25 + 3, 6)), 3) as sum_x, round(sum(round(l_quantity * 0.125 + l_extendedprice * 2 - 7, 6)), 3) as sum_y from lineitem group by l_returnflag, l_linestatus""")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = {k: F.lit(v) for k, v in {"m11": 0.5, "m12": 0.125, "m21": -0.25, "m22": 2.0, "dx": 3.0, "dy": -7.0}.items()}
    x, y = geometry.apply(m, F.col("l_quantity"), F.col("l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"))


@query("""with p as (select p_partkey as k, p_size / 10.0::double as a, p_retailprice / 1000 as b, c_acctbal / 100 as c, c_nationkey::double as d from part join customer on p_partkey = c_custkey)
 select k, round(a * d + b * 2, 6) as m11, round(a * 1 + b * a, 6) as m12, round(c * d + d * 2, 6) as m21, round(c * 1 + d * a, 6) as m22, round(a * d + b * 2 + c, 6) as dx, round(a * 1 + b * a + b, 6) as dy from p""")
def matrix_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").join(table(spark, sf_dir, "customer"), F.col("p_partkey") == F.col("c_custkey"))
    p = p.select(F.col("p_partkey").alias("k"), (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 1000).alias("b"), (F.col("c_acctbal") / 100).alias("c"), F.col("c_nationkey").cast("double").alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    out = geometry.then({"m11": a, "m12": b, "m21": c, "m22": d, "dx": a, "dy": b}, {"m11": d, "m12": F.lit(1.0), "m21": F.lit(2.0), "m22": a, "dx": c, "dy": b})
    return p.select("k", *[F.round(v, 6).alias(name) for name, v in out.items()])


@query("""with o as (select o_orderkey, o_orderkey % 8 + 1 as mode, o_custkey % 7 + 1 as ex, -(o_custkey % 5 + 1) as ey from orders),
 s as (select o_orderkey, mode, case when mode = 1 then 1.0 when mode = 2 then 3.78 / 10.0 when mode = 3 then 3.78 / 100.0 when mode = 4 then 3.78 / (100 / 25.4) when mode = 5 then 3.78 / (1000 / 25.4) when mode = 6 then 3.78 / (1440 / 25.4) else ex end::double as x,
 case when mode = 1 then 1.0 when mode = 2 then -3.78 / 10.0 when mode = 3 then -3.78 / 100.0 when mode = 4 then -3.78 / (100 / 25.4) when mode = 5 then -3.78 / (1000 / 25.4) when mode = 6 then -3.78 / (1440 / 25.4) else ey end::double as y from o)
 select o_orderkey, mode, round(case when mode = 7 then sign(x) * least(abs(x), abs(y)) else x end, 6) as sx, round(case when mode = 7 then sign(y) * least(abs(x), abs(y)) else y end, 6) as sy from s""")
def map_mode_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.col("o_orderkey") % 8 + 1
    sx, sy = geometry.mode_scale(mode, F.lit(3.78), ((F.col("o_custkey") % 7 + 1).cast("double"), (-(F.col("o_custkey") % 5 + 1)).cast("double")))
    return table(spark, sf_dir, "orders").select("o_orderkey", mode.alias("mode"), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


@query("""with o as (select o_orderkey, o_orderkey % 8 + 1 as mode, (o_custkey % 7 + 1)::double as ex, -(o_custkey % 5 + 1)::double as ey, 3.0 + o_custkey % 3 as px, 2.5 + o_orderkey % 4 as py from orders),
 s as (select *, case mode when 2 then 10 when 3 then 100 when 4 then 100 / 25.4 when 5 then 1000 / 25.4 when 6 then 1440 / 25.4 end as u from o),
 v as (select o_orderkey, mode, px::double as px, py::double as py, case when mode = 1 then 1 when mode <= 6 then px / u else ex end::double as x, case when mode = 1 then 1 when mode <= 6 then -py / u else ey end::double as y from s)
 select o_orderkey, mode, round(case when mode = 7 and abs(x) / px > abs(y) / py then sign(x) * abs(y) / py * px else x end, 6) as sx, round(case when mode = 7 and abs(y) / py > abs(x) / px then sign(y) * abs(x) / px * py else y end, 6) as sy from v""")
def map_mode_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping modes on devices whose pixels aren't square: the isotropic mode compares physical sizes."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sx, sy = geometry.mode_scale(k % 8 + 1, (3.0 + c % 3, 2.5 + k % 4), ((c % 7 + 1).cast("double"), (-(c % 5 + 1)).cast("double")))
    return table(spark, sf_dir, "orders").select("o_orderkey", (k % 8 + 1).alias("mode"), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


@query("""with o as (select o_orderkey, o_custkey % 40 + 10 as rx, o_orderkey % 30 + 5 as ry, o_orderkey % 97 - 48 as xs, o_orderkey % 89 - 44 as ys, o_custkey % 83 - 41 as xe, o_custkey % 79 - 39 as ye from orders),
 a as (select o_orderkey, atan2(-(ys - 3) * rx, (xs - 2) * ry) as a, atan2(-(ye - 3) * rx, (xe - 2) * ry) as e from o)
 select o_orderkey, round(a, 6) as start, round(case when o_orderkey % 2 = 0 then case when e - a <= 0 then e - a + 2 * pi() else e - a end else case when e - a >= 0 then e - a - 2 * pi() else e - a end end, 6) as sweep from a""")
def arc_sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start angle and sweep of arcs around (2, 3), with and against the clock."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rx, ry = c % 40 + 10, k % 30 + 5
    start = geometry.arc_angle(k % 97 - 48, k % 89 - 44, F.lit(2), F.lit(3), rx, ry)
    end = geometry.arc_angle(c % 83 - 41, c % 79 - 39, F.lit(2), F.lit(3), rx, ry)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(start, 6).alias("start"), F.round(geometry.arc_sweep(start, end, k % 2 == 0), 6).alias("sweep"))


@query("""with o as (select o_orderkey, abs(o_custkey - o_orderkey % 1000) * 72 / 2540.0::double as w, abs(cast(floor(o_totalprice) as bigint) % 1000) * 72 / 2540.0::double as h from orders)
 select o_orderkey, round(case when w > 0 and h > 0 then w end, 6) as width, round(case when w > 0 and h > 0 then h end, 6) as height from o""")
def physical_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geometry.points_of_frame(F.col("o_orderkey") % 1000, F.lit(0), F.col("o_custkey"), F.floor("o_totalprice") % 1000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(w, 6).alias("width"), F.round(h, 6).alias("height"))


_RECTS = "select l_returnflag as g, l_partkey % 40 as x, l_suppkey % 30 as y, cast(l_quantity as bigint) % 9 + 1 as w, l_linenumber % 6 + 1 as h, l_linenumber % 2 as side from lineitem"
_CELLS = f"cells as (select distinct g, side, unnest(range(x, x + w)) as cx, y, h from ({_RECTS})), grid as (select distinct g, side, cx, unnest(range(y, y + h)) as cy from cells)"


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_partkey") % 40).alias("left"), (F.col("l_suppkey") % 30).alias("top"), (F.col("l_quantity").cast("long") % 9 + 1).alias("w"), (F.col("l_linenumber") % 6 + 1).alias("h"), (F.col("l_linenumber") % 2).alias("side"))
    return rows.select("g", "left", "top", (F.col("left") + F.col("w")).alias("right"), (F.col("top") + F.col("h")).alias("bottom"), "side").distinct()


@query(f"""with {_CELLS}, a as (select distinct g, cx, cy from grid where side = 0), b as (select distinct g, cx, cy from grid where side = 1),
 j as (select coalesce(a.g, b.g) as g, a.cx is not null as ina, b.cx is not null as inb from a full join b on a.g = b.g and a.cx = b.cx and a.cy = b.cy)
 select op, g, cells from (select 'intersect' as op, g, count(*) filter (ina and inb) as cells from j group by g union all select 'union', g, count(*) from j group by g union all select 'xor', g, count(*) filter (ina <> inb) from j group by g union all select 'difference', g, count(*) filter (ina and not inb) from j group by g)""")
def region_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = _rects(spark, sf_dir)
    a, b = (regions.scan_lines(rects.filter(F.col("side") == s), ["g"]) for s in (0, 1))
    groups, out = rects.select("g").distinct(), None
    for op in ("intersect", "union", "xor", "difference"):
        cells = regions.combine(a, b, ["g"], op).groupBy("g").agg(F.sum(F.col("x1") - F.col("x0")).alias("cells"))
        part = groups.join(cells, "g", "left").select(F.lit(op).alias("op"), "g", F.coalesce("cells", F.lit(0)).alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""with r as (select l_returnflag as g, l_orderkey as x, l_partkey as y, cast(l_quantity as bigint) % 9 + 3 as w, l_linenumber % 6 + 3 as h from lineitem),
 cells as (select distinct g, unnest(range(x, x + w)) as cx, y, h from r), grid as (select distinct g, cx, unnest(range(y, y + h)) as cy from cells),
 side as (select unnest([-1, 0, 1]) as d), box as (select a.d as dx, b.d as dy from side a cross join side b), around as (select g, cx, cy, cx + dx as nx, cy + dy as ny from grid cross join box),
 near as (select around.g, around.cx, around.cy, count(*) as n from around join grid b on around.g = b.g and around.nx = b.cx and around.ny = b.cy group by around.g, around.cx, around.cy)
 select g, count(*) filter (n < 9) as cells from near group by g""")
def region_frame_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame, one cell wide, of the union of a rectangle for each line item, on a plane that grows with the table."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_orderkey").alias("left"), F.col("l_partkey").alias("top"), (F.col("l_quantity").cast("long") % 9 + 3).alias("w"), (F.col("l_linenumber") % 6 + 3).alias("h"))
    rects = rows.select("g", "left", "top", (F.col("left") + F.col("w")).alias("right"), (F.col("top") + F.col("h")).alias("bottom"))
    return regions.frame_boxes(rects, ["g"], 1, 1).groupBy("g").agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("cells"))


@query("""with t as (select o_orderkey as k, (o_orderkey % 50)::double as ax, (o_custkey % 40)::double as ay, (o_custkey % 60 + 5)::double as bx, (o_orderkey % 45 + 3)::double as "by", (o_orderkey % 30)::double as cx, (o_custkey % 70 + 10)::double as cy from orders),
 e as (select k, ax as x0, ay as y0, bx as x1, "by" as y1 from t union all select k, bx, "by", cx, cy from t union all select k, cx, cy, ax, ay from t),
 l as (select k, y, x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0) as x from (select *, unnest(range(cast(ceil(least(y0, y1) - 0.5) as bigint), cast(ceil(greatest(y0, y1) - 0.5) as bigint))) as y from e where y0 <> y1)),
 s as (select k, y, x, row_number() over (partition by k, y order by x) as n, lead(x) over (partition by k, y order by x) as nx from l)
 select k, count(*) as n_spans, round(sum(nx - x), 4) as covered from s where n % 2 = 1 and nx is not null group by k""")
def coverage_scanlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles from orders as even-odd spans at the middle of each scan line."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    corner = {"a": (k % 50, c % 40), "b": (c % 60 + 5, k % 45 + 3), "c": (k % 30, c % 70 + 10)}
    t = table(spark, sf_dir, "orders").select(k.alias("k"), *[v.cast("double").alias(f"{n}{axis}") for n, (x, y) in corner.items() for axis, v in (("x", x), ("y", y))])
    sides = F.array(*[F.struct(F.col(f"{p}x").alias("x0"), F.col(f"{p}y").alias("y0"), F.col(f"{q}x").alias("x1"), F.col(f"{q}y").alias("y1")) for p, q in ("ab", "bc", "ca")])
    edges = t.select("k", F.inline(sides)).filter("y0 <> y1")
    return regions.even_odd_totals(edges, ["k"]).select("k", "n_spans", F.round("covered", 4).alias("covered"))


@query("""select p_partkey, v.t as triangle, round(abs((v.bx - v.ax) * (v.cy - v.ay) - (v.cx - v.ax) * (v."by" - v.ay)) / 2, 4) as area from (select p_partkey, unnest([
 {'t': 0, 'ax': l, 'ay': 0.0, 'bx': r, 'by': 0.0, 'cx': l, 'cy': b}, {'t': 1, 'ax': r, 'ay': 0.0, 'bx': r, 'by': b, 'cx': l, 'cy': b}]) as v from (select p_partkey, p_size::double as l, p_size + p_retailprice / 10 as r, (p_partkey % 50 + 1)::double as b from part))""")
def gradient_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient rectangles as two triangles each."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("l"), (F.col("p_size") + F.col("p_retailprice") / 10).alias("r"), (F.col("p_partkey") % 50 + 1).cast("double").alias("b"))
    zero, l, r, b = F.lit(0.0), F.col("l"), F.col("r"), F.col("b")
    made = [((l, zero), (r, zero), (l, b)), ((r, zero), (r, b), (l, b))]
    area = lambda t: F.abs((t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[2][0] - t[0][0]) * (t[1][1] - t[0][1])) / 2
    rows = F.array(*[F.struct(F.lit(i).alias("triangle"), F.round(area(t), 4).alias("area")) for i, t in enumerate(made)])
    return p.select("p_partkey", F.inline(rows))


_SHAPE = """(o_orderkey % 50)::double as x0, (o_custkey % 40)::double as y0, (o_orderkey % 37 - 20)::double as x1, (o_custkey % 53 + 10)::double as y1, (o_custkey % 47 + 20)::double as x2, (o_orderkey % 29 - 30)::double as y2, (o_custkey % 61 + 5)::double as x3, (o_orderkey % 43 + 3)::double as y3"""
_AT = "({p}0 * (1 - {t}) * (1 - {t}) * (1 - {t}) + {p}1 * (3 * (1 - {t}) * (1 - {t}) * {t}) + {p}2 * (3 * (1 - {t}) * {t} * {t}) + {p}3 * {t} * {t} * {t})"


@query(f"""with o as (select o_orderkey as k, {_SHAPE} from orders), c as (select * from o union all select k, x3, y3, x1 + 15, y1 - 25, x0 - 15, y0 + 35, x0, y0 from o),
 i as (select *, unnest(range(0, 16)) as i from c), p as (select *, i / 16.0::double as t, (i + 1) / 16.0::double as s from i),
 e as (select k, {_AT.format(p='x', t='t')} as xa, {_AT.format(p='y', t='t')} as ya, {_AT.format(p='x', t='s')} as xb, {_AT.format(p='y', t='s')} as yb from p),
 l as (select k, y, xa + (y + 0.5 - ya) * (xb - xa) / (yb - ya) as x, case when yb > ya then 1 else -1 end as d from (select *, unnest(range(cast(ceil(least(ya, yb) - 0.5) as bigint), cast(ceil(greatest(ya, yb) - 0.5) as bigint))) as y from e where ya <> yb)),
 s as (select k, y, x, sum(d) over w as n, lead(x) over (partition by k, y order by x) as nx from (select k, y, x, sum(d) as d from l group by k, y, x) window w as (partition by k, y order by x rows unbounded preceding))
 select k as o_orderkey, count(distinct y) as n_lines, round(sum(nx - x), 3) as covered from s where n <> 0 and nx is not null group by k""")
def curve_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two curves an order that close and often cross: flattened, and filled by the non-zero rule."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first = [k % 50, c % 40, k % 37 - 20, c % 53 + 10, c % 47 + 20, k % 29 - 30, c % 61 + 5, k % 43 + 3]
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[v.cast("double").alias(f"{'xy'[i % 2]}{i // 2}") for i, v in enumerate(first)])
    back = o.select("o_orderkey", F.col("x3").alias("x0"), F.col("y3").alias("y0"), (F.col("x1") + 15).alias("x1"), (F.col("y1") - 25).alias("y1"), (F.col("x0") - 15).alias("x2"), (F.col("y0") + 35).alias("y2"), F.col("x0").alias("x3"), F.col("y0").alias("y3"))
    return regions.curve_totals(o.unionByName(back), ["o_orderkey"]).select("o_orderkey", "n_lines", F.round("covered", 3).alias("covered"))
