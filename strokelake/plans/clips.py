"""Queries over region trees and clips: orders are trees of their line items' rectangles, events are the steps of a clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.operators import clips

from .registry import query, table

#: Left, top, right and bottom of the surface.
SURFACE = (0, 0, 16, 12)

_LEAVES = """l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, count(*) over (partition by l_orderkey) as n, l_suppkey % 14 as x, l_partkey % 10 as y, cast(l_quantity as bigint) % 9 + 1 as w, l_linenumber % 5 + 2 as h,
  case l_partkey % 11 when 0 then 'infinite' when 1 then 'empty' else 'rect' end as kind, 1 + (l_partkey + l_linenumber) % 5 as op from lineitem)"""
_OPS = "case {op} when 1 then {a} * {b} when 2 then greatest({a}, {b}) when 3 then ({a} + {b}) % 2 when 4 then {a} * (1 - {b}) else (1 - {a}) * {b} end"


def _moments(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Area and sums of the places of all cells, as whole numbers."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    total = lambda a, b: (F.col(b) * (F.col(b) - 1) - F.col(a) * (F.col(a) - 1)) / 2
    return spans.groupBy(*keys).agg(F.sum(w * h).cast("long").alias("area"), F.sum(total("x0", "x1") * h).cast("long").alias("sum_x"), F.sum(total("y0", "y1") * w).cast("long").alias("sum_y"))


@query(f"""with {_LEAVES}, g as (select k, i, n, op, x, y, w, h, kind from l), cells as (select cx, cy from (select unnest(range(0, 16)) as cx) a cross join (select unnest(range(0, 12)) as cy) b),
 c as (select k, cx, cy, list(op * 2 + case kind when 'infinite' then 1 when 'empty' then 0 else case when cx >= x and cx < x + w and cy >= y and cy < y + h then 1 else 0 end end order by i) as s from g cross join cells group by k, cx, cy),
 v as (select k, cx, cy, case when k % 2 = 0 then list_reduce(s, lambda a, b: {_OPS.format(op='(b // 2)', a='(a % 2)', b='(b % 2)')})
  else list_reduce(list_reverse(list_transform(range(1, len(s) + 1), lambda j: case when j < len(s) then s[j + 1] // 2 * 2 + s[j] % 2 else s[j] % 2 end)), lambda a, b: {_OPS.format(op='(b // 2)', a='(b % 2)', b='(a % 2)')}) end % 2 as inside from c)
 select k as o_orderkey, count(*) as area, cast(sum(cx) as bigint) as sum_x, cast(sum(cy) as bigint) as sum_y from v where inside = 1 group by k""")
def region_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's line items as leaves of a tree in preorder: even orders lean to the left, odd ones to the right."""
    rank = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"
    leaves = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as k", f"{rank} as i", "count(*) over (partition by l_orderkey) as n", "l_suppkey % 14 as left", "l_partkey % 10 as top", "cast(l_quantity as bigint) % 9 + 1 as w", "l_linenumber % 5 + 2 as h", "l_partkey % 11 as kind", "cast(1 + (l_partkey + l_linenumber) % 5 as int) as op")
    left = F.col("k") % 2 == 0
    n, i = F.col("n"), F.col("i")
    kind = F.when(F.col("kind") == 0, clips.INFINITE).when(F.col("kind") == 1, clips.EMPTY).otherwise(clips.RECT)
    leaf = F.struct(F.when(left, n + i - 2).when(i < n, 2 * i - 1).otherwise(2 * i - 2).alias("node"), kind.alias("type"), "left", "top", (F.col("left") + F.col("w")).alias("right"), (F.col("top") + F.col("h")).alias("bottom"))
    none = F.lit(None).cast("long")
    branch = F.struct(F.when(left, n - i).otherwise(2 * i - 4).alias("node"), F.col("op").alias("type"), none.alias("left"), none.alias("top"), none.alias("right"), none.alias("bottom"))
    nodes = leaves.select("k", F.explode(F.when(i > 1, F.array(leaf, branch)).otherwise(F.array(leaf))).alias("v")).select(F.col("k").alias("o_orderkey"), "v.*")
    spans, _ = clips.evaluate_trees(nodes, ["o_orderkey"], SURFACE)
    return _moments(spans, ["o_orderkey"])


_STEPS = """case event_type when 'signup' then 'union' when 'view' then case event_id % 3 when 0 then 'intersect' else 'xor' end when 'click' then case event_id % 7 when 0 then 'replace' else 'difference' end
 when 'purchase' then case event_id % 5 when 0 then 'complement' when 1 then 'meta' else 'union' end else case event_id % 4 when 0 then 'offset' when 1 then 'reset' when 2 then 'offset' else null end end"""


@query(f"""with e as (select event_id // 24 as file, event_id, {_STEPS} as op, event_id * 7 % 13 as x, event_id * 5 % 9 as y, event_id % 8 + 2 as w, event_id % 6 + 2 as h, event_id % 5 - 2 as dx, event_id % 3 - 1 as dy from events),
 p as (select *, coalesce(sum(case when op = 'meta' then 1 else 0 end) over (partition by file order by event_id rows between unbounded preceding and 1 preceding), 0) as part from e),
 s as (select *, coalesce(sum(case when op = 'offset' then dx else 0 end) over w, 0) as sx, coalesce(sum(case when op = 'offset' then dy else 0 end) over w, 0) as sy from p window w as (partition by file, part order by event_id rows between 1 following and unbounded following)),
 cells as (select cx, cy from (select unnest(range(0, 16)) as cx) a cross join (select unnest(range(0, 12)) as cy) b),
 c as (select file, cx, cy, list_concat([3], list(case op when 'replace' then 2 when 'intersect' then 4 when 'union' then 6 when 'xor' then 8 when 'difference' then 10 when 'complement' then 12 when 'reset' then 14 when 'meta' then 16 else 18 end + case when cx >= x + sx and cx < x + w + sx and cy >= y + sy and cy < y + h + sy then 1 else 0 end order by event_id)) as s from s cross join cells group by file, cx, cy),
 v as (select file, cx, cy, list_reduce(s, lambda m, b: case b // 2 when 1 then m // 2 * 2 + b % 2 when 2 then m // 2 * 2 + (m % 2) * (b % 2) when 3 then m // 2 * 2 + greatest(m % 2, b % 2) when 4 then m // 2 * 2 + (m + b) % 2 when 5 then m // 2 * 2 + (m % 2) * (1 - b % 2) when 6 then m // 2 * 2 + (1 - m % 2) * (b % 2) when 7 then m // 2 * 2 + 1 when 8 then (m // 2) * (m % 2) * 2 + 1 else m end) as m from c)
 select file, count(*) as area, cast(sum(cx) as bigint) as sum_x, cast(sum(cy) as bigint) as sum_y from v where m = 3 group by file""")
def ordered_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clip that 24 steps leave: operations that don't commute, offsets and metaregions."""
    e = table(spark, sf_dir, "events").selectExpr("event_id div 24 as file", "event_id", f"{_STEPS} as op", "event_id * 7 % 13 as left", "event_id * 5 % 9 as top", "event_id * 7 % 13 + event_id % 8 + 2 as right", "event_id * 5 % 9 + event_id % 6 + 2 as bottom", "event_id % 5 - 2 as dx", "event_id % 3 - 1 as dy")
    spans, _ = clips.clip_spans(e, ["file"], "event_id", SURFACE)
    return _moments(spans, ["file"])
