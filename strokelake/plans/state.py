"""Queries over ordered state: each user's events stand for the records of one file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.operators import state

from .registry import query, table

KEYS, ORDER = ["user_id"], ["event_id"]


@query("""select user_id, event_id, last_value(case when event_type = 'purchase' then cast(floor(value) as bigint) end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as color from events""")
def state_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "purchase", F.floor("value").cast("long"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", state.carry(delta, KEYS, ORDER).alias("color"))


@query("""with e as (select user_id, event_id, case event_type when 'signup' then 'save' when 'error' then 'restore' when 'purchase' then 'set' else 'draw' end as op, cast(floor(value) as bigint) as v, row_number() over (partition by user_id order by event_id) as k from events),
 s as (select *, sum(case op when 'save' then 1 when 'restore' then -1 else 0 end) over (partition by user_id order by k) as raw from e),
 d as (select *, raw - least(0, min(raw) over (partition by user_id order by k)) as depth from s),
 live as (select r.user_id, r.k, max(t.k) as at from d r join d t on t.user_id = r.user_id and t.op = 'set' and t.k <= r.k and not exists (select 1 from d q where q.user_id = r.user_id and q.k > t.k and q.k <= r.k and q.depth < t.depth) group by r.user_id, r.k)
 select d.user_id, d.event_id, coalesce(t.v, 0) as state, cast(d.depth as int) as depth from d left join live on live.user_id = d.user_id and live.k = d.k left join d t on t.user_id = d.user_id and t.k = live.at""")
def save_restore_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "signup", "save").when(kind == "error", "restore").when(kind == "purchase", "set").otherwise("draw").alias("op"), F.floor("value").cast("long").alias("v"))
    return state.save_restore(e, KEYS, "event_id", "op", "v").select("user_id", "event_id", "state", "depth")


#: Saves, restores by a level that counts back or from the first, and values.
_LEVELS = "case when event_type in ('signup', 'view') then 'save' when event_type = 'error' then 'restore' when event_type = 'purchase' then 'set' else 'draw' end as op, cast(floor(value) as bigint) as v, case event_id % 5 when 0 then -2 when 1 then 1 + event_id // 5 % 3 when 2 then -3 else -1 end as level"


@query(f"""with recursive e as (select user_id, event_id, {_LEVELS}, row_number() over (partition by user_id order by event_id) as k from events),
 r(user_id, k, event_id, state, stack, fault) as (select user_id, cast(0 as bigint), cast(null as bigint), cast(0 as bigint), cast([] as bigint[]), cast(null as varchar) from e where k = 1
  union all select e.user_id, e.k, e.event_id,
   case when op = 'set' then v when op = 'restore' and len(stack) > 0 and case when level < 0 then len(stack) + level else level - 1 end between 0 and len(stack) - 1 then stack[case when level < 0 then len(stack) + level else level - 1 end + 1] else state end,
   case when op = 'save' then list_append(stack, state) when op = 'restore' then stack[:case when level < 0 then len(stack) + level else level - 1 end] else stack end,
   case when op = 'restore' and not case when level < 0 then len(stack) + level else level - 1 end between 0 and len(stack) - 1 then 'restore level' end
  from r join e on e.user_id = r.user_id and e.k = r.k + 1 where r.fault is null)
 select user_id, event_id, case when fault is null then state end as state, case when fault is null then cast(len(stack) as int) end as depth, fault from r where k > 0""")
def dc_restore_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device contexts saved and restored by signed levels, up to the first restore of a state that isn't there."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "case when event_type in ('signup', 'view') then 'save' when event_type = 'error' then 'restore' when event_type = 'purchase' then 'set' else 'draw' end as op", "cast(floor(value) as bigint) as v", "case event_id % 5 when 0 then -2 when 1 then 1 + event_id div 5 % 3 when 2 then -3 else -1 end as level")
    return state.restore_levels(e, KEYS, "event_id", "op", "v", "level").select("user_id", "event_id", "state", "depth", "fault")


#: EMF+ records of transforms: signed permutations with whole offsets, so that products are exact.
_PLUS = """case when event_type = 'signup' then case event_id % 3 when 0 then 'set' when 1 then 'reset' else 'save' end when event_type = 'view' then case event_id % 4 when 0 then 'save' when 1 then 'begin' when 2 then 'save' else 'before' end
 when event_type = 'click' then case event_id % 2 when 0 then 'before' else 'after' end when event_type = 'purchase' then 'begin' else case event_id % 6 when 0 then 'restore' when 1 then 'end' else 'draw' end end as op, event_id % 2 as idx,
 cast(case event_id % 8 when 0 then 1 when 1 then 0 when 2 then -1 when 3 then 0 when 4 then 1 when 5 then 0 when 6 then -1 else 0 end as double) as a, cast(case event_id % 8 when 1 then 1 when 3 then -1 when 5 then 1 when 7 then -1 else 0 end as double) as b,
 cast(case event_id % 8 when 1 then -1 when 3 then 1 when 5 then 1 when 7 then -1 else 0 end as double) as c, cast(case event_id % 8 when 0 then 1 when 2 then -1 when 4 then -1 when 6 then 1 else 0 end as double) as d, cast(event_id % 11 - 5 as double) as e, cast(event_id % 13 - 6 as double) as f"""


def _times(x: str, y: str) -> str:
    """SQL list of the product, first x, then y."""
    return f"[{x}[1]*{y}[1]+{x}[2]*{y}[3], {x}[1]*{y}[2]+{x}[2]*{y}[4], {x}[3]*{y}[1]+{x}[4]*{y}[3], {x}[3]*{y}[2]+{x}[4]*{y}[4], {x}[5]*{y}[1]+{x}[6]*{y}[3]+{y}[5], {x}[5]*{y}[2]+{x}[6]*{y}[4]+{y}[6]]"


_ONE = "[1.0::double, 0.0::double, 0.0::double, 1.0::double, 0.0::double, 0.0::double]"
_HIT = "list_position(list_reverse(list_transform(stack, lambda s: s.key)), idx * 2 + case op when 'end' then 1 else 0 end)"


@query(f"""with recursive e as (select user_id, event_id, op, idx, [a, b, c, d, e, f] as m, row_number() over (partition by user_id order by event_id) as k from (select user_id, event_id, {_PLUS} from events)),
 r(user_id, k, event_id, world, container, stack, fault) as (select user_id, cast(0 as bigint), cast(null as bigint), {_ONE}, {_ONE}, cast([] as struct(key bigint, world double[], container double[])[]), cast(null as varchar) from e where k = 1
  union all select user_id, k, event_id, case op when 'set' then m when 'reset' then {_ONE} when 'begin' then {_ONE} when 'before' then {_times('m', 'world')} when 'after' then {_times('world', 'm')} when 'restore' then stack[len(stack) - hit + 1].world when 'end' then stack[len(stack) - hit + 1].world else world end,
   case op when 'begin' then {_times('mw', 'container')} when 'restore' then stack[len(stack) - hit + 1].container when 'end' then stack[len(stack) - hit + 1].container else container end,
   case when op in ('save', 'begin') then list_append(stack, struct_pack(key := idx * 2 + case op when 'begin' then 1 else 0 end, world := world, container := container)) when op in ('restore', 'end') then stack[:len(stack) - hit] else stack end,
   case when op in ('restore', 'end') and hit is null then 'saved state index' end
  from (select e.*, r.world, r.container, r.stack, {_times('m', 'world')} as mw, nullif({_HIT}, 0) as hit from r join e on e.user_id = r.user_id and e.k = r.k + 1 where r.fault is null))
 select user_id, event_id, cast(len(stack) as int) as depth, fault, """ + ", ".join(f"cast({n}[{i + 1}] as bigint) as {n}_{x}" for n in ("world", "container") for i, x in enumerate("abcdef")) + " from (select user_id, k, event_id, fault, case when fault is null then world end as world, case when fault is null then container end as container, case when fault is null then stack end as stack from r) where k > 0")
def plus_world_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World and container matrices after each EMF+ record, through saves, restores and containers told by their index."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", *_split(_PLUS))
    e = e.select("user_id", "event_id", "op", "idx", F.struct("a", "b", "c", "d", "e", "f").alias("m"))
    found = state.plus_transforms(e, KEYS, "event_id", "op", "idx", "m")
    return found.select("user_id", "event_id", "depth", "fault", *[F.col(f"{n}.{x}").cast("long").alias(f"{n}_{x}") for n in ("world", "container") for x in "abcdef"])


def _split(columns: str) -> list[str]:
    """The expressions of a select list without commas of their own."""
    return columns.replace("\n", " ").split(", ")


_STREAM = "case event_type when 'signup' then 'EMF+' when 'error' then 'EMF+' else 'EMF' end as format, case event_type when 'signup' then 16388 when 'error' then 16393 when 'view' then 70 else 54 end as type"


@query(f"""with e as (select user_id, event_id, {_STREAM} from events), s as (select *, last_value(case when format = 'EMF+' then type = 16388 end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as dc from e)
 select user_id, event_id, format, type from s where format = 'EMF+' or type in (1, 14, 70) or coalesce(dc, false)""")
def getdc_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind.isin("signup", "error"), "EMF+").otherwise("EMF").alias("format"), F.when(kind == "signup", 0x4004).when(kind == "error", 0x4009).when(kind == "view", 70).otherwise(54).alias("type"))
    return state.select_stream(e, KEYS, ORDER)


@query("""with e as (select user_id, event_id, case event_type when 'signup' then 'begin' when 'error' then 'end' when 'purchase' then 'draw' end as op from events),
 b as (select *, coalesce(last_value(case op when 'begin' then 1 when 'end' then 2 when 'draw' then 0 end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as before from e)
 select fault, count(*) as n from (select case when op = 'begin' and before = 1 then 'nested begin' when op = 'end' and before <> 1 then 'end without begin' when op = 'draw' and before <> 2 then 'draw without end' end as fault from b) where fault is not null group by fault""")
def path_bracket_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "signup", "begin").when(kind == "error", "end").when(kind == "purchase", "draw").alias("op"))
    return state.path_bracket(e, KEYS, ORDER, "op").filter("fault is not null").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("""select user_id, max(event_id) as event_id from events where event_type in ('signup', 'error', 'purchase') group by user_id having arg_max(event_type, event_id) = 'signup'""")
def path_open_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "signup", "begin").when(kind == "error", "end").when(kind == "purchase", "draw").alias("op"))
    return state.open_brackets(e, KEYS, ORDER, "op")


@query("""select u.user_id, u.event_id, c.event_id as effect, case when c.event_id is null then 'effect without description' end as fault from (select * from events where event_type = 'click' and event_id % 2 = 0) u asof left join (select * from events where event_type = 'signup') c on u.user_id = c.user_id and u.event_id > c.event_id""")
def effect_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups describe effects; clicks draw images, those of even ids with the effect flag."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    used = (F.col("event_type") == "click") & (F.col("event_id") % 2 == 0)
    bound = state.bind_effects(e, KEYS, ORDER, F.col("event_type") == "signup", used)
    return bound.filter(used).select("user_id", "event_id", "effect", "fault")


@query("""with recursive e as (select event_id // 512 as file, event_id, case when event_type in ('signup', 'purchase', 'view') then 'create' when event_type = 'error' then 'delete' else 'select' end as op, event_id * 7 % (1 + event_id % 4) as handle, row_number() over (partition by event_id // 512 order by event_id) as k from events),
 r(file, k, event_id, used, slot, fault) as (select file, cast(0 as bigint), cast(null as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as varchar) from e where k = 1
  union all select file, k, event_id, case when fault is not null then used when op = 'create' then list_append(used, slot) when op = 'delete' then list_filter(used, lambda x: x <> handle) else used end, case when fault is null then slot end, fault
  from (select e.*, used, case when op = 'create' then free else handle end as slot, case when op = 'create' then case when free is null then 'slots' end when not list_contains(used, handle) then 'undefined handle' end as fault
   from (select e.*, r.used, list_min(list_filter(range(0, 16), lambda x: not list_contains(r.used, x))) as free from r join e on e.file = r.file and e.k = r.k + 1 where r.fault is null) e) )
 select file, event_id, cast(slot as int) as slot, fault from r where k > 0""")
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WMF files of 512 records: objects take the lowest free slot, and are selected and deleted by it."""
    e = table(spark, sf_dir, "events").selectExpr("event_id div 512 as file", "event_id", "case when event_type in ('signup', 'purchase', 'view') then 'create' when event_type = 'error' then 'delete' else 'select' end as op", "event_id * 7 % (1 + event_id % 4) as handle")
    return state.allocate_slots(e, ["file"], ["event_id"], "op", "handle", 16).select("file", "event_id", "slot", "fault")


@query("""with e as (select user_id, event_id, event_type from events) select u.user_id, u.event_id, c.event_id as object from (select * from e where event_type = 'click') u asof left join (select * from e where event_type = 'signup') c on u.user_id = c.user_id and u.event_id > c.event_id""")
def object_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    created = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return e.withColumn("object", state.resolve_objects(e, KEYS, ORDER, created)).filter("event_type = 'click'").select("user_id", "event_id", "object")


_HANDLES = """case event_type when 'signup' then 'create' when 'purchase' then 'create' when 'error' then 'delete' else 'select' end as op, case when event_id % 19 = 0 then 2147483648 + event_id % 23 else event_id % 7 end as handle,
 case event_id % 5 when 0 then 'pen' when 1 then 'brush' when 2 then 'font' when 3 then 'palette' else 'colour space' end as kind"""


@query(f"""with e as (select user_id, event_id, {_HANDLES} from events),
 l as (select *, last_value(case when op = 'create' then event_id when op = 'delete' then -1 end ignore nulls) over w as made, last_value(case when op = 'create' then kind when op = 'delete' then '' end ignore nulls) over w as was from e window w as (partition by user_id, handle order by event_id rows between unbounded preceding and 1 preceding)),
 f as (select *, coalesce(made, -1) >= 0 as alive, handle >= 2147483648 as stock, handle - 2147483648 as num from l),
 g as (select *, case when op = 'create' and (handle <= 0 or handle >= 65536 or alive) then 'creation handle' when op = 'select' and stock and (num > 19 or num in (9, 15)) then 'stock object' when op = 'delete' and stock then 'stock object' when op <> 'create' and not stock and not alive then 'undefined handle' when op = 'select' and not stock and was in ('palette', 'colour space') then 'not selectable' end as fault from f)
 select user_id, event_id, fault, case when fault is null and op <> 'create' and not stock then made end as object from g""")
def handle_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects created, selected and deleted by handle, stock objects and kinds that can't be selected included."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "case event_type when 'signup' then 'create' when 'purchase' then 'create' when 'error' then 'delete' else 'select' end as op", "case when event_id % 19 = 0 then 2147483648 + event_id % 23 else event_id % 7 end as handle", "element_at(array('pen', 'brush', 'font', 'palette', 'colour space'), cast(event_id % 5 as int) + 1) as kind")
    return state.resolve_handles(e, KEYS, ORDER, "op", "handle", "kind").select("user_id", "event_id", "fault", "object")


@query("""select user_id, event_id, event_type = 'view' and coalesce(lead(event_type) over w = 'click', false) and lead(event_id % 2) over w is not distinct from event_id % 2 as fused from events window w as (partition by user_id order by event_id)""")
def sprite_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(kind == "view", "SRCAND").when(kind == "click", "SRCPAINT").alias("rop"), (F.col("event_id") % 2).alias("place"))
    return state.sprite_pairs(e, KEYS, ORDER, "rop", ["place"]).select("user_id", "event_id", "fused")


@query("""select user_id, event_id, cast(sum(cast(floor(value) as bigint) * 10) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as used, sum(cast(floor(value) as bigint) * 10) over (partition by user_id order by event_id rows unbounded preceding) > 5000 as over from events""")
def pixel_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value") * 10).alias("size"))
    return state.over_budget(e, KEYS, ORDER, F.col("size"), 5000).select("user_id", "event_id", "used", "over")


@query("""select user_id, event_id, cast(sum(event_id % 128 - 64) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as x, cast(sum(cast(floor(value) as bigint) % 128 - 64) over (partition by user_id order by event_id rows unbounded preceding) as bigint) as y from events""")
def relative_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", state.running(F.col("event_id") % 128 - 64, KEYS, ORDER).alias("x"), state.running(F.floor("value") % 128 - 64, KEYS, ORDER).alias("y"))


@query("""with e as (select user_id, event_type, event_id from events) select user_id, event_type, count(*) as n_points, list(event_id order by event_id)[1] as first_point, list(event_id order by event_id)[-1] as last_point from e group by user_id, event_type""")
def poly_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of points and the counts of its polygons, split at the running sums of the counts."""
    e = table(spark, sf_dir, "events")
    polys = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sort_array(F.collect_list("event_id")).alias("p"))
    files = polys.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "n", "p"))).alias("q")).select("user_id", F.flatten("q.p").alias("points"), F.col("q.n").alias("counts"), F.col("q.event_type").alias("names"))
    starts = F.transform("counts", lambda n, i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0), lambda a, x: a + x))
    parts = files.select("user_id", "points", F.explode(F.arrays_zip("names", "counts", starts.alias("start"))).alias("s"))
    part = F.slice("points", F.col("s.start") + 1, F.col("s.counts"))
    return parts.select("user_id", F.col("s.names").alias("event_type"), F.col("s.counts").cast("long").alias("n_points"), F.element_at(part, 1).alias("first_point"), F.element_at(part, -1).alias("last_point"))


@query("""with runs as (select user_id, event_id, event_id % 5 + 1 as n, event_id % 3 as kind from events), s as (select *, sum(n) over (partition by user_id order by event_id rows unbounded preceding) - n as start from runs)
 select user_id, cast(sum(n) as bigint) as n_types, cast(sum(kind * (n * start + n * (n - 1) // 2)) as bigint) as weighted from s group by user_id""")
def rle_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length coded path types expanded; the sum of type times place tells that order and lengths are right."""
    from strokelake.operators import codecs

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5 + 1).cast("int").alias("n"), (F.col("event_id") % 3).alias("value"))
    runs = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "n", "value"))).alias("runs"))
    flat = runs.select("user_id", F.posexplode(codecs.expand_runs(F.col("runs"))).alias("at", "kind"))
    return flat.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_types"), F.sum(F.col("kind") * F.col("at")).alias("weighted"))
