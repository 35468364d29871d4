"""Queries over EMF+ objects: whole documents stand for their bytes, cut into records that continue one another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary
from strokelake.operators import objects
from strokelake.sources import metafiles

from .registry import query, table

#: Sixteen documents make a file. A third of the objects end with a record that isn't marked as continued, some are filled up to
#: four bytes, some lack their last record, and some have a type that none has.
_DOCS = """d as (select doc_id // 16 as file, doc_id, coalesce(text, '') as text, 200 + doc_id % 7 * 100 as step, octet_length(encode(coalesce(text, ''))) as bytes from documents),
 f as (select *, greatest(1, cast(ceil(bytes / step) as bigint)) as n, case when doc_id % 41 = 7 then 'identity' when bytes = 0 then 'empty object' when doc_id % 37 = 5 and bytes > step then 'cut' end as wrong from d),
 first as (select file, min(doc_id) as doc_id from f where wrong is not null group by file)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 16).alias("file"), "doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"), (200 + F.col("doc_id") % 7 * 100).alias("step"))
    size = F.octet_length("bytes")
    d = d.withColumns({"size": size, "n": F.greatest(F.lit(1), F.ceil(size / F.col("step")))})
    kept = F.col("n") - F.when((F.col("doc_id") % 37 == 5) & (F.col("n") > 1), 1).otherwise(0)
    # Only the parts of a text go with its rows, not the text.
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), kept - 1), lambda k: F.substring("bytes", (k * F.col("step") + 1).cast("int"), F.col("step").cast("int")))
    rows = d.select("file", "doc_id", "step", "size", "n", F.posexplode(parts).alias("k", "part"))
    final, part = F.col("k") == F.col("n") - 1, F.col("part")
    filled = F.when(final & (F.col("n") > 1) & (F.col("doc_id") % 5 == 1), F.rpad(part, (F.ceil(F.octet_length(part) / 4) * 4).cast("int"), F.lit(b"\0"))).otherwise(part)
    continued = (F.col("n") > 1) & ~(final & (F.col("doc_id") % 3 == 0))
    kind = F.when(F.col("doc_id") % 41 == 7, 0).otherwise(5)
    flags = F.col("doc_id") % 64 + kind * 256 + F.when(continued, 0x8000).otherwise(0)
    data = F.when(continued, F.concat(metafiles.binary.little(F.col("size"), 4), filled)).otherwise(filled)
    raw = metafiles.plus_record(F.lit(0x4008), flags, data)
    return objects.fragments(rows.select("file", (F.col("doc_id") % 16 * (1 << 20) + F.col("k")).alias("at"), flags.cast("int").alias("flags"), raw.alias("raw")))


@query(f"""with {_DOCS} select f.file, f.doc_id % 16 * 1048576 as first, cast(f.doc_id % 64 as int) as id, cast(n as int) as n_fragments, bytes, sha256(text) as data_sha256 from f left join first using (file) where first.doc_id is null or f.doc_id < first.doc_id""")
def object_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of whole documents, put together again from their fragments, up to the first fault of each file."""
    whole, _ = objects.assemble(_fragments(spark, sf_dir), ["file"], "at")
    return whole.select("file", "first", "id", "n_fragments", F.octet_length("data").cast("long").alias("bytes"), F.sha2("data", 256).alias("data_sha256"))


@query(f"""with {_DOCS}, nx as (select file, doc_id, n, wrong, bytes, step, lead(doc_id) over w as next, lead(wrong) over w as next_wrong from f window w as (partition by file order by doc_id))
 select nx.file, case when wrong = 'cut' and next is not null then next % 16 * 1048576 else nx.doc_id % 16 * 1048576 end as position,
  case when wrong = 'cut' then case when next is null then 'unfinished object' when next_wrong = 'identity' then 'identity' else 'inconsistent continuation' end else wrong end as fault from nx join first on nx.file = first.file and nx.doc_id = first.doc_id""")
def object_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each file of fragments."""
    return objects.assemble(_fragments(spark, sf_dir), ["file"], "at")[1]


#: Twelve events make a path: those of even blocks have types that fit, the others what their ids give.
_TYPE = "case when event_id // 12 % 2 = 0 then case event_id % 12 when 0 then 0 when 4 then 3 when 5 then 3 when 6 then 3 when 7 then 129 when 8 then 0 when 9 then 3 when 10 then 3 when 11 then 131 else 1 end else case when event_id % 12 = 0 then 0 else case event_id * 7 % 29 when 0 then 0 when 1 then 65 when 2 then 129 when 3 then 2 when 4 then 3 else 1 end end end"
_COMPLETE = "with t as (select event_id // 12 as path, event_id % 12 as i, " + _TYPE + " as t, event_id * 3 % 120 - 60 as dx, event_id * 5 % 9000 - 4500 as dy from events where event_id // 12 in (select event_id // 12 from events group by 1 having count(*) = 12)),"


@query(f"""{_COMPLETE} r as (with recursive s(path, i, open, curve, what, place) as (select path, cast(-1 as bigint), false, cast(0 as bigint), cast(null as varchar), cast(null as bigint) from t where i = 0
  union all select s.path, t.i, (t.t % 16 = 0 or open) and t.t < 128, case when t.t % 16 = 3 then (curve + 1) % 3 else curve end,
   case when t.t // 64 % 2 = 1 or t.t % 16 not in (0, 1, 3) then 'type' when t.t % 16 = 0 and curve <> 0 then 'start inside a curve' when t.t % 16 <> 0 and not open then 'segment without a start' when t.t % 16 = 1 and curve <> 0 then 'incomplete curve' when t.t >= 128 and case when t.t % 16 = 3 then (curve + 1) % 3 else curve end <> 0 then 'close inside a curve' when t.i = 11 and case when t.t % 16 = 3 then (curve + 1) % 3 else curve end <> 0 then 'end' end, t.i
  from s join t on t.path = s.path and t.i = s.i + 1 where s.what is null) select * from s),
 f as (select path, arg_max(what, i) as what, max(i) as place from r group by path), c as (select path, sum(dx) over w as x, sum(dy) over w as y, t, i from t window w as (partition by path order by i rows unbounded preceding))
 select c.path, case when what = 'end' then 'incomplete curve' else what end as what, cast(case when what = 'end' then 12 when what is not null then place end as int) as place, cast(case when what is null then sum(x * (i + 1)) end as bigint) as sum_x, cast(case when what is null then sum(y * (i + 1)) end as bigint) as sum_y, cast(case when what is null then count(*) filter (t % 16 = 3) end as int) as n_curve
 from c join f using (path) group by c.path, what, place""")
def plus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path objects with relative points and runs of types, read from their bytes; faults by place."""
    e = table(spark, sf_dir, "events").selectExpr("event_id div 12 as path", "event_id % 12 as i", _TYPE.replace("//", "div") + " as t", "event_id * 3 % 120 - 60 as dx", "event_id * 5 % 9000 - 4500 as dy")
    e = e.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("i", "t", "dx", "dy"))).alias("p")).filter(F.size("p") == 12)
    seven = lambda v: binary.little(F.pmod(v, F.lit(128)), 1)
    fifteen = lambda v: F.concat(binary.little(F.floor(F.pmod(v, F.lit(32768)) / 256) + 128, 1), binary.little(F.pmod(v, F.lit(256)), 1))
    number = lambda v: F.when(v.between(-64, 63), seven(v)).otherwise(fifteen(v))
    steps = binary.joined(F.transform("p", lambda x: F.concat(number(x["dx"]), number(x["dy"]))))
    head = lambda t, n: 64 + n + F.when(t % 16 == 3, 128).otherwise(0)
    single = binary.joined(F.transform("p", lambda x: F.concat(binary.little(head(x["t"], 1), 1), binary.little(x["t"], 1))))
    fitting = F.lit(bytes([64 + 1, 0, 64 + 3, 1, 192 + 3, 3, 64 + 1, 129, 64 + 1, 0, 192 + 2, 3, 192 + 1, 131]))
    data = F.concat(binary.little(F.lit(0xDBC01002), 4), binary.little(F.lit(12), 4), binary.little(F.lit(0x2800), 4), steps, F.when(F.col("path") % 2 == 0, fitting).otherwise(single))
    total = lambda axis: F.aggregate(F.transform("points", lambda q, k: q[axis].cast("long") * (k + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    read = objects.decode_paths(e.select(F.col("path").alias("number"), data.alias("data")))
    rows = read.select(F.col("number").alias("path"), "fault.what", "fault.place", F.col("path.points").alias("points"), F.col("path.types").alias("types"))
    return rows.select("path", "what", "place", total("x").alias("sum_x"), total("y").alias("sum_y"), F.when(F.col("types").isNotNull(), F.size(F.filter("types", lambda t: t % 16 == 3))).alias("n_curve"))
