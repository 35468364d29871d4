"""Queries over all record types of the three formats: events become records, files of bounded size, and records again.

Each event is a record of the type that its id picks, with fields computed from the id, so the SQL knows every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary, layouts, points
from strokelake.sources import metafiles

from .registry import query, table

#: Events in one file.
BLOCK = 512
#: Types that frame a file and are written by the builders.
FRAMING = {"WMF": {0}, "EMF": {1, 14, 70}, "EMF+": {0x4001, 0x4002}}


def _types(form: str) -> list[tuple]:
    """(index, type, name, fields) of the types that events are dealt to."""
    return [(k, code, name, fields) for k, (_, code, name, fields) in enumerate(r for r in layouts.layout_rows() if r[0] == form and r[1] not in FRAMING[form])]


def _field(value: Column, kind: Column) -> Column:
    return F.when(kind == "f32", binary.small_real(value)).when(kind == "u8", binary.little(value, 1)).when(kind.isin("i16", "u16"), binary.little(value, 2)).otherwise(binary.little(value, 4))


def encoded(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """``block, event_id, record``: each event as a record of one of the format's types, its k-th field being (id * (k + 1) + k) % 251."""
    types = _types(form)
    listed = spark.createDataFrame([(k, code, [f[1] for f in fields]) for k, code, _, fields in types], "_k int, code int, kinds array<string>")
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / BLOCK).alias("block"), (F.col("event_id") % len(types)).cast("int").alias("_k"))
    rows = e.join(F.broadcast(listed), "_k")  # a row for each record type
    parts = F.transform("kinds", lambda kind, k: _field((F.col("event_id") * (k + 1) + k) % 251, kind))
    body = binary.joined(parts)
    if form == "EMF+":
        record = metafiles.plus_record(F.col("code"), F.col("event_id") % 256, body)
    else:
        step, head = (2, 6) if form == "WMF" else (4, 8)
        padded = F.rpad(body, (F.ceil(F.octet_length(body) / step) * step).cast("int"), F.lit(b"\0"))
        size = F.octet_length(padded) + head
        record = F.concat(binary.little(size / 2, 4), binary.little(F.col("code"), 2), padded) if form == "WMF" else F.concat(binary.little(F.col("code"), 4), binary.little(size, 4), padded)
    return rows.select("block", "event_id", record.alias("record"))


BUILDERS = {"WMF": metafiles.build_wmf, "EMF": metafiles.build_emf, "EMF+": metafiles.build_emfplus}


def files(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return BUILDERS[form](encoded(spark, sf_dir, form), ["block"], ["event_id"])


def _records(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    return metafiles.records(files(spark, sf_dir, form), "block").withColumn("block", F.col("file").cast("long"))


def _values(form: str) -> str:
    """SQL rows (index, name, place of the field, label), and one of place -1 for types without fields."""
    return ", ".join(f"({k}, '{name}', {at}, '{label}')" for k, _, name, fields in _types(form) for at, label in ([(i, f[0]) for i, f in enumerate(fields)] or [(-1, "")]))


def _sizes(form: str) -> str:
    """SQL rows (index, bytes of the record)."""
    step, head = {"WMF": (2, 6), "EMF": (4, 8), "EMF+": (4, 12)}[form]
    width = {"u8": 1, "i16": 2, "u16": 2, "i32": 4, "u32": 4, "f32": 4}
    return ", ".join(f"({k}, {head + -(-sum(width[f[1]] for f in fields) // step) * step})" for k, _, _, fields in _types(form))


def _decoded(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Counts and sums of every field of every record type after framing and decoding."""
    rows = layouts.decode(_records(spark, sf_dir, form)).filter((F.col("format") == form) & ~F.col("type").isin(*FRAMING[form]))
    fields = rows.select("name", F.explode_outer(F.when(F.size("fields") > 0, F.col("fields"))).alias("label", "value"))
    return fields.groupBy("name", F.coalesce("label", F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).cast("long").alias("total"))


def _decoded_sql(form: str) -> str:
    return f"""with t(k, name, place, label) as (values {_values(form)}) select name, label, count(*) as n, cast(sum(case when place < 0 then 0 else (event_id * (place + 1) + place) % 251 end) as bigint) as total
 from events join t on event_id % {len(_types(form))} = t.k group by name, label"""


@query(_decoded_sql("WMF"))
def decode_wmf_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "WMF")


@query(_decoded_sql("EMF"))
def decode_emf_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "EMF")


@query(_decoded_sql("EMF+"))
def decode_emfplus_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, "EMF+")


@query(f"""with t(k, size) as (values {_sizes('EMF')}), s as (select event_id // {BLOCK} as block, size, 88 + coalesce(sum(size) over (partition by event_id // {BLOCK} order by event_id rows between unbounded preceding and 1 preceding), 0) as start from events join t on event_id % {len(_types('EMF'))} = t.k)
 select block, count(*) + 2 as n_records, cast(sum(size) + 108 as bigint) as n_bytes, cast(sum(start) + 88 + sum(size) as bigint) as offsets from s group by block""")
def walk_emf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, bytes and the sum of offsets of each EMF file."""
    rows = _records(spark, sf_dir, "EMF")
    return rows.groupBy("block").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.octet_length("raw")).cast("long").alias("n_bytes"), F.sum("offset").alias("offsets"))


@query(f"""with t(k, size) as (values {_sizes('EMF+')}), s as (select event_id // {BLOCK} as block, event_id, size, 148 + coalesce(sum(size) over (partition by event_id // {BLOCK} order by event_id rows between unbounded preceding and 1 preceding), 0) as start from events join t on event_id % {len(_types('EMF+'))} = t.k)
 select block, 5 as n_emf, count(*) + 2 as n_plus, cast(sum(size) + 196 as bigint) as n_bytes, cast(sum(start) + 104 + 148 + sum(size) + 16 as bigint) as plus_offsets, cast(sum(event_id % 256) + 1 as bigint) as flags from s group by block""")
def walk_emfplus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMF and EMF+ records, bytes, offsets and flags of dual files."""
    rows, plus = _records(spark, sf_dir, "EMF+"), F.col("format") == "EMF+"
    return rows.groupBy("block").agg(
        F.count(F.when(~plus, 1)).cast("int").alias("n_emf"),
        F.count(F.when(plus, 1)).alias("n_plus"),
        F.sum(F.when(~plus, F.octet_length("raw"))).cast("long").alias("n_bytes"),
        F.sum(F.when(plus, F.col("offset"))).alias("plus_offsets"),
        F.sum(F.when(plus, F.col("flags"))).alias("flags"),
    )


#: (byte offset, number written, kind, field): damage, and what walking reports of it.
DAMAGE = [
    (40, 0, "MALFORMED", "signature"),
    (52, 7, "MALFORMED", "record count"),
    (48, 3, "MALFORMED", "file size"),
    (4, 84, "MALFORMED", "signature"),
    (60, 0xFFFFFFFF, "MALFORMED", "description"),
    (96, 0xFFFFFFFF, "MALFORMED", "comment size"),
    (108, 0xFFFFFFFC, "LIMIT", "size"),
    (108, 22, "MALFORMED", "size"),
    (112, 0xFFFFFFFF, "MALFORMED", "EMF+ data size"),
    (116, 0, "MALFORMED", "EMF+ version"),
    (104, 0x4003, "MALFORMED", "EMF+ header"),
]


@query(f"""with d(k, kind, field) as (values {', '.join(f"({k}, '{kind}', '{field}')" for k, (_, _, kind, field) in enumerate(DAMAGE))}), b as (select distinct event_id // {BLOCK} as block from events)
 select block, kind, field from b join d on block % {len(DAMAGE) + 1} = d.k""")
def emf_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual files, each damaged in one way or not at all, and the fault that is found in each."""
    made, c = files(spark, sf_dir, "EMF+"), F.col("content")
    put = lambda at, value: F.concat(F.substring(c, 1, at), F.lit(value.to_bytes(4, "little")), F.substring(c, at + 5, 1 << 30))
    damaged = F.coalesce(*[F.when(F.col("block") % (len(DAMAGE) + 1) == k, put(at, value)) for k, (at, value, _, _) in enumerate(DAMAGE)], c)
    found = metafiles.issues(made.withColumn("content", damaged), "block")
    return found.select(F.col("file").cast("long").alias("block"), "kind", "field")


@query(f"""with b as (select event_id // {BLOCK} as block, count(*) as n from events group by block)
 select block, case when block % 4 = 1 then 'plan ' || block end as description, case when block % 4 in (0, 2, 3) then block % 4 = 3 end as opengl, case when block % 4 = 3 then 40 end as format_bytes, case when block % 4 >= 2 then block * 10 + 1 end as wide, case when block % 4 >= 2 then 7 end as high from b where block % 4 > 0""")
def header_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers by turns plain, with a description at byte 88, with both extensions, and with a pixel format behind them."""
    number = lambda v: binary.little(v if isinstance(v, Column) else F.lit(v), 4)
    blocks = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / BLOCK).alias("block")).distinct()
    kind, text = F.col("block") % 4, F.encode(F.concat(F.lit("plan "), F.col("block").cast("string")), "UTF-16LE")
    head = lambda size, chars, where: F.concat(number(1), number(size), *[number(0)] * 8, number(metafiles.SIGNATURE), number(0x10000), *[number(0)] * 3, number(chars), number(where), *[number(0)] * 5)
    described = F.concat(head(88 + F.octet_length(text), F.octet_length(text) / 2, 88), text)
    sizes = F.concat(number(F.col("block") * 10 + 1), number(7))
    extended = F.concat(head(108, 0, 0), number(0), number(0), number(0), sizes)
    formatted = F.concat(head(148, 0, 0), number(40), number(108), number(1), sizes, *[number(9)] * 10)
    rows = blocks.filter(kind > 0).withColumn("content", F.when(kind == 1, described).when(kind == 2, extended).otherwise(formatted))
    return metafiles.emf_header(rows).select("block", "description", "opengl", F.octet_length("pixel_format").alias("format_bytes"), F.col("micrometers.width").alias("wide"), F.col("micrometers.height").cast("int").alias("high"))


@query("""with p as (select event_id, event_id % 3 as coding, unnest([0, 1, 2, 3]) as i from events),
 v as (select event_id, coding, i, (event_id * (2 * i + 1)) % 120 - 60 as dx, (event_id * (2 * i + 2)) % 9000 - 4500 as dy from p),
 c as (select event_id, coding, case when coding = 0 then sum(dx) over w else case when coding = 1 then dx else dx + 60 end end as x, case when coding = 0 then sum(dy) over w else case when coding = 1 then dy else dy + 4500 end end as y from v window w as (partition by event_id order by i rows unbounded preceding))
 select coding, count(*) as n, cast(sum(x) as double) as sum_x, cast(sum(y) as double) as sum_y, cast(max(y) as double) as max_y from c group by coding""")
def plus_point_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points an event, written as relative steps, 16-bit integers or singles by turns, and read back by the record's flags."""
    e, coding = table(spark, sf_dir, "events").select("event_id"), F.col("event_id") % 3
    numbers = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.when(k % 2 == 1, F.col("event_id") * k % 120 - 60).otherwise(F.col("event_id") * k % 9000 - 4500))
    written = lambda how: binary.joined(F.transform("numbers", how))
    # Seven bits hold -64 to 63, fifteen bits the rest, the higher byte first.
    seven = lambda v: binary.little(F.pmod(v, F.lit(128)), 1)
    fifteen = lambda v: F.concat(binary.little(F.floor(F.pmod(v, F.lit(32768)) / 256) + 128, 1), binary.little(F.pmod(v, F.lit(256)), 1))
    steps = written(lambda v: F.when(v.between(-64, 63), seven(v)).otherwise(fifteen(v)))
    whole = written(lambda v: binary.little(v, 2))
    single = written(lambda v, k: binary.small_real(v + F.when(k % 2 == 0, 60).otherwise(4500)))
    data = F.concat(binary.little(F.lit(4), 4), F.when(coding == 0, steps).when(coding == 1, whole).otherwise(single))
    flags = F.when(coding == 0, 0x0800).when(coding == 1, 0x4000).otherwise(0)
    rows = e.select("event_id", numbers.alias("numbers")).select("event_id", coding.alias("coding"), flags.alias("flags"), metafiles.plus_record(F.lit(0x400D), flags, data).alias("raw"))
    found = rows.select("coding", F.explode(points.plus_points(F.col("raw"), F.lit(16), binary.unsigned(F.col("raw"), 12, 4), F.col("flags"))).alias("p"))
    return found.groupBy("coding").agg(F.count(F.lit(1)).alias("n"), F.sum("p.x").alias("sum_x"), F.sum("p.y").alias("sum_y"), F.max("p.y").alias("max_y"))
