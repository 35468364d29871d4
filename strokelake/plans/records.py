"""Queries over records: metafiles are encoded from the events table, walked and decoded again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import binary, layouts, points
from strokelake.operators import codecs, play
from strokelake.sources import metafiles

from .registry import query, table

#: Record type, words of the record, by event type.
TYPES = {"click": (0x0214, 5), "view": (0x0213, 5), "purchase": (0x041F, 7), "error": (0x0209, 5), "signup": (0x001E, 3)}

#: The same in SQL, with the coordinates.
ENCODED = """enc as (select user_id, event_id, event_type, event_id % 32768 as x, cast(floor(value) as bigint) % 32768 as y, event_id % 16777216 as color,
 case event_type when 'click' then 532 when 'view' then 531 when 'purchase' then 1055 when 'error' then 521 else 30 end as type,
 case event_type when 'purchase' then 14 when 'signup' then 6 else 10 end as bytes from events)"""


def encoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, event_id, record``: each event as a record with coordinates and colour from its columns."""
    e = table(spark, sf_dir, "events")
    kind: Column = F.col("event_type")
    head = F.coalesce(*[F.when(kind == k, F.concat(binary.little(F.lit(w), 4), binary.little(F.lit(t), 2))) for k, (t, w) in TYPES.items()])
    x, y = F.col("event_id") % 32768, F.floor("value") % 32768
    point = F.concat(binary.little(y, 2), binary.little(x, 2))
    color = binary.little(F.col("event_id") % 16777216, 4)
    body = F.when(kind.isin("click", "view"), point).when(kind == "purchase", F.concat(color, point)).when(kind == "error", color).otherwise(F.lit(b""))
    return e.select("user_id", "event_id", F.concat(head, body).alias("record"))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metafiles.build_wmf(encoded_events(spark, sf_dir), ["user_id"], ["event_id"])


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metafiles.records(event_files(spark, sf_dir), "user_id").withColumn("user_id", F.col("file").cast("long"))


@query(f"""with {ENCODED} select user_id, count(*) + 1 as n_records, cast(24 + sum(bytes) as bigint) as n_bytes,
 cast(coalesce(sum(x) filter (type in (532, 531, 1055)), 0) as bigint) as sum_x, cast(coalesce(sum(y) filter (type in (532, 531, 1055)), 0) as bigint) as sum_y,
 coalesce(bit_xor(x) filter (type in (532, 531, 1055)), 0) as xor_x from enc group by user_id""")
def walk_wmf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: files walked, records decoded, sums by file."""
    rows = layouts.decode(event_records(spark, sf_dir))
    size = F.octet_length("raw")
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        (18 + F.sum(size)).cast("long").alias("n_bytes"),
        F.coalesce(F.sum(F.col("fields")["x"]), F.lit(0)).cast("long").alias("sum_x"),
        F.coalesce(F.sum(F.col("fields")["y"]), F.lit(0)).cast("long").alias("sum_y"),
        F.coalesce(F.bit_xor(F.col("fields")["x"].cast("long")), F.lit(0)).alias("xor_x"),
    )


@query(f"""with {ENCODED} select user_id, row_number() over w - 1 as seq, cast(18 + coalesce(sum(bytes) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
 type from enc window w as (partition by user_id order by event_id)
 union all select user_id, count(*), cast(18 + sum(bytes) as bigint), 0 from enc group by user_id""")
def record_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_records(spark, sf_dir).select("user_id", F.col("seq").cast("long").alias("seq"), "offset", "type")


@query(f"""with {ENCODED} select name, count(*) as n, cast(sum(bytes) as bigint) as bytes from (select case type when 532 then 'MoveTo' when 531 then 'LineTo' when 1055 then 'SetPixel' when 521 then 'SetTextColor' else 'SaveDC' end as name, bytes from enc
 union all select distinct 'EOF', 6 from enc where false union all select 'EOF', 6 from (select distinct user_id from enc)) group by name""")
def record_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts.decode(event_records(spark, sf_dir))
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("bytes"))


PLACEABLE = "0xCDD7, 0x9AC6, 0, o_orderkey % 32768, o_custkey % 32768, (o_orderkey * 7) % 32768, (o_custkey * 3) % 32768, 1440, 0, 0"


@query("""select o_orderkey, xor(xor(xor(52695, 39622), xor(o_orderkey % 32768, o_custkey % 32768)), xor(xor((o_orderkey * 7) % 32768, (o_custkey * 3) % 32768), 1440)) as checksum from orders""")
def placeable_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    words = [F.lit(0xCDD7), F.lit(0x9AC6), F.lit(0), k % 32768, c % 32768, k * 7 % 32768, c * 3 % 32768, F.lit(1440), F.lit(0), F.lit(0)]
    head = F.concat(*[binary.little(w, 2) for w in words])
    return table(spark, sf_dir, "orders").select("o_orderkey", binary.xor_words(head).alias("checksum"))


@query("""with v as (select l_returnflag, l_partkey * 37 % 65536 as u, l_suppkey * 997 % 65536 as w from lineitem)
 select l_returnflag, cast(sum(case when u >= 32768 then u - 65536 else u end) as bigint) as sum_x, cast(sum(case when w >= 32768 then w - 65536 else w end) as bigint) as sum_y, min(case when u >= 32768 then u - 65536 else u end) as min_x from v group by l_returnflag""")
def sign_fold_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(binary.little(F.col("l_suppkey") * 997, 2), binary.little(F.col("l_partkey") * 37, 2))
    points = table(spark, sf_dir, "lineitem").select("l_returnflag", data.alias("d")).select("l_returnflag", binary.signed(F.col("d"), 2, 2).alias("x"), binary.signed(F.col("d"), 0, 2).alias("y"))
    return points.groupBy("l_returnflag").agg(F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.min("x").alias("min_x"))


@query(f"""with {ENCODED}, files as (select user_id, user_id % 5 as fault from (select distinct user_id from enc))
 select kind, field, count(*) as n from (select case fault when 1 then 'MALFORMED' when 2 then 'MALFORMED' when 3 then 'FORMAT' when 4 then 'MALFORMED' end as kind,
 case fault when 1 then 'largest record' when 2 then 'file size' when 3 then 'format' when 4 then 'header' end as field from files where fault > 0) group by kind, field""")
def issues_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files damaged in four ways, by the kind of fault that walking reports."""
    files, fault = event_files(spark, sf_dir), F.col("user_id") % 5
    c = F.col("content")
    put = lambda at, n, value: F.concat(F.substring(c, 1, at), F.lit(value), F.substring(c, at + n + 1, 1 << 30))
    damaged = F.when(fault == 1, put(12, 4, b"\xfe\xff\0\0")).when(fault == 2, F.concat(c, F.lit(b"\0\0"))).when(fault == 3, put(0, 4, b"\x09\0\0\0")).when(fault == 4, put(4, 2, b"\0\x07")).otherwise(c)
    found = metafiles.issues(files.withColumn("content", damaged), "user_id")
    return found.groupBy("kind", "field").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {ENCODED} select user_id, event_id, concat('{{"name":"', case type when 532 then 'MoveTo' when 531 then 'LineTo' when 1055 then 'SetPixel' when 521 then 'SetTextColor' else 'SaveDC' end, '","type":', type, ',"bytes":', bytes, '}}') as line from enc""")
def dump_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line a record, as the dump writes them; the record's event is found again by its place in the file."""
    rows = layouts.decode(event_records(spark, sf_dir)).filter("name <> 'EOF'")
    order = encoded_events(spark, sf_dir).select("user_id", "event_id", (F.expr("row_number() over (partition by user_id order by event_id)") - 1).alias("seq"))
    line = F.to_json(F.struct("name", "type", F.octet_length("raw").alias("bytes")))
    return rows.withColumn("line", line).join(order, ["user_id", "seq"]).select("user_id", "event_id", "line")


@query("""select user_id, count(*) as n, cast(sum(coalesce(color, 0)) as bigint) as colors from (select user_id, case when event_type in ('purchase', 'error') then event_id % 16777216 end as color from events) group by user_id""")
def decode_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layouts.decode(event_records(spark, sf_dir)).filter("name <> 'EOF'")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("fields")["color"]), F.lit(0)).cast("long").alias("colors"))


@query("""select doc_id, cast(strlen(text) as bigint) as n_bytes, md5(text) as digest, true as whole from documents""")
def wmfc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded files carried as fragments of 4000 bytes, put together again; rows that repeat an id are files of their own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"), F.monotonically_increasing_id().alias("row"))
    parts = docs.select("row", "doc_id", F.posexplode_outer(codecs.fragments(F.col("data"), 4000)).alias("k", "part"))
    joined = codecs.join_fragments(parts, ["row", "doc_id"], "k")
    return joined.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"), "whole")


@query("""select doc_id, cast(strlen(text) as bigint) as n_bytes, md5(text) as digest, true as same from documents""")
def tiff_packbits_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    rows = rows.withColumn("back", codecs.unpackbits(codecs.packbits("data")))
    return rows.select("doc_id", F.octet_length("back").cast("long").alias("n_bytes"), F.md5("back").alias("digest"), (F.col("back") == F.col("data")).alias("same"))


@query("""with r as (select user_id, event_id % 7 + 1 as n, event_id % 16 as value from events) select user_id, value, cast(sum(n) as bigint) as pixels from r group by user_id, value""")
def dib_rle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows of 16 events' runs of colours, by turns as RLE8 and RLE4 bytes, decoded again and counted by colour."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 7 + 1).cast("int").alias("n"), (F.col("event_id") % 16).cast("int").alias("value"))
    runs = e.groupBy("user_id", F.floor(F.col("event_id") / 16).alias("block")).agg(F.sort_array(F.collect_list(F.struct("event_id", "n", "value"))).alias("runs"))
    rows = runs.select("user_id", F.when(F.col("block") % 2 == 0, 8).otherwise(4).alias("bits"), codecs.expand_runs(F.col("runs")).alias("row")).withColumn("width", F.size("row"))
    back = codecs.decode_rle(codecs.encode_rle(F.col("row"), F.col("width"), F.col("bits")), F.col("width"), F.lit(1), F.col("bits"))
    pixels = rows.select("user_id", back.alias("image")).select("user_id", F.explode("image.pixels").alias("value"))
    return pixels.groupBy("user_id", F.col("value").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("pixels"))


def _drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a drawing: moves, lines, pixels and window origins."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    code = F.when(kind == "click", 0x0214).when(kind == "view", 0x0213).when(kind == "purchase", 0x041F).otherwise(0x020B)
    color = F.when(kind == "purchase", binary.little(F.col("event_id") % 16777216, 4)).otherwise(F.lit(b""))
    body = F.concat(color, binary.little(F.floor("value") % 32768, 2), binary.little(F.col("event_id") % 32768, 2))
    record = F.concat(binary.little(3 + F.octet_length(body) / 2, 4), binary.little(code, 2), body)
    files = metafiles.build_wmf(e.select("user_id", "event_id", record.alias("record")), ["user_id"], ["event_id"])
    return layouts.decode(metafiles.records(files, "user_id"))


@query("""with e as (select user_id, event_id, event_type, event_id % 32768 as x, cast(floor(value) as bigint) % 32768 as y from events),
 s as (select *, coalesce(last_value(case when event_type in ('signup', 'error') then x end ignore nulls) over w, 0) as ox, coalesce(last_value(case when event_type in ('signup', 'error') then y end ignore nulls) over w, 0) as oy,
 coalesce(last_value(case when event_type in ('click', 'view') then x end ignore nulls) over p, 0) as px, coalesce(last_value(case when event_type in ('click', 'view') then y end ignore nulls) over p, 0) as py from e
 window w as (partition by user_id order by event_id rows between unbounded preceding and current row), p as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
 select user_id, case event_type when 'view' then 'line' else 'pixel' end as shape, count(*) as n, cast(sum(x - ox) as double) as sum_x, cast(sum(y - oy) as double) as sum_y, cast(sum(case when event_type = 'view' then px - ox else x - ox end) as double) as sum_from
 from s where event_type in ('view', 'purchase') group by user_id, shape""")
def play_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and pixels in device space, after moves and window origins."""
    decoded = _drawing(spark, sf_dir)
    drawn = play.operations(decoded, play.contexts(decoded))
    last, first = F.element_at("points", -1), F.element_at("points", 1)
    return drawn.groupBy(F.col("file").cast("long").alias("user_id"), "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(last["x"]).alias("sum_x"), F.sum(last["y"]).alias("sum_y"), F.sum(first["x"]).alias("sum_from"))


@query("""with e as (select user_id, event_type, event_id % 32768 - 16384 as x, cast(floor(value) as bigint) % 32768 as y from events) select user_id, event_type, count(*) as n, cast(sum(x) as bigint) as sum_x, cast(sum(y) as bigint) as sum_y from e group by user_id, event_type""")
def poly_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons encoded as one poly-polygon record per user, one polygon per event type, read back natively."""
    e = table(spark, sf_dir, "events")
    pair = F.concat(binary.little(F.col("event_id") % 32768 - 16384, 2), binary.little(F.floor("value") % 32768, 2))
    polys = e.groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("event_id", pair.alias("b")))).alias("p"))
    parts = polys.select("user_id", "event_type", F.size("p").alias("n"), binary.joined(F.col("p.b")).alias("b"))
    whole = parts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_type", "n", "b"))).alias("q"))
    join = lambda f: binary.joined(F.transform("q", f))
    body = F.concat(binary.little(F.size("q"), 2), join(lambda q: binary.little(q["n"], 2)), join(lambda q: q["b"]))
    record = F.concat(binary.little(3 + F.octet_length(body) / 2, 4), binary.little(F.lit(0x0538), 2), body)
    files = metafiles.build_wmf(whole.select("user_id", F.lit(0).alias("k"), record.alias("record")), ["user_id"], ["k"])
    rows = points.polygons(metafiles.records(files, "user_id").filter("type = 1336"))
    named = rows.select(F.col("file").cast("long").alias("user_id"), F.posexplode("polygons").alias("k", "p")).join(whole.select("user_id", F.posexplode("q").alias("k", "q")), ["user_id", "k"])
    total = lambda axis: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[axis])
    return named.select("user_id", F.col("q.event_type").alias("event_type"), F.size("p").cast("long").alias("n"), total("x").alias("sum_x"), total("y").alias("sum_y"))
