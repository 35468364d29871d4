"""EMF+ objects put together from continued fragments, and what their bytes hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from strokelake.functions import binary, points
from strokelake.functions.shared import checkpoint, spread

from . import assembly, replay, scan

#: Bytes of an object at most, and what its last fragment may hold beyond its total to fill up four bytes.
OBJECT_BYTES, FILLING = 16 << 20, 3
#: Fragments of a file that one task puts together; longer files go to the segmented scans.
FRAGMENTS = replay.SHORT_BLOCKS * scan.BLOCK


def fragments(records: DataFrame) -> DataFrame:
    """``id, type, continued, total, data`` added to EMF+ object records ``flags, raw``: fields of the flags, declared total and bytes of a fragment.

    A record that is continued begins its data with the object's total size.
    """
    flags, size = F.col("flags"), binary.unsigned(F.col("raw"), 8, 4)
    continued = flags.bitwiseAND(F.lit(0x8000)) != 0
    return records.withColumns(
        {
            "id": flags.bitwiseAND(F.lit(255)),
            "type": F.shiftright(flags, 8).bitwiseAND(F.lit(127)),
            "continued": continued,
            "total": F.when(continued, binary.unsigned(F.col("raw"), 12, 4)),
            "data": F.when(continued, F.substring("raw", F.lit(17), (size - 4).cast("int"))).otherwise(F.substring("raw", F.lit(13), size.cast("int"))),
        }
    )


def _chain(runs: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``keys, position, _end`` of the fragments at which an object begins, from runs of continued fragments of one object number, type and total.

    ``_sum`` is the running size of a run, ``_to`` what it must reach for an object that began here. An object of a run begins where
    the one before it ended; so the beginnings are found from a run's first by jumps, whose reach doubles each time.
    """
    line = Window.partitionBy(*keys, "_run").orderBy(position)
    # What is reached and what is to be reached, in one order: the first sum at or beyond a goal ends the object.
    goals = runs.select(*keys, "_run", F.col("_to").alias("_sum"), F.lit(0).alias("_kind"), F.col(position), F.lit(None).cast("bigint").alias("_place"))
    sums = runs.select(*keys, "_run", "_sum", F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias(position), F.col(position).cast("bigint").alias("_place"))
    later = Window.partitionBy(*keys, "_run").orderBy("_sum", "_kind", "_place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = goals.unionByName(sums).withColumn("_end", F.first("_place", ignorenulls=True).over(later)).filter("_kind = 0").select(*keys, position, "_end")
    places = runs.select(*keys, position, F.lead(position).over(line).alias("_following"), (F.row_number().over(line) == 1).alias("_begins"))
    ends = places.select(*keys, F.col(position).alias("_end"), F.col("_following").alias("_next"))
    chain = checkpoint(met.join(places.drop("_following"), [*keys, position]).join(ends, [*keys, "_end"], "left").select(*keys, position, "_end", "_next", "_begins"))
    while True:
        told = chain.filter("_begins and _next is not null").select(*keys, F.col("_next").alias(position)).distinct().withColumn("_told", F.lit(True))
        if told.join(chain.filter("not _begins"), [*keys, position], "left_semi").isEmpty():
            return chain.filter("_begins").select(*keys, position, "_end")
        further = chain.select(*keys, F.col(position).alias("_next"), F.col("_next").alias("_then"))
        joined = chain.join(told, [*keys, position], "left").join(further, [*keys, "_next"], "left")
        chain = checkpoint(joined.select(*keys, position, "_end", F.col("_then").alias("_next"), (F.col("_begins") | F.coalesce("_told", F.lit(False))).alias("_begins")))


def assemble(frags: DataFrame, keys: list[str], position: str, most: int = OBJECT_BYTES, short: int = FRAGMENTS) -> tuple[DataFrame, DataFrame]:
    """The objects ``keys, first, last, id, type, n_fragments, data`` of fragments ``keys, position, id, type, continued, total, data``, and each file's first fault.

    A fragment that isn't continued is an object, or the end of the one that is open. An open object takes every fragment of its number, type
    and total until its bytes reach the total, be the last one marked as continued or not; up to three bytes more fill up. Faults, as
    ``keys, position, fault``: an object number over 63 or a type outside 1 to 9, another fragment while an object is open, one that ends short of the
    total or more than three bytes past it, an empty object, a total of 0 or over ``most``, and an object still open at the end (at its first
    fragment). A file's objects count up to its first fault. Other columns are not read; keys may be null; no fragments give neither.
    A continued fragment without a total has the total 0. Files of up to ``short`` fragments are put together inside tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    total = F.when(F.col("continued"), F.col("total").cast("bigint"))
    sound = [F.col(position).cast("bigint").alias("_position"), *[F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("id", "type")], F.coalesce("continued", F.lit(False)).alias("continued"), F.coalesce(total, F.lit(0)).alias("total"), F.coalesce("data", F.lit(b"")).alias("data")]
    few, many = replay.by_length(frags.select(*keys, *sound), keys, short)

    def inside(rows: DataFrame, added: str, faults: bool) -> DataFrame:
        kind = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL(added).fields])
        task = assembly.Assembly(len(keys), most, FILLING, faults, to_arrow_schema(kind))
        return spread(rows, *keys).sortWithinPartitions(*keys, "_position").mapInArrow(task.run, kind)

    whole = inside(few, "first long, last long, id int, type int, n_fragments int, data binary", False)
    wrong = inside(few.withColumn("data", F.octet_length("data").cast("bigint")), "position long, fault string", True)
    if many is None:
        return whole, wrong
    long_whole, long_wrong = _segmented(many.withColumnRenamed("_position", position), keys, position, most)
    return whole.unionByName(long_whole), wrong.unionByName(long_wrong)


def _segmented(frags: DataFrame, keys: list[str], position: str, most: int) -> tuple[DataFrame, DataFrame]:
    # Null keys are keys as well: a struct of them is never null.
    named = frags.select(F.struct(*keys).alias("_file"), position, "id", "type", "continued", "total", "data")
    whole, faults = _assemble(named, ["_file"], position, most)
    return whole.select("_file.*", *whole.columns[1:]), faults.select("_file.*", *faults.columns[1:])


def _assemble(frags: DataFrame, keys: list[str], position: str, most: int) -> tuple[DataFrame, DataFrame]:
    size = F.octet_length("data").cast("bigint")
    heads = frags.select(*keys, F.col(position).cast("bigint"), F.col("id").cast("int"), F.col("type").cast("int"), "continued", F.col("total").cast("bigint"), size.alias("_size"))
    kind = F.struct("id", "type", "total", "continued")
    seen = scan.scan(heads, keys, position, kind, lambda a, b: b)
    same = F.col("continued") & F.coalesce(F.col("_before").eqNullSafe(kind), F.lit(False))
    marked = seen.withColumn("_start", F.when(~same, F.col(position))).drop("_before", "_upto")
    summed = scan.scan(marked, keys, position, F.struct(F.col("_start").alias("run"), F.col("_size").alias("sum")), lambda a, b: F.when(b["run"].isNotNull(), b).otherwise(F.struct(a["run"].alias("run"), (a["sum"] + b["sum"]).alias("sum"))))
    rows = checkpoint(summed.select(*keys, position, "id", "type", "continued", "total", "_size", F.col("_upto.run").alias("_run"), F.col("_upto.sum").alias("_sum"), F.col("_before.run").alias("_after")))
    runs = rows.filter("continued").withColumn("_to", F.col("_sum") - F.col("_size") + F.greatest("total", F.lit(1)))
    begins = _chain(runs, keys, position)
    match = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    first = begins.alias("b").join(runs.alias("r"), [*match("b", "r"), F.col(f"b.{position}") == F.col(f"r.{position}")])
    first = first.select(*[F.col(f"r.{k}") for k in keys], F.col(f"r.{position}").alias("first"), "_end", "id", "type", "total", "_run", (F.col("_sum") - F.col("_size")).alias("_from"))
    # The end of an object in its run, or else what follows the run.
    ends = rows.select(*keys, F.col(position).alias("last"), F.col("_sum").alias("_reached"))
    closed = first.filter("_end is not null").alias("b").join(ends.alias("e"), [*match("b", "e"), F.col("_end") == F.col("last")]).select("b.*", "last", (F.col("_reached") - F.col("_from")).alias("_bytes"), F.lit(True).alias("_same"), F.lit(True).alias("_there"))
    last_sum = rows.groupBy(*keys, "_run").agg(F.max("_sum").alias("_whole"))
    after = rows.filter(F.col("_after").isNotNull() & (F.col("_run") == F.col(position))).select(*keys, "_after", F.col(position).alias("last"), F.struct("id", "type").alias("_kind"), "continued", "_size")
    opened = first.filter("_end is null").alias("b").join(last_sum.alias("w"), [*match("b", "w"), F.col("b._run") == F.col("w._run")]).select("b.*", "_whole").alias("b")
    opened = opened.join(after.alias("a"), [*match("b", "a"), F.col("b._run") == F.col("a._after")], "left")
    fits = ~F.col("continued") & (F.col("_kind.id") == F.col("id")) & (F.col("_kind.type") == F.col("type"))
    opened = opened.select("b.*", "last", (F.col("_whole") - F.col("_from") + F.coalesce("_size", F.lit(0))).alias("_bytes"), F.coalesce(fits, F.lit(False)).alias("_same"), F.col("last").isNotNull().alias("_there")).drop("_whole")
    many = checkpoint(closed.unionByName(opened).drop("_end", "_from"))
    wrong = (
        F.when(F.col("total") == 0, F.struct(F.col("first").alias("position"), F.lit("total size").alias("fault")))
        .when(F.col("total") > most, F.struct(F.col("first").alias("position"), F.lit("object bytes").alias("fault")))
        .when(~F.col("_there"), F.struct(F.col("first").alias("position"), F.lit("unfinished object").alias("fault")))
        .when(~F.col("_same"), F.struct(F.col("last").alias("position"), F.lit("inconsistent continuation").alias("fault")))
        .when((F.col("_bytes") < F.col("total")) | (F.col("_bytes") > F.col("total") + FILLING), F.struct(F.col("last").alias("position"), F.lit("continuation length").alias("fault")))
    )
    singles = rows.filter("not continued").join(many.filter("_there").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("last").alias("_last")), [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col(position) == F.col("_last")], "left_anti")
    alone = F.when(F.col("_size") == 0, "empty object").when(F.col("_size") > most, "object bytes")
    faults = many.select(*keys, wrong.alias("_f")).filter("_f is not null").select(*keys, "_f.*").unionByName(singles.select(*keys, F.col(position).alias("position"), alone.alias("fault")).filter("fault is not null"))
    unknown = rows.filter(~F.col("id").between(0, 63) | ~F.col("type").between(1, 9)).select(*keys, F.col(position).alias("position"), F.lit("identity").alias("fault"))
    faults = faults.unionByName(unknown)
    faults = checkpoint(faults.groupBy(*keys).agg(F.min(F.struct("position", "fault")).alias("_f")).select(*keys, "_f.*"))
    whole = many.filter("_there and _same").select(*keys, "first", "last", "id", "type", F.col("total").alias("_bytes")).unionByName(singles.select(*keys, F.col(position).alias("first"), F.col(position).alias("last"), "id", "type", F.col("_size").alias("_bytes")))
    whole = whole.alias("o").join(faults.alias("f"), match("o", "f"), "left").filter("f.position is null or o.last < f.position").select("o.*")
    # Each fragment goes to the latest object that begins up to it and ends from it on.
    marks = whole.select(*keys, F.col("first").cast("bigint").alias("_at"), F.struct("first", "last", "id", "type", "_bytes").alias("_object"))
    parts = rows.select(*keys, F.col(position).alias("_at")).alias("p").join(marks.alias("m"), [*match("p", "m"), F.col("p._at") == F.col("m._at")], "left").select("p.*", "m._object")
    held = scan.scan(parts, keys, "_at", F.struct(F.col("_object").alias("o")), lambda a, b: F.when(b["o"].isNotNull(), b).otherwise(a)).select(*keys, "_at", F.col("_upto.o").alias("_o")).filter("_o is not null and _at <= _o.last")
    data = held.alias("h").join(frags.select(*keys, F.col(position).cast("bigint").alias("_at"), "data").alias("p"), [*match("h", "p"), F.col("h._at") == F.col("p._at")]).select(*[F.col(f"h.{k}") for k in keys], F.col("h._at").alias("_at"), "_o", "data")
    joined = data.groupBy(*keys, "_o").agg(F.sort_array(F.collect_list(F.struct("_at", F.hex("data").alias("x")))).alias("_p"))  # ``most`` bytes an object
    out = joined.select(*keys, "_o.first", "_o.last", "_o.id", "_o.type", F.size("_p").alias("n_fragments"), F.substring(F.unhex(F.array_join("_p.x", "")), F.lit(1), F.col("_o._bytes").cast("int")).alias("data"))
    return out, faults


#: Points of a path at most.
PATH_POINTS = 1_000_000


def decode_paths(rows: DataFrame, data_col: str = "data", most: int = PATH_POINTS) -> DataFrame:
    """Adds ``path`` {flags, points, types} and ``fault`` {place, what} to path objects; of a faulty object the path is null.

    An object is its version, the number of points, flags, the points in the coding of flags 0x0800 or 0x4000, and their types: a byte
    each, or with flag 0x0800 runs of two bytes, a count under bits that tell of curves and the type of all of them. Three bytes
    may fill up. Faults of bytes have no place: ``signature``, ``point count``, ``points``, ``types``, ``type run``, ``extra data``. Faults of types are
    at a point: bits that none has, a start inside a curve, a segment without a start, a curve that isn't of three
    points, and at the end one that is cut off. Null data is the fault ``signature``.
    """
    raw = F.col(data_col)
    size = F.octet_length(raw)
    u = lambda at: binary.unsigned(raw, at, 4)
    n, coding = F.col("_n"), F.col("_flags").bitwiseAND(F.lit(0x4800))
    relative = coding.bitwiseAND(F.lit(0x800)) != 0
    out = rows.withColumns({"_version": u(0), "_n": u(4), "_flags": u(8)})
    enough = n <= most
    out = out.withColumn("_points", F.when(enough, points.plus_points(raw, F.lit(12).cast("bigint"), n, coding)))
    taken = F.when(relative, points.relative_bytes(raw, F.lit(12).cast("bigint"), n)).when(coding != 0, 4 * n).otherwise(8 * n)
    out = out.withColumn("_at", F.when(F.col("_points").isNotNull(), 12 + taken).cast("bigint"))
    rest = binary.byte_values(F.substring(raw, (F.col("_at") + 1).cast("int"), size))
    out = out.withColumn("_rest", F.when(F.col("_at").isNotNull(), rest))
    # Runs begin where those before them end; those that begin before the last point are the path's.
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("_rest") / 2), F.lit(1)).cast("int") - 1), lambda k: F.struct(F.get("_rest", 2 * k).alias("head"), F.get("_rest", 2 * k + 1).alias("type")))
    runs = F.filter(runs, lambda r: r["type"].isNotNull())
    out = out.withColumn("_runs", F.when(relative, runs))
    ends = points.running_sums(F.transform("_runs", lambda r: r["head"].bitwiseAND(F.lit(63)).cast("double")))
    out = out.withColumn("_ends", ends)
    used = F.filter(F.zip_with("_runs", "_ends", lambda r, e: F.struct(r["head"].alias("head"), r["type"].alias("type"), e.alias("end"))), lambda r: r["end"] - r["head"].bitwiseAND(F.lit(63)) < n)
    out = out.withColumn("_used", used)
    kind = lambda r: r["type"].bitwiseAND(F.lit(15))
    bezier = lambda r: r["head"].bitwiseAND(F.lit(128)) != 0
    wrong = F.exists("_used", lambda r: (r["head"].bitwiseAND(F.lit(64)) == 0) | (r["head"].bitwiseAND(F.lit(63)) == 0) | (r["end"] > n) | ((kind(r) == 3) & ~bezier(r)) | ((kind(r) == 1) & bezier(r)))
    expanded = F.flatten(F.transform("_used", lambda r: F.array_repeat(r["type"], r["head"].bitwiseAND(F.lit(63)))))
    plain = F.slice("_rest", F.lit(1), n.cast("int"))
    out = out.withColumn("_types", F.when(relative, F.when(~wrong, expanded)).otherwise(plain))
    left = size - F.col("_at") - F.when(relative, 2 * F.size("_used")).otherwise(n)

    def step(s, t):
        kind, shut = t.bitwiseAND(F.lit(15)), t.bitwiseAND(F.lit(128)) != 0
        curve = F.when(kind == 3, (s["curve"] + 1) % 3).otherwise(s["curve"])
        what = (
            F.when((t.bitwiseAND(F.lit(64)) != 0) | ~kind.isin(0, 1, 3), "type")
            .when((kind == 0) & (s["curve"] != 0), "start inside a curve")
            .when((kind != 0) & ~s["open"], "segment without a start")
            .when((kind == 1) & (s["curve"] != 0), "incomplete curve")
            .when(shut & (curve != 0), "close inside a curve")
        )
        return F.struct((s["i"] + 1).alias("i"), (((kind == 0) | s["open"]) & ~shut).alias("open"), curve.cast("int").alias("curve"), F.when(s["what"].isNull(), s["i"]).otherwise(s["place"]).alias("place"), F.coalesce(s["what"], what).alias("what"))

    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("open"), F.lit(0).alias("curve"), F.lit(0).alias("place"), F.lit(None).cast("string").alias("what"))
    out = out.withColumn("_end", F.aggregate("_types", start, step))
    end = F.col("_end")
    said = lambda what, place=None: F.struct((F.lit(None) if place is None else place).cast("int").alias("place"), (F.lit(what) if isinstance(what, str) else what).alias("what"))
    fault = (
        F.when(F.coalesce(F.floor(F.col("_version") / 4096) != 0xDBC01, F.lit(True)), said("signature"))
        .when(~F.coalesce(enough, F.lit(False)), said("point count"))
        .when(F.col("_points").isNull(), said("points"))
        .when(relative & wrong, said("type run"))
        .when((F.size("_types") < n) | (left < 0), said("types"))
        .when(end["what"].isNotNull(), said(end["what"], end["place"]))
        .when(end["curve"] != 0, said("incomplete curve", n))
        .when(left > 3, said("extra data"))
    )
    path = F.struct(F.col("_flags").alias("flags"), F.col("_points").alias("points"), F.col("_types").alias("types"))
    done = out.withColumn("fault", fault).withColumn("path", F.when(F.col("fault").isNull(), path))
    return done.select(*rows.columns, "path", "fault")
