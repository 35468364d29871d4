"""Segmented scans: running state along files of any length, in tasks of bounded size.

What a stretch of records does to a state is summed up as one element, and elements combine: sums, matrices, or what saves and
restores leave of a stack. Each file is cut into blocks. A block's records are combined in order, its sum goes to a scan of
the blocks of its file, which again is cut into blocks, and what stood before a block is combined with what its records saw.
So a file with a third of all records is spread over as many tasks as it has blocks, and no window runs over a whole file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Combine = Callable[[Column, Column], Column]

#: Records of a block at most.
BLOCK = 256

#: A pop that takes whatever was saved last.
ANY = -1


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(rows: DataFrame, keys: list[str], position: str, element: Column, combine: Combine, block: int = BLOCK) -> DataFrame:
    """Adds ``_before`` and ``_upto``: what the elements of a row's file combine to, without and with the row's own.

    ``position`` is a column of whole numbers from 0, each once a file; ``combine(earlier, later)`` must be associative and give the type of
    ``element``. ``_before`` is null on the first row of a file. Null keys are a file like any other; an empty table stays empty.
    """
    most = rows.agg(F.max(position)).first()[0] or 0
    named = rows.select(F.struct(*keys).alias("_key"), F.col(position).cast("long").alias("_at"), F.struct(*rows.columns).alias("_row"), element.alias("_element"))
    done = _level(named, combine, block, most)
    return done.select("_row.*", "_before", "_upto")


def _level(rows: DataFrame, combine: Combine, block: int, most: int) -> DataFrame:
    kind = rows.schema["_element"].dataType.simpleString()
    listed = F.sort_array(F.collect_list(F.struct("_at", "_row", "_element")))
    blocks = rows.groupBy("_key", F.floor(F.col("_at") / block).alias("_block")).agg(listed.alias("_rows"))
    seen = F.aggregate("_rows", F.array().cast(f"array<{kind}>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x["_element"]).otherwise(combine(F.element_at(a, -1), x["_element"])))))
    blocks = blocks.withColumn("_seen", seen)
    each = F.transform("_rows", lambda r, i: F.struct(r["_at"].alias("_at"), r["_row"].alias("_row"), F.get("_seen", i - 1).alias("_before"), F.get("_seen", i).alias("_upto")))
    inside = blocks.select("_key", "_block", F.explode(each).alias("_r")).select("_key", "_block", "_r.*")
    if most < block:
        return inside
    sums = blocks.select("_key", F.col("_block").alias("_at"), F.lit(0).alias("_row"), F.element_at("_seen", -1).alias("_element"))
    carried = _level(sums, combine, block, most // block).select("_key", F.col("_at").alias("_block"), F.col("_before").alias("_carry"))
    both = inside.join(carried, ["_key", "_block"])
    after = lambda c: F.when(F.col("_carry").isNull(), F.col(c)).when(F.col(c).isNull(), F.col("_carry")).otherwise(combine(F.col("_carry"), F.col(c)))
    return both.select("_key", "_at", "_row", after("_before").alias("_before"), after("_upto").alias("_upto"))


# --- what saves and restores leave: {pops, cur, stack} ---


def frame(kind: str, cur: Column, pops: Column | None = None, saves: Column | None = None) -> Column:
    """What one record does: takes entries off the stack by their keys, then saves the state under a key, then changes it by ``cur``.

    ``kind`` is the type of a change; the saved entry is the state as it was, the identity of the caller's changes.
    """
    none = F.array().cast("array<bigint>")
    stack = F.array().cast(f"array<struct<key:bigint,value:{kind}>>")
    return F.struct((none if pops is None else pops).alias("pops"), cur.cast(kind).alias("cur"), (stack if saves is None else saves).alias("stack"))


def stacked(kind: str, identity: Column, then: Combine) -> Combine:
    """Combines frames. The stack's entries and ``cur`` are changes of the state that the stretch began with, or that its last pop brought back.

    A pop of a key takes the latest entry of that key and all above it; what it doesn't find is asked of what stands before.
    """

    def pop(s: Column, key: Column) -> Column:
        keys = F.reverse(F.transform(s["stack"], lambda x: x["key"]))
        where = F.when(key == ANY, F.when(F.size(s["stack"]) > 0, F.size(s["stack"])).otherwise(0)).otherwise(let(F.array_position(keys, key), lambda w: F.when(w > 0, F.size(s["stack"]) - w + 1).otherwise(0))).cast("int")
        found = lambda w: F.struct(s["pops"].alias("pops"), F.get(s["stack"], w - 1)["value"].alias("cur"), F.slice(s["stack"], F.lit(1), w - 1).alias("stack"))
        asked = F.struct(F.concat(s["pops"], F.array(key)).alias("pops"), identity.alias("cur"), F.slice(s["stack"], 1, 0).alias("stack"))
        return let(where, lambda w: F.when(w > 0, found(w)).otherwise(asked))

    def combine(a: Column, b: Column) -> Column:
        popped = F.when(F.size(b["pops"]) == 0, a).otherwise(F.aggregate(b["pops"], a, pop))
        saved = lambda s: F.transform(b["stack"], lambda x: F.struct(x["key"].alias("key"), then(s["cur"], x["value"]).alias("value")))
        return let(popped, lambda s: F.struct(s["pops"].alias("pops"), then(s["cur"], b["cur"]).alias("cur"), F.concat(s["stack"], saved(s)).alias("stack")))

    return combine


# --- changes of a value: {set, v} ---

SET = "struct<set:boolean,v:bigint>"


def keep() -> Column:
    return F.struct(F.lit(False).alias("set"), F.lit(None).cast("bigint").alias("v")).cast(SET)


def put(value: Column) -> Column:
    return F.struct(F.lit(True).alias("set"), value.cast("bigint").alias("v"))


def later_value(a: Column, b: Column) -> Column:
    return F.when(b["set"], b).otherwise(a)


# --- affine matrices, and changes of a world and a container matrix ---

MATRIX = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def matrix(*m) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for x, n in zip(m, "abcdef")])


def identity_matrix() -> Column:
    return matrix(1, 0, 0, 1, 0, 0)


def times(x: Column, y: Column) -> Column:
    """First x, then y: (a b c d e f) takes (px, py) to (a px + c py + e, b px + d py + f)."""
    def product(x: Column, y: Column) -> Column:
        row = lambda p, q: (x[p] * y["a"] + x[q] * y["c"], x[p] * y["b"] + x[q] * y["d"])
        (a, b), (c, d), (e, f) = row("a", "b"), row("c", "d"), row("e", "f")
        return matrix(a, b, c, d, e + y["e"], f + y["f"])

    return let(x, lambda p: let(y, lambda q: product(p, q)))


#: The world becomes ``l`` if ``fixed``, else l * world * r; the container becomes p * world * q * container if ``uses``, else p * container.
CHANGE = f"struct<fixed:boolean,l:{MATRIX},r:{MATRIX},uses:boolean,p:{MATRIX},q:{MATRIX}>"


def change(left: Column | None = None, right: Column | None = None, fixed: bool | Column = False, container: Column | None = None) -> Column:
    """A change of the world; with ``container``, that mapping and the world go to the container, and the world becomes ``left``."""
    one = identity_matrix()
    parts = {"fixed": fixed if isinstance(fixed, Column) else F.lit(fixed), "l": left if left is not None else one, "r": right if right is not None else one}
    parts |= {"uses": F.lit(container is not None), "p": container if container is not None else one, "q": one}
    return F.struct(*[v.alias(k) for k, v in parts.items()]).cast(CHANGE)


def later_change(x: Column, y: Column) -> Column:
    def both(x: Column, y: Column) -> Column:
        left = F.when(y["fixed"], y["l"]).when(x["fixed"], times(times(y["l"], x["l"]), y["r"])).otherwise(times(y["l"], x["l"]))
        right = F.when(y["fixed"] | x["fixed"], y["r"]).otherwise(times(x["r"], y["r"]))
        known = times(times(y["p"], x["l"]), y["q"])  # the world that y's container takes up, where x has fixed it
        p = F.when(y["uses"] & x["fixed"], times(known, x["p"])).when(y["uses"], times(y["p"], x["l"])).otherwise(times(y["p"], x["p"]))
        q = F.when(y["uses"] & ~x["fixed"], times(x["r"], y["q"])).otherwise(x["q"])
        uses = F.when(y["uses"] & ~x["fixed"], True).otherwise(x["uses"])
        return F.struct((x["fixed"] | y["fixed"]).alias("fixed"), left.alias("l"), right.alias("r"), uses.alias("uses"), p.alias("p"), q.alias("q"))

    return let(x, lambda a: let(y, lambda b: both(a, b)))
