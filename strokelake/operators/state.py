"""Ordered per-file state over records: windows where the latest record tells; where a stack is the state, files are stepped through, long ones by segmented scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from . import replay, scan


def _over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def carry(value: Column, keys: list[str], order: list[str]) -> Column:
    """The latest value that isn't null, up to the row itself."""
    return F.last(value, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running(value: Column, keys: list[str], order: list[str]) -> Column:
    return F.sum(value).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


class _Values:
    """A value with saved states; with ``levels`` a restore names its level, and a file ends with its first fault."""

    def __init__(self, initial: int, levels: bool = False, most: int = 0):
        self.initial, self.levels, self.most = initial, levels, most

    def begin(self) -> None:
        self.value, self.stack, self.ended = self.initial, [], False

    def step(self, op: str | None, value: int | None, level: int | None = None) -> tuple | None:
        if self.ended:
            return None
        stack, fault = self.stack, None
        if op == "save":
            if self.levels and len(stack) >= self.most:
                fault = "saved states"
            else:
                stack.append(self.value)
        elif op == "restore":
            if self.levels:
                to = -1 if not level else len(stack) + level if level < 0 else level - 1
                if 0 <= to < len(stack):
                    self.value = stack[to]
                    del stack[to:]
                else:
                    fault = "restore level"
            elif stack:
                self.value = stack.pop()
        elif op == "set":
            self.value = value
        if fault:
            self.ended = True
            return None, None, fault
        return (self.value, len(stack), None) if self.levels else (self.value, len(stack))


def _product(x: tuple | None, y: tuple | None) -> tuple | None:
    """First x, then y; null where either is."""
    if x is None or y is None:
        return None
    a, b, c, d, e, f = x
    p, q, r, s, t, u = y
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


class _Transforms:
    """World and container matrix of EMF+ records, with saves and containers told by their index."""

    ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)

    def begin(self) -> None:
        self.world, self.container, self.stack, self.ended = self.ONE, self.ONE, [], False

    def step(self, op: str | None, index: int | None, *m: float | None) -> tuple | None:
        if self.ended:
            return None
        m = None if None in m else m
        if op == "before":
            self.world = _product(m, self.world)
        elif op == "after":
            self.world = _product(self.world, m)
        elif op == "set":
            self.world = m
        elif op == "reset":
            self.world = self.ONE
        elif op in ("save", "begin"):
            self.stack.append(((index, op == "begin"), self.world, self.container))
            if op == "begin":
                self.world, self.container = self.ONE, _product(_product(m or self.ONE, self.world), self.container)
        elif op in ("restore", "end"):
            key, k = (index, op == "end"), len(self.stack) - 1
            while k >= 0 and (index is None or self.stack[k][0] != key):
                k -= 1
            if k < 0:
                self.ended = True
                return None, None, None, "saved state index"
            _, self.world, self.container = self.stack[k]
            del self.stack[k:]
        named = lambda x: None if x is None else dict(zip("abcdef", x))
        return named(self.world), named(self.container), len(self.stack), None


def _values(rows: DataFrame, keys: list[str], position: str, op: Column, pops: Column, value: Column, initial: int, block: int) -> DataFrame:
    """Adds ``state`` and ``depth`` after each row: ``save`` pushes the value, ``pops`` entries are popped, ``set`` changes it."""
    saves = F.when(op == "save", F.array(F.struct(F.lit(0).cast("bigint").alias("key"), scan.keep().alias("value")))).otherwise(F.array().cast(f"array<struct<key:bigint,value:{scan.SET}>>"))
    element = scan.frame(scan.SET, F.when(op == "set", scan.put(value)).otherwise(scan.keep()), F.array_repeat(F.lit(scan.ANY).cast("bigint"), pops), saves)
    seen = scan.scan(rows, keys, position, element, scan.stacked(scan.SET, scan.keep(), scan.later_value), block)
    cur = F.col("_upto.cur")
    return seen.withColumns({"state": F.when(cur["set"], cur["v"]).otherwise(initial), "depth": F.size("_upto.stack")}).drop("_before", "_upto")


def save_restore(rows: DataFrame, keys: list[str], position: str, op_col: str, value_col: str, initial: int = 0, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``state`` and ``depth`` after each row: ``save`` pushes the value, ``restore`` pops it (nothing if none is saved), ``set`` changes it.

    A file may have any number of records: short ones are stepped through, those of long ones summed up by blocks. There, which restores find a saved
    value is known from the running balance less its least value so far; then what each block does to value and stack is combined.
    ``position`` counts from 0 up, with gaps as it likes; a null operation changes nothing.
    """
    added = StructType.fromDDL("state bigint, depth int")
    long = lambda part: _save_restore(part, keys, position, op_col, value_col, initial, block)
    return replay.replay(rows, keys, position, _Values(initial), [F.col(op_col), F.col(value_col).cast("bigint")], added, long, block * replay.SHORT_BLOCKS)


def _save_restore(rows: DataFrame, keys: list[str], position: str, op_col: str, value_col: str, initial: int, block: int) -> DataFrame:
    op = F.col(op_col)
    step = F.when(op == "save", 1).when(op == "restore", -1).otherwise(0).cast("bigint")
    balance = scan.scan(rows, keys, position, F.struct(step.alias("sum"), F.least(step, F.lit(0).cast("bigint")).alias("low")), lambda a, b: F.struct((a["sum"] + b["sum"]).alias("sum"), F.least(a["low"], a["sum"] + b["low"]).alias("low")), block)
    saved = F.coalesce(F.col("_before.sum") - F.col("_before.low"), F.lit(0))
    known = balance.withColumn("_pops", F.when((op == "restore") & (saved > 0), 1).otherwise(0)).drop("_before", "_upto")
    return _values(known, keys, position, op, F.col("_pops"), F.col(value_col), initial, block).drop("_pops")


#: States that may be saved at a time.
SAVED_STATES = 1024


def restore_levels(rows: DataFrame, keys: list[str], position: str, op_col: str, value_col: str, level_col: str, initial: int = 0, most: int = SAVED_STATES, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``state``, ``depth`` and ``fault``: as ``save_restore``, but a restore names its level, and a file ends with its first fault.

    A level under 0 counts back from the latest saved state, one over 0 from the first. A level of no saved state (0 included)
    is the fault ``restore level``, a save beyond ``most`` states ``saved states``; state and depth are null there, and later rows are left out.
    """
    added = StructType.fromDDL("state bigint, depth int, fault string")
    inputs = [F.col(op_col), F.col(value_col).cast("bigint"), F.col(level_col).cast("bigint")]
    long = lambda part: _restore_levels(part, keys, position, op_col, value_col, level_col, initial, most, block)
    return replay.replay(rows, keys, position, _Values(initial, True, most), inputs, added, long, block * replay.SHORT_BLOCKS)


def _restore_levels(rows: DataFrame, keys: list[str], position: str, op_col: str, value_col: str, level_col: str, initial: int, most: int, block: int) -> DataFrame:
    op, level = F.col(op_col), F.col(level_col).cast("bigint")
    back = (op == "restore") & (level < 0)
    count = F.struct(((op == "restore") & (level > 0)).alias("fixed"), F.when(op == "save", 1).when(back, level).when(op == "restore", level - 1).otherwise(0).cast("bigint").alias("by"))
    counted = scan.scan(rows, keys, position, count, lambda a, b: F.when(b["fixed"], b).otherwise(F.struct(a["fixed"].alias("fixed"), (a["by"] + b["by"]).alias("by"))), block)
    depth = F.coalesce(F.col("_before.by"), F.lit(0))
    to = F.when(level < 0, depth + level).otherwise(level - 1)
    wrong = (level == 0) | (to < 0) | (to >= depth)
    fault = F.when((op == "restore") & F.coalesce(wrong, F.lit(True)), "restore level").when((op == "save") & (depth >= most), "saved states")
    known = counted.withColumns({"fault": fault, "_pops": F.when(op == "restore", depth - to).otherwise(0).cast("int")}).drop("_before", "_upto")
    # The first fault of each file, one row a file at most.
    ends = known.filter("fault is not null").groupBy(F.struct(*keys).alias("_key")).agg(F.min(position).alias("_end"))
    known = known.withColumn("_key", F.struct(*keys)).join(ends, "_key", "left").filter(F.col("_end").isNull() | (F.col(position) <= F.col("_end"))).drop("_key", "_end")
    rest = _values(known.withColumn("_pops", F.when(F.col("fault").isNull(), F.col("_pops")).otherwise(0)), keys, position, F.when(F.col("fault").isNull(), op), F.col("_pops"), F.col(value_col), initial, block)
    sound = F.col("fault").isNull()
    return rest.withColumns({"state": F.when(sound, F.col("state")), "depth": F.when(sound, F.col("depth"))}).select(*rows.columns, "state", "depth", "fault")


def plus_transforms(rows: DataFrame, keys: list[str], position: str, op_col: str, index_col: str, matrix_col: str, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``world`` and ``container`` (matrices of {a, b, c, d, e, f}), ``depth`` and ``fault`` after each EMF+ record that has to do with transforms.

    Operations: ``set``, ``reset``, ``before`` and ``after`` (multiplied in front of or behind the world), ``save`` and ``restore`` with an
    index, ``begin`` and ``end`` of a container with an index. A container takes the mapping of its rectangles (the matrix column;
    null: none), the world and the container around it together; inside, the world begins as the identity. A restore or an end goes
    back to the latest save or container of its index, whatever stands above it; without one it is the fault ``saved state
    index``, which ends the file: its values are null, and later rows are left out.
    """
    added = StructType.fromDDL(f"world {scan.MATRIX}, container {scan.MATRIX}, depth int, fault string")
    inputs = [F.col(op_col), F.col(index_col).cast("bigint"), *[F.col(matrix_col)[n].cast("double") for n in "abcdef"]]
    long = lambda part: _plus_transforms(part, keys, position, op_col, index_col, matrix_col, block)
    return replay.replay(rows, keys, position, _Transforms(), inputs, added, long, block * replay.SHORT_BLOCKS)


def _plus_transforms(rows: DataFrame, keys: list[str], position: str, op_col: str, index_col: str, matrix_col: str, block: int) -> DataFrame:
    op, m, index = F.col(op_col), F.col(matrix_col), F.col(index_col).cast("bigint")
    one = scan.identity_matrix()
    cur = F.when(op == "set", scan.change(m, fixed=True)).when(op == "reset", scan.change(fixed=True)).when(op == "before", scan.change(m)).when(op == "after", scan.change(None, m))
    cur = cur.when(op == "begin", scan.change(fixed=True, container=F.coalesce(m, one))).otherwise(scan.change())
    key = 2 * index + F.when(op.isin("begin", "end"), 1).otherwise(0)
    saves = F.when(op.isin("save", "begin"), F.array(F.struct(key.alias("key"), scan.change().alias("value")))).otherwise(F.array().cast(f"array<struct<key:bigint,value:{scan.CHANGE}>>"))
    pops = F.when(op.isin("restore", "end"), F.array(key)).otherwise(F.array().cast("array<bigint>"))
    seen = scan.scan(rows, keys, position, scan.frame(scan.CHANGE, cur, pops, saves), scan.stacked(scan.CHANGE, scan.change(), scan.later_change), block)
    seen = seen.withColumn("fault", F.when(F.size("_upto.pops") > 0, "saved state index"))
    ends = seen.filter("fault is not null").groupBy(F.struct(*keys).alias("_key")).agg(F.min(position).alias("_end"))
    seen = seen.withColumn("_key", F.struct(*keys)).join(ends, "_key", "left").filter(F.col("_end").isNull() | (F.col(position) <= F.col("_end")))
    sound, c = F.col("fault").isNull(), F.col("_upto.cur")
    # The file begins with the identity for both, so a world that isn't fixed is l * r.
    world = F.when(c["fixed"], c["l"]).otherwise(scan.times(c["l"], c["r"]))
    container = F.when(c["uses"], scan.times(c["p"], c["q"])).otherwise(c["p"])
    return seen.withColumns({"world": F.when(sound, world), "container": F.when(sound, container), "depth": F.when(sound, F.size("_upto.stack"))}).select(*rows.columns, "world", "container", "depth", "fault")


def allocate_slots(rows: DataFrame, keys: list[str], order: list[str], op_col: str, handle_col: str, slots: int) -> DataFrame:
    """Adds ``slot`` and ``fault``: ``create`` takes the lowest free slot, ``delete`` frees the one its handle names, ``select`` uses it.

    A creation without a free slot and a handle that names none in use are faults; a file ends with its first, and later rows are left out.
    The free slots are a heap, so each file is folded in order inside its group: ``keys`` should name files of bounded size.
    """
    kind = rows.schema.simpleString()[7:-1] + ",slot:int,fault:string"

    def fold(frame):
        import heapq

        import pandas as pd

        frame = frame.sort_values(order, ignore_index=True)
        free, used, out, fault = list(range(slots)), set(), [], None
        for op, handle in zip(frame[op_col], frame[handle_col]):
            slot = None
            if op == "create":
                if free:
                    slot = heapq.heappop(free)
                    used.add(slot)
                else:
                    fault = "slots"
            elif op in ("delete", "select"):
                if handle in used:
                    slot = int(handle)
                    if op == "delete":
                        used.remove(slot)
                        heapq.heappush(free, slot)
                else:
                    fault = "undefined handle"
            out.append((slot, fault))
            if fault:
                break
        return frame.head(len(out)).assign(slot=pd.array([s for s, _ in out], "Int32"), fault=[f for _, f in out])

    return rows.groupBy(*keys).applyInPandas(fold, kind.replace(":", " ").replace(",", ", "))


#: Handles of stock objects have the top bit set; these numbers name none.
STOCK, NO_STOCK = 0x80000000, (9, 15)


def resolve_handles(rows: DataFrame, keys: list[str], order: list[str], op_col: str, handle_col: str, kind_col: str, slots: int = 65_536) -> DataFrame:
    """Adds ``object`` and ``fault`` to records that create, select or delete objects by handle.

    ``object`` is the place (the last of ``order``) of the creation that a record refers to; null for stock objects. Each
    handle's latest creation or deletion before a record tells whether it is in use, so the windows run by file and handle.
    A creation needs a free handle from 1 below ``slots``; a selection one in use that isn't a palette or a colour space, or a
    stock object; a deletion one in use. A stream ends at its first fault: take the least place with one of each file.
    """
    op, handle = F.col(op_col), F.col(handle_col)
    before = _over([*keys, handle_col], order).rowsBetween(Window.unboundedPreceding, -1)
    effect = F.when(op == "create", F.struct(F.col(order[-1]).alias("object"), F.col(kind_col).alias("kind"), F.lit(True).alias("alive"))).when(op == "delete", F.struct(F.lit(None).cast(rows.schema[order[-1]].dataType).alias("object"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("alive")))
    last = F.last(effect, ignorenulls=True).over(before)
    alive, stock = F.coalesce(last["alive"], F.lit(False)), handle >= STOCK
    number = handle - STOCK
    fault = (
        F.when((op == "create") & ((handle <= 0) | (handle >= slots) | alive), "creation handle")
        .when((op == "select") & stock & ((number > 19) | number.isin(*NO_STOCK)), "stock object")
        .when((op == "delete") & stock, "stock object")
        .when(op.isin("select", "delete") & ~stock & ~alive, "undefined handle")
        .when((op == "select") & ~stock & last["kind"].isin("palette", "colour space"), "not selectable")
    )
    refers = F.when(op.isin("select", "delete") & ~stock, last["object"])
    return rows.withColumns({"fault": fault, "object": F.when(fault.isNull(), refers)})


def resolve_objects(rows: DataFrame, keys: list[str], order: list[str], created: Column) -> Column:
    """The object that a use refers to: the latest created before the row, if any."""
    return F.last(created, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def select_stream(rows: DataFrame, keys: list[str], order: list[str], format_col: str = "format", type_col: str = "type") -> DataFrame:
    """Records that are played: all EMF+ records, EMF ones of types 1, 14 and 70, and others while the latest EMF+ record was GetDC."""
    plus = F.col(format_col) == "EMF+"
    passing = carry(F.when(plus, F.col(type_col) == 0x4004), keys, order)
    return rows.withColumn("_get_dc", F.coalesce(passing, F.lit(False))).filter(plus | F.col(type_col).isin(1, 14, 70) | F.col("_get_dc")).drop("_get_dc")


def path_bracket(rows: DataFrame, keys: list[str], order: list[str], op_col: str) -> DataFrame:
    """Adds ``fault``: a begin inside a bracket, an end without one, a draw without an ended path; null otherwise.

    The state before a row is what its latest begin, end or draw left: open, ended or none.
    """
    op = F.col(op_col)
    effect = F.when(op == "begin", 1).when(op == "end", 2).when(op == "draw", 0)
    before = F.coalesce(F.last(effect, ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fault = F.when((op == "begin") & (before == 1), "nested begin").when((op == "end") & (before != 1), "end without begin").when((op == "draw") & (before != 2), "draw without end")
    return rows.withColumn("fault", fault)


def open_brackets(rows: DataFrame, keys: list[str], order: list[str], op_col: str) -> DataFrame:
    """``keys, order`` of the begin of each file whose path bracket is still open at its end; a grouping, combined before the shuffle."""
    latest = rows.filter(F.col(op_col).isin("begin", "end", "draw")).groupBy(*keys).agg(F.max(F.struct(*order, F.col(op_col).alias("_op"))).alias("_last"))
    return latest.filter("_last._op = 'begin'").select(*keys, *[F.col(f"_last.{c}").alias(c) for c in order])


def bind_effects(rows: DataFrame, keys: list[str], order: list[str], described: Column, used: Column) -> DataFrame:
    """Adds ``effect`` and ``fault`` to records: a draw that uses an effect has the place (the last of ``order``) of the latest description before it.

    ``described`` tells records that hold a serialized effect, ``used`` draws with the effect flag. A description stays in force
    until the next one; a draw that uses one before any has a fault. Null conditions count as false.
    """
    described, used = F.coalesce(described, F.lit(False)), F.coalesce(used, F.lit(False))
    latest = F.last(F.when(described, F.col(order[-1])), ignorenulls=True).over(_over(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"effect": F.when(used, latest), "fault": F.when(used & latest.isNull(), "effect without description")})


def sprite_pairs(rows: DataFrame, keys: list[str], order: list[str], rop_col: str, same: list[str]) -> DataFrame:
    """Adds ``fused``: true on a mask (SRCAND) followed at once by its image (SRCPAINT) with equal placement."""
    over = _over(keys, order)
    follows = (F.col(rop_col) == "SRCAND") & (F.lead(rop_col).over(over) == "SRCPAINT")
    for c in same:
        follows = follows & F.lead(c).over(over).eqNullSafe(F.col(c))
    return rows.withColumn("fused", F.coalesce(follows, F.lit(False)))


def over_budget(rows: DataFrame, keys: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """Adds ``used`` and ``over``: whether the running sum is past the limit."""
    return rows.withColumn("used", running(size, keys, order)).withColumn("over", F.col("used") > limit)
