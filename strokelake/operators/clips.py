"""Region trees and clips as spans: areas are rectangles of a surface, cut into bands between their edges.

A region tree is stored in preorder; a running balance gives every node its parent, and levels are combined from the deepest up,
all trees at once. A clip is a list of operations that don't commute; what a place makes of it is a fold over the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import batches

# Node types of the published format: five operations, then the kinds of leaves.
AND, OR, XOR, EXCLUDE, COMPLEMENT, RECT, PATH, EMPTY, INFINITE = 1, 2, 3, 4, 5, 0x10000000, 0x10000001, 0x10000002, 0x10000003

#: Levels of a tree, and operations of a clip at most.
NESTING, CLIP_STEPS = 256, 4096


def _keep(how: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What an operation keeps: 1 both, 2 any, 3 one of both, 4 the first without the second, 5 the second without the first."""
    return np.select([how == AND, how == OR, how == XOR, how == EXCLUDE, how == COMPLEMENT], [a & b, a | b, a != b, a & ~b, ~a & b], False)


def _links(type_: np.ndarray, tree: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parents (-1 for none), which nodes are left children, and the fault of each tree ("" for none), from nodes in preorder.

    The balance before a node counts the operations so far less the leaves. A node behind an operation is its left child; any other
    is the right child of the latest operation of the same balance. A node for which there is none is beyond the tree; a tree
    whose balance doesn't end at -1 lacks nodes.
    """
    op = (type_ >= AND) & (type_ <= COMPLEMENT)
    step = np.where(op, 1, -1)
    before = np.cumsum(step) - step
    balance = before - before[first][tree]
    known = op | np.isin(type_, (RECT, EMPTY, INFINITE))
    faults = [np.logical_or.reduceat(~known, first), np.logical_or.reduceat(balance < 0, first), np.add.reduceat(step, first) != -1]
    fault = np.select(faults, ["node type", "extra nodes", "missing nodes"], "")
    at = np.arange(len(op))
    left = np.append(False, op[:-1])
    left[first] = False
    # Nodes of one balance of one tree stand together, in order; the latest operation before each is its parent.
    order = np.lexsort((balance, tree))
    latest = np.append(-1, np.maximum.accumulate(np.where(op[order], at, -1))[:-1])
    found = np.where(latest >= 0, order[latest], -1)
    own = (found >= 0) & (tree[found] == tree[order]) & (balance[found] == balance[order])
    parent = np.empty(len(op), "int64")
    parent[order] = np.where(own, found, -1)
    return np.where(left, at - 1, parent), left, fault


def _levels(parent: np.ndarray) -> np.ndarray:
    """The level of each node, by jumps of doubling reach."""
    level, reach = (parent >= 0).astype("int64"), parent.copy()
    at = np.flatnonzero(reach >= 0)
    while len(at):
        to = reach[at]
        level[at], reach[at] = level[at] + level[to], reach[to]
        at = at[reach[at] >= 0]
    return level


def _ordered(line: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The order by line, then by x, both whole numbers from 0."""
    wide = int(x.max(initial=0)) + 1
    return np.argsort(line * wide + x) if (int(line.max(initial=0)) + 1) * wide < 2**62 else np.lexsort((x, line))


class _Trees:
    """Many trees at once: levels are combined from the deepest up, by running sums along the bands of each node."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def evaluate(self, rows: pa.Table) -> pa.Table:
        first = np.flatnonzero(batches.beginnings(rows, self.keys))
        tree = np.repeat(np.arange(len(first)), np.diff(np.append(first, rows.num_rows)))
        type_ = pc.fill_null(rows.column("_type"), -1).to_numpy()
        parent, left, fault = _links(type_, tree, first)
        sound = fault[tree] == ""
        level = np.zeros(len(tree), "int64")
        level[sound] = _levels(np.where(sound, parent, -1))[sound]
        deep = np.zeros(len(first), bool)
        deep[tree[level > NESTING]] = True
        fault = np.where(deep, "nesting", fault)
        box = [rows.column(c) for c in ("_l", "_t", "_r", "_b")]
        leaf = np.flatnonzero((fault[tree] == "") & np.isin(type_, (RECT, INFINITE)) & pc.fill_null(pc.and_(pc.greater(box[2], box[0]), pc.greater(box[3], box[1])), False).to_numpy())
        l, t, r, b = (c.take(leaf).to_numpy() for c in box)
        # Bands lie between all edges of a tree; they and the places across are numbered.
        ys, y = np.unique(np.concatenate([t, b]), return_inverse=True)
        xs, x = np.unique(np.concatenate([l, r]), return_inverse=True)
        (top, bottom), (begin, end) = (v.reshape(2, len(leaf)) for v in (y, x))
        edges = np.unique(tree[leaf] * (len(ys) + 1) + np.array([top, bottom]))
        low, high = (np.searchsorted(edges, tree[leaf] * (len(ys) + 1) + v) for v in (top, bottom))
        each = np.repeat(np.arange(len(leaf)), high - low)
        band = np.arange(len(each)) - (np.cumsum(high - low) - high)[each]
        node, x0, x1 = leaf[each], begin[each], end[each]
        by_level = np.argsort(level[node], kind="stable")
        node, band, x0, x1 = node[by_level], band[by_level], x0[by_level], x1[by_level]
        deepest = int(level[node[-1]]) if len(node) else 0
        part = np.searchsorted(level[node], np.arange(deepest + 2))
        spans = [v[:0] for v in (node, band, x0, x1)]
        for n in range(deepest, -1, -1):
            spans = [np.concatenate([s, v[part[n] : part[n + 1]]]) for s, v in zip(spans, (node, band, x0, x1))]
            if n:
                spans = self.above(*spans, parent, left, type_)
        node, band, x0, x1 = spans
        out = rows.select(self.keys).take(first[tree[node]])
        for name, value in (("y0", ys[edges[band] % (len(ys) + 1)]), ("y1", ys[edges[np.minimum(band + 1, len(edges) - 1)] % (len(ys) + 1)]), ("x0", xs[x0]), ("x1", xs[x1])):
            out = out.append_column(name, pa.array(value, rows.schema.field("_l").type))
        out = out.append_column("fault", pa.nulls(out.num_rows, pa.string()))
        bad = np.flatnonzero(fault != "")
        wrong = rows.select(self.keys).take(first[bad])
        for name in ("y0", "y1", "x0", "x1"):
            wrong = wrong.append_column(name, pa.nulls(len(bad), out.schema.field(name).type))
        return pa.concat_tables([out, wrong.append_column("fault", pa.array(fault[bad].tolist(), pa.string()))])

    @staticmethod
    def above(node, band, x0, x1, parent, left, type_):
        """The spans of the parents of nodes of one level."""
        up = np.tile(parent[node], 2)
        sides, bands, x = np.tile(left[node], 2), np.tile(band, 2), np.concatenate([x0, x1])
        step = np.repeat([1, -1], len(node))
        wide = int(bands.max(initial=0)) + 1
        line = up * wide + bands
        order = _ordered(line, x)
        line, x, up, bands = line[order], x[order], up[order], bands[order]
        step, sides = step[order], sides[order]
        a, b = np.cumsum(np.where(sides, step, 0)), np.cumsum(np.where(sides, 0, step))
        last = np.append((line[1:] != line[:-1]) | (x[1:] != x[:-1]), True)[: len(x)]
        # Each line ends with nothing covered, so the sums need no new beginning.
        line, x, up, bands = line[last], x[last], up[last], bands[last]
        inside = _keep(type_[up], a[last] > 0, b[last] > 0)
        turn = np.flatnonzero(inside != np.append(False, inside[:-1])[: len(inside)])
        on, off = turn[::2], turn[1::2]
        return [up[on], bands[on], x[on], x[off]]

    def run(self, given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches.whole_groups(given, self.keys):
            yield from self.evaluate(rows).combine_chunks().to_batches()


def evaluate_trees(nodes: DataFrame, keys: list[str], surface: tuple, position: str = "node", type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """Spans ``keys, y0, y1, x0, x1`` of region trees on a surface (left, top, right, bottom), and ``keys, fault`` of those that are no trees.

    Nodes have ``left, top, right, bottom`` where they are rectangles; the infinite region is the whole surface. Rectangles may be empty,
    a region without area has no span. Keys may be null. Trees are bounded by the object limits: nodes are shuffled once by tree, and each
    task works on many trees at once. A tree of more than ``NESTING`` levels below its root is the fault ``nesting``.
    """
    x0, y0, x1, y1 = (F.lit(v) for v in surface)
    infinite = F.col(type_col) == INFINITE
    box = {
        "_l": F.when(infinite, x0).otherwise(F.greatest("left", x0)), "_t": F.when(infinite, y0).otherwise(F.greatest("top", y0)),
        "_r": F.when(infinite, x1).otherwise(F.least("right", x1)), "_b": F.when(infinite, y1).otherwise(F.least("bottom", y1)),
    }
    given = nodes.select(*keys, F.col(position).alias("_node"), F.col(type_col).cast("long").alias("_type"), *[v.alias(k) for k, v in box.items()])
    dealt = given.repartition(*keys).sortWithinPartitions(*keys, "_node")
    number = dealt.schema["_l"].dataType
    kind = T.StructType([*[dealt.schema[k] for k in keys], *[T.StructField(c, number) for c in ("y0", "y1", "x0", "x1")], T.StructField("fault", T.StringType())])
    made = dealt.mapInArrow(_Trees(keys).run, kind)
    return made.filter("fault is null").drop("fault"), made.filter("fault is not null").select(*keys, "fault")


def clip_spans(steps: DataFrame, keys: list[str], position: str, surface: tuple, most: int = CLIP_STEPS) -> tuple[DataFrame, DataFrame]:
    """Spans ``keys, y0, y1, x0, x1`` of each file's clip after its last step, on a surface, and ``keys, fault`` of files with too many steps.

    Steps are ``op`` with ``left, top, right, bottom`` or ``dx, dy``: ``replace``, ``intersect``, ``union``, ``xor``, ``difference``
    (the clip less the area), ``complement`` (the area less the clip), ``offset`` of the clip so far, ``reset`` to no clip, and ``meta``, which
    keeps what the clip allows for good, out of reach of later steps, and begins anew without a clip. Without a clip everything is inside.
    Null operations change nothing. Offsets of a clip move the areas of all steps before them; what stands before the
    latest replacement has no say. More than ``most`` steps that count are the fault ``clip steps``.
    """
    op = F.coalesce(F.col("op"), F.lit(""))
    file = Window.partitionBy("_key")
    before = file.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = steps.select(F.struct(*keys).alias("_key"), F.col(position).alias("_at"), op.alias("_op"), "left", "top", "right", "bottom", F.when(op == "offset", F.col("dx")).otherwise(0).alias("_dx"), F.when(op == "offset", F.col("dy")).otherwise(0).alias("_dy"))
    # Only what counts goes on: by part between two meta steps, what follows the latest replacement.
    rows = rows.filter("_op <> ''").withColumn("_part", F.coalesce(F.count_if(F.col("_op") == "meta").over(before), F.lit(0)))
    part = Window.partitionBy("_key", "_part")
    rows = rows.withColumns({"_from": F.max(F.when(F.col("_op").isin("replace", "reset"), F.col("_at"))).over(part)})
    after = part.orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"_sx": F.coalesce(F.sum("_dx").over(after), F.lit(0)), "_sy": F.coalesce(F.sum("_dy").over(after), F.lit(0))})
    rows = rows.filter("_op <> 'offset' and (_from is null or _at >= _from)")
    step = F.struct("_at", "_op", (F.col("left") + F.col("_sx")).alias("l"), (F.col("top") + F.col("_sy")).alias("t"), (F.col("right") + F.col("_sx")).alias("r"), (F.col("bottom") + F.col("_sy")).alias("b"))
    counted = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    faults = counted.filter(F.col("_n") > most).select("_key.*", F.lit("clip steps").alias("fault"))
    all_keys = steps.select(F.struct(*keys).alias("_key")).distinct()
    few = rows.join(counted.filter(F.col("_n") <= most), "_key").groupBy("_key").agg(F.sort_array(F.collect_list(step)).alias("_s"))  # ``most`` a file
    # A file whose steps all lost their say, or that has none, is unclipped.
    files = all_keys.join(few, "_key", "left").join(counted.filter(F.col("_n") > most).select("_key"), "_key", "left_anti")
    x0, y0, x1, y1 = surface
    files = files.withColumn("_s", F.coalesce("_s", F.slice(F.array(F.struct(*[F.lit(None).cast(few.schema["_s"].dataType.elementType[n].dataType).alias(n) for n in ("_at", "_op", "l", "t", "r", "b")])), 1, 0)))

    def cuts(s: Column, a: str, b: str, low, high) -> Column:
        at = F.flatten(F.transform(s, lambda x: F.array(x[a], x[b])))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(low), F.lit(high)), F.filter(at, lambda v: (v > low) & (v < high)))))

    pairs = lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda v, i: F.struct(v.alias("p"), F.get(c, i + 1).alias("q")))
    bands = files.withColumn("_ys", cuts(F.col("_s"), "t", "b", y0, y1)).select("_key", "_s", F.explode(pairs(F.col("_ys"))).alias("_y"))
    bands = bands.withColumn("_xs", cuts(F.filter("_s", lambda x: (x["t"] <= F.col("_y.p")) & (x["b"] >= F.col("_y.q"))), "l", "r", x0, x1))

    def allowed(x: Column) -> Column:
        def one(state: Column, s: Column) -> Column:
            a = F.coalesce((s["l"] <= x["p"]) & (s["r"] >= x["q"]) & (s["t"] <= F.col("_y.p")) & (s["b"] >= F.col("_y.q")), F.lit(False))
            c, how = state["c"], s["_op"]
            now = F.when(how == "replace", a).when(how == "intersect", c & a).when(how == "union", c | a).when(how == "xor", c != a).when(how == "difference", c & ~a).when(how == "complement", ~c & a).when(how.isin("reset", "meta"), True).otherwise(c)
            return F.struct((state["m"] & F.when(how == "meta", c).otherwise(True)).alias("m"), now.alias("c"))

        return F.aggregate("_s", F.struct(F.lit(True).alias("m"), F.lit(True).alias("c")), one, lambda s: s["m"] & s["c"])

    seen = bands.select("_key", "_y", F.transform(pairs(F.col("_xs")), lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"), allowed(x).alias("in"))).alias("_i"))
    # Neighbouring stretches that are inside are one span.
    turns = F.filter(F.transform("_i", lambda v, k: F.struct(v["p"].alias("p"), v["in"].alias("in"), F.coalesce(F.get("_i", k - 1)["in"], F.lit(False)).alias("was"))), lambda v: v["in"] != v["was"])
    turned = seen.select("_key", "_y", turns.alias("_t"))
    spans = F.filter(F.transform("_t", lambda v, k: F.struct(v["p"].alias("x0"), F.coalesce(F.get("_t", k + 1)["p"], F.lit(x1)).alias("x1"), v["in"].alias("in"))), lambda v: v["in"])
    return turned.select("_key.*", F.col("_y.p").alias("y0"), F.col("_y.q").alias("y1"), F.explode(spans).alias("_x")).select(*keys, "y0", "y1", "_x.x0", "_x.x1"), faults
