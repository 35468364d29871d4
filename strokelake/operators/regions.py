"""Regions as half-open spans on scan lines, combined by sweeps: window sums over edges, never pairs of rectangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import batches

#: Lines and columns of a tile of the plane.
TILE = (64, 4096)

#: Scan lines of a band; one band has y = 0 in its middle.
BAND = 1024

#: What each operation keeps, from the two coverings.
OPERATIONS = {
    "intersect": lambda a, b: a & b,
    "union": lambda a, b: a | b,
    "xor": lambda a, b: a != b,
    "difference": lambda a, b: a & ~b,
}


def scan_lines(rects: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y, x0, x1`` of rectangles ``left, top, right, bottom``; empty ones give nothing."""
    rects = rects.filter("right > left and bottom > top")
    return rects.select(*keys, F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)).alias("y"), F.col("left").alias("x0"), F.col("right").alias("x1"))


def combine(a: DataFrame, b: DataFrame, keys: list[str], operation: str) -> DataFrame:
    """``keys, y, x0, x1``: disjoint maximal spans of ``a operation b``, both as spans.

    Edges add to two running coverings along each line; neighbouring stretches of equal verdict are merged.
    """
    edges = None
    for side, frame in ((0, a), (1, b)):
        for at, sign in (("x0", 1), ("x1", -1)):
            part = frame.select(*keys, "y", F.col(at).alias("x"), F.lit(sign if side == 0 else 0).alias("da"), F.lit(sign if side == 1 else 0).alias("db"))
            edges = part if edges is None else edges.unionByName(part)
    edges = edges.groupBy(*keys, "y", "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    line = Window.partitionBy(*keys, "y").orderBy("x")
    covered = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = OPERATIONS[operation](F.sum("da").over(covered) > 0, F.sum("db").over(covered) > 0)
    marked = edges.withColumn("inside", inside)
    turns = marked.withColumn("_was", F.coalesce(F.lag("inside").over(line), F.lit(False))).filter("inside <> _was")
    return turns.withColumn("x1", F.lead("x").over(line)).filter("inside").select(*keys, "y", F.col("x").alias("x0"), "x1")


def union(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Disjoint maximal spans covered by any rectangle."""
    spans = scan_lines(rects, keys)
    return combine(spans, spans.limit(0), keys, "union")


def _joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of stretches on one axis."""
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > end[:-1])
    return start[first], end[np.append(np.flatnonzero(first[1:]), len(end) - 1)]


def _covered(starts: list[np.ndarray], ends: list[np.ndarray], times: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that so many of the given ones cover."""
    turns = np.sort(np.concatenate([x * 2 + 1 for x in starts] + [x * 2 for x in ends]))
    at = np.flatnonzero(np.cumsum((turns & 1) * 2 - 1) == times)
    return turns[at] >> 1, turns[at + 1] >> 1


class _Tiles:
    """The frames of many tiles at once: their scan lines, each with its margin, stand behind one another on one axis."""

    def __init__(self, keys: list[str], width: int, height: int):
        self.keys, self.width, self.height = [*keys, "_ty", "_tx"], width, height
        self.lines, self.stride = TILE[0] + 2 * height, TILE[1] + 2 * width + 1

    def union(self, rows: pa.Table, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, top, right, bottom = (rows.column(c).to_numpy().astype("int64") for c in ("_l", "_t", "_r", "_b"))
        high = bottom - top
        which = np.repeat(np.arange(len(high)), high)
        y = np.arange(len(which)) - (np.cumsum(high) - high - top)[which]
        line = (tile[which] * self.lines + y) * self.stride
        return _joined(line + left[which], line + right[which])

    def shorter(self, rows: pa.Table) -> pa.Table:
        """The rectangles of one tile as the spans of their union, of which a tile holds a bounded number."""
        start, end = self.union(rows, np.zeros(rows.num_rows, "int64"))
        if len(start) >= rows.num_rows:
            return rows
        y, out = start // self.stride, rows.slice(0, 1).take(np.zeros(len(start), "int64"))
        for name, value in (("_l", start % self.stride), ("_t", y), ("_r", end - y * self.stride), ("_b", y + 1)):
            out = out.set_column(out.schema.get_field_index(name), out.schema.field(name), pa.array(value.astype("int32")))
        return out

    def frames(self, rows: pa.Table) -> pa.Table:
        w, h, stride, lines = self.width, self.height, self.stride, self.lines
        new = batches.beginnings(rows, self.keys)
        start, end = self.union(rows, np.cumsum(new) - 1)
        line = start // stride
        a, b, y = start + w, end - w, line % lines
        thick, a_all, b_all = b > a, [], []
        for d in range(-h, h + 1):
            near = thick & (y + d >= h) & (y + d < h + TILE[0])
            a_all.append(a[near] + d * stride)
            b_all.append(b[near] + d * stride)
        core = _covered(a_all, b_all, 2 * h + 1)
        a, b = np.maximum(start, line * stride + w), np.minimum(end, line * stride + w + TILE[1])
        inner = (y >= h) & (y < h + TILE[0]) & (b > a)
        start, end = _covered([a[inner], core[1]], [b[inner], core[0]], 1)
        line = start // stride
        tile, y, x0, x1 = line // lines, line % lines, start % stride, end - line * stride
        # Equal spans on lines that follow one another are one box, which is fewer rows to hand over.
        size = (int(tile[-1]) + 1 if len(tile) else 1) * stride * stride * lines
        y1 = y + 1
        if size < 2**62:
            packed = np.sort(((tile * stride + x0) * stride + x1) * lines + y)
            begins = np.append(True, packed[1:] != packed[:-1] + 1)[: len(packed)] | (packed % lines == 0)
            at = np.flatnonzero(begins)
            first, y = packed[at], packed[at] % lines
            y1 = y + np.diff(np.append(at, len(packed)))
            tile, x0, x1 = first // lines // stride // stride, first // lines // stride % stride, first // lines % stride
        of = np.flatnonzero(new)[tile]
        out = rows.select(self.keys).take(of)
        ty, tx = (out.column(c).to_numpy() for c in ("_ty", "_tx"))
        made = {"y0": ty * TILE[0] + y - h, "y1": ty * TILE[0] + y1 - h, "x0": tx * TILE[1] + x0 - w, "x1": tx * TILE[1] + x1 - w}
        out = out.select(self.keys[:-2])
        for name, value in made.items():
            out = out.append_column(name, pa.array(value))
        return out

    def run(self, given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches.whole_groups(given, self.keys, self.shorter):
            yield from self.frames(rows).to_batches()


def frame_boxes(rects: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """``keys, y0, y1, x0, x1``: disjoint boxes of the places of the region within ``width`` and ``height`` of its outside: the region less itself shrunk by that box.

    The plane is cut into tiles; a rectangle goes to each tile that it or its margin touches, and what is more than a margin away has no
    say. So rectangles are shuffled once, as such, and lines are made inside the tasks. Boxes end at the edges of tiles.
    """
    tall, wide = TILE
    down = F.sequence(F.floor((F.col("top") - height) / tall), F.floor((F.col("bottom") + (height - 1)) / tall))
    across = F.sequence(F.floor((F.col("left") - width) / wide), F.floor((F.col("right") + (width - 1)) / wide))
    rows = rects.filter("right > left and bottom > top").withColumn("_ty", F.explode(down)).withColumn("_tx", F.explode(across))
    # Places count from the corner of the tile's margin and end with it.
    local = lambda c, tile, size, margin: F.greatest(F.lit(0), F.least(F.lit(size + 2 * margin), F.col(c) - F.col(tile) * size + margin)).cast("int")
    rows = rows.select(*keys, "_ty", "_tx", local("left", "_tx", wide, width).alias("_l"), local("top", "_ty", tall, height).alias("_t"), local("right", "_tx", wide, width).alias("_r"), local("bottom", "_ty", tall, height).alias("_b"))
    dealt = rows.repartition(*keys, "_ty", "_tx").sortWithinPartitions("_ty", "_tx", *keys)
    kind = T.StructType([*[dealt.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("y0", "y1", "x0", "x1")]])
    made = dealt.mapInArrow(_Tiles(keys, width, height).run, kind)
    as_given = {c: F.col(c).cast(rects.schema[of].dataType) for c, of in (("y0", "top"), ("y1", "top"), ("x0", "left"), ("x1", "left"))}
    return made.withColumns(as_given)


def frame(rects: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """``keys, y, x0, x1``: the spans of ``frame_boxes``, line by line."""
    return frame_boxes(rects, keys, width, height).select(*keys, F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")


class _Sweep:
    """The crossings of many shapes' edges with the middles of scan lines, by the even-odd or the non-zero rule."""

    def __init__(self, keys: list[str], even_odd: bool, totals: bool):
        self.keys, self.even_odd, self.totals = [*keys, "_band"], even_odd, totals

    def crossings(self, rows: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line (numbered through all groups), place and direction of each crossing, in the order of lines and places."""
        x0, y0, x1, y1 = (rows.column(c).to_numpy().astype("float64") for c in ("x0", "y0", "x1", "y1"))
        begin = rows.column("_band").to_numpy() * BAND - BAND // 2
        fine = np.isfinite(x0) & np.isfinite(x1) & np.isfinite(y0) & np.isfinite(y1)
        low, high = (np.where(fine, f(y0, y1), 0) for f in (np.minimum, np.maximum))
        first, last = np.maximum(np.ceil(low - 0.5), begin), np.minimum(np.ceil(high - 0.5), begin + BAND)
        n = np.maximum(last - first, 0).astype("int64")
        e = np.repeat(np.arange(len(n)), n)
        y = np.arange(len(e)) - (np.cumsum(n) - n)[e] + first[e]
        x = x0[e] + (y + 0.5 - y0[e]) * (x1 - x0)[e] / (y1 - y0)[e]
        line = group[e] * BAND + (y - begin[e]).astype("int64")
        order = np.lexsort((x, line))
        return line[order], x[order], np.where(y1 > y0, 1, -1)[e][order]

    def spans(self, line: np.ndarray, x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.even_odd:
            at = np.arange(len(line))
            start = np.maximum.accumulate(np.where(np.append(True, line[1:] != line[:-1])[: len(line)], at, 0))
            inside = (at - start) % 2 == 0
        else:
            last = np.append((line[1:] != line[:-1]) | (x[1:] != x[:-1]), True)[: len(line)]
            line, x, total = line[last], x[last], np.cumsum(turn)[last]
            start = np.append(True, line[1:] != line[:-1])[: len(line)]
            before = np.append(0, total[:-1])[: len(line)]
            inside = total - before[np.maximum.accumulate(np.where(start, np.arange(len(line)), 0))] != 0
            change = inside != (np.append(False, inside[:-1])[: len(line)] & ~start)
            line, x, inside = line[change], x[change], inside[change]
        on = np.flatnonzero(inside[:-1] & (line[1:] == line[:-1]))
        return line[on], x[on], x[on + 1]

    def made(self, rows: pa.Table) -> pa.Table:
        new = batches.beginnings(rows, self.keys)
        line, x0, x1 = self.spans(*self.crossings(rows, np.cumsum(new) - 1))
        group, heads = line // BAND, rows.select(self.keys).take(np.flatnonzero(new))
        if self.totals:
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
            fresh = np.append(True, line[1:] != line[:-1])[: len(line)].astype("int64")
            sums = [np.diff(np.append(first, len(group))), *(np.add.reduceat(v, first) if len(first) else v[:0] for v in (fresh, x1 - x0))]
            columns, group = dict(zip(("n_spans", "n_lines", "covered"), sums)), group[first]
        else:
            columns = {"y": (heads.column("_band").to_numpy()[group] * BAND - BAND // 2 + line % BAND).astype("int32"), "x0": x0, "x1": x1}
        out = heads.select(self.keys[:-1]).take(group)
        for name, value in columns.items():
            out = out.append_column(name, pa.array(value))
        return out

    def run(self, given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches.whole_groups(given, self.keys):
            yield from self.made(rows).combine_chunks().to_batches()

    def over(self, dealt: DataFrame) -> DataFrame:
        """The spans, or the totals by key, of edges that stand together by key and band."""
        keys = self.keys[:-1]
        columns = [("n_spans", T.LongType()), ("n_lines", T.LongType()), ("covered", T.DoubleType())] if self.totals else [("y", T.IntegerType()), ("x0", T.DoubleType()), ("x1", T.DoubleType())]
        kind = T.StructType([*[dealt.schema[k] for k in keys], *[T.StructField(n, t) for n, t in columns]])
        swept = dealt.select(*self.keys, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).mapInArrow(self.run, kind)
        return swept.groupBy(*keys).agg(*[F.sum(n).alias(n) for n, _ in columns]) if self.totals else swept


def _dealt(shapes: DataFrame, keys: list[str], ys: list[str]) -> DataFrame:
    """Shapes shuffled once, as such, to the bands of scan lines between their lowest and highest y; lines are made inside the tasks."""
    band = lambda f: F.floor((f(*ys) + BAND // 2) / BAND)
    return shapes.withColumn("_band", F.explode(F.sequence(band(F.least), band(F.greatest)))).repartition(*keys, "_band").sortWithinPartitions(*keys, "_band")


def even_odd_spans(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y, x0, x1``: interior spans at the middle of each scan line from polygon edges ``x0, y0, x1, y1``, even-odd.

    An edge counts on the lines whose middle lies in its half-open range of y.
    """
    return _Sweep(keys, True, False).over(_dealt(edges, keys, ["y0", "y1"]))


def even_odd_totals(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_spans, n_lines, covered`` of ``even_odd_spans``: spans, lines that have one, and summed widths, for keys with any."""
    return _Sweep(keys, True, True).over(_dealt(edges, keys, ["y0", "y1"]))


def flatten_curves(curves: DataFrame, keys: list[str], pieces: int = 16) -> DataFrame:
    """``keys, x0, y0, x1, y1``: the edges of cubic curves ``x0, y0`` to ``x3, y3``, each cut at equal steps of its parameter."""
    steps = curves.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def at(axis: str, k: Column) -> Column:
        t = k / pieces
        u = 1 - t
        p = [F.col(f"{axis}{i}") for i in range(4)]
        return p[0] * u * u * u + p[1] * (3 * u * u * t) + p[2] * (3 * u * t * t) + p[3] * t * t * t

    point = lambda k: [at("x", k), at("y", k)]
    (x0, y0), (x1, y1) = point(F.col("_i")), point(F.col("_i") + 1)
    return steps.select(*keys, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def winding_spans(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y, x0, x1``: maximal interior spans at the middle of each scan line from directed edges ``x0, y0, x1, y1``, by the non-zero rule.

    Edges that go down count 1, those that go up -1; a place is inside where the running sum along its line isn't 0. An edge counts on the
    lines whose middle lies in its half-open range of y. Edges without a height and open outlines' missing ones count nowhere.
    """
    return _Sweep(keys, False, False).over(_dealt(edges, keys, ["y0", "y1"]))


def curve_totals(curves: DataFrame, keys: list[str], pieces: int = 16) -> DataFrame:
    """``keys, n_spans, n_lines, covered`` of the non-zero filling of cubic curves, flattened after the shuffle; a curve stays between its four points."""
    dealt = _dealt(curves, keys, [f"y{i}" for i in range(4)])
    return _Sweep(keys, False, True).over(flatten_curves(dealt, [*keys, "_band"], pieces))
