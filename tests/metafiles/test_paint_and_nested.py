"""Carried files, fills, gradients, running sums and EMF+ bodies, on small cases worked out by hand or by plain loops."""

import random
import struct

from pyspark.sql import functions as F

from strokelake.functions import pixels, plus, points
from strokelake.operators import nested, regions


def fragment(data, count, remaining, total, checksum=0, flags=0, current=None):
    current = len(data) if current is None else current
    head = struct.pack("<IIIHIIIII", nested.WMFC, 1, 0x10000, checksum, flags, count, current, remaining, total)
    body = struct.pack("<HH", 15, 34 + current) + head + data
    body += bytes(len(body) % 2)
    return bytearray(struct.pack("<IH", 3 + len(body) // 2, 0x0626) + body)


def test_carried_files(spark):
    data = bytes(range(40))
    total = 0
    for w in struct.unpack("<20H", data):
        total ^= w
    total ^= 0xFFFF
    parts = [(data[:16], 24), (data[16:32], 8), (data[32:], 0)]
    good = [fragment(d, 3, left, 40, total if not k else 0) for k, (d, left) in enumerate(parts)]
    other = lambda k, **change: [fragment(d, **({"count": 3, "remaining": left, "total": 40, "checksum": total if not i else 0} | (change if i == k else {}))) for i, (d, left) in enumerate(parts)]
    cases = {
        "good": (good, None), "flags": (other(1, flags=1), "flags"), "lengths": (other(1, current=17), "fragment lengths"), "count": (other(1, count=4), "inconsistent fragments"),
        "total": (other(2, total=41), "inconsistent fragments"), "sum": (other(0, checksum=total ^ 1), "checksum"), "later": (other(1, checksum=7), "checksum of a fragment"), "left": (other(1, remaining=9), "remaining bytes"),
        "short": (good[:2], "incomplete file"), "twice": (good + good[:1], "second file"), "few": ([fragment(data, 2, 0, 40, total)], "fragment count"),
    }
    rows = [(k, i, 0x0626, r) for k, (records, _) in cases.items() for i, r in enumerate(records)] + [("none", 0, 0x0201, bytearray(struct.pack("<IHI", 5, 0x0201, 1))), (None, 0, 0x0626, fragment(data, 1, 0, 40, total))]
    got = {r.file: r for r in nested.carried_files(spark.createDataFrame(rows, "file string, seq int, type int, raw binary").repartition(3), ["file"], "seq").collect()}
    assert {k: r.fault for k, r in got.items()} == {k: f for k, (_, f) in cases.items()} | {None: None}
    assert bytes(got["good"].content) == bytes(got[None].content) == data and got["short"].content is None


def test_running_sums(spark):
    rng = random.Random(1)
    lists = [[], [5.0], *[[float(rng.randint(-9, 9)) for _ in range(n)] for n in (2, 3, 10, 101)]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>").withColumn("s", points.running_sums(F.col("v"))).collect()
    for r in rows:
        assert r.s == [sum(r.v[: k + 1]) for k in range(len(r.v))]


def test_winding_fills(spark):
    def box(k, x0, y0, x1, y1, turn):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)][::turn]
        return [(k, float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1])]

    rows = box("same", 0, 0, 6, 4, 1) + box("same", 2, 1, 4, 3, 1) + box("hole", 0, 0, 6, 4, 1) + box("hole", 2, 1, 4, 3, -1)
    spans = regions.winding_spans(spark.createDataFrame(rows, "k string, x0 double, y0 double, x1 double, y1 double"), ["k"]).collect()
    got = {k: sorted((r.y, r.x0, r.x1) for r in spans if r.k == k) for k in ("same", "hole")}
    assert got["same"] == [(y, 0.0, 6.0) for y in range(4)]
    assert got["hole"] == [(0, 0.0, 6.0), (1, 0.0, 2.0), (1, 4.0, 6.0), (2, 0.0, 2.0), (2, 4.0, 6.0), (3, 0.0, 6.0)]
    line = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0, 2.0, 4.0, 3.0, 6.0)], "x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    edges = sorted(tuple(r) for r in regions.flatten_curves(line, [], 3).collect())
    assert [tuple(round(v, 9) for v in e) for e in edges] == [(0, 0, 1, 2), (1, 2, 2, 4), (2, 4, 3, 6)]


def test_gradients(spark):
    brush = {n: F.lit(float(v)) for n, v in {"a": 2, "b": 0, "c": 0, "d": 3, "e": 10, "f": 5, "x": 1, "width": 4}.items()}
    stops = F.expr("array(named_struct('at', 0D, 'r', 0L, 'g', 0L, 'b', 255L), named_struct('at', 0.5D, 'r', 100L, 'g', 9L, 'b', 9L), named_struct('at', 0.5D, 'r', 10L, 'g', 9L, 'b', 9L), named_struct('at', 1D, 'r', 20L, 'g', 200L, 'b', 0L))")
    # Brush space is 2 x + 10, so its rectangle of 1 to 5 is 12 to 20 here.
    rows = spark.createDataFrame([(12.0, 0), (14.0, 0), (16.0, 0), (20.0, 0), (22.0, 0), (22.0, 1), (30.0, 4), (2.0, 4)], "px double, mode int")
    rows = rows.withColumn("t", pixels.wrapped(pixels.gradient_parameter(F.col("px"), F.lit(7.0), brush), F.col("mode")))
    got = [(r.t, r.r, r.g) for r in rows.select("t", *[c.alias(n) for n, c in pixels.gradient_color(F.col("t"), stops).items()]).collect()]
    assert got == [(0.0, 0, 0), (0.25, 50, 5), (0.5, 10, 9), (0.0, 0, 0), (0.25, 50, 5), (0.75, 15, 105), (1.0, 20, 200), (0.0, 0, 0)]
    flat = brush | {"d": F.lit(0.0)}
    assert rows.select(pixels.gradient_parameter(F.col("px"), F.lit(7.0), flat).alias("t")).first().t is None


def test_plus_bodies(spark):
    def record(kind, flags, data):
        return kind, flags, bytearray(struct.pack("<HHII", kind, flags, 12 + len(data), len(data)) + data)

    rows = [
        record(0x400A, 0x8000 | 0x4000, struct.pack("<IIhhhh", 0xFF00FF00, 1, 1, -2, 3, 4)), record(0x400D, 0x2000 | 5, struct.pack("<Iffff", 2, 0.5, 1, 2, -3)),
        record(0x400D, 64, struct.pack("<Iffff", 2, 1, 1, 2, 3)), record(0x400C, 0, struct.pack("<II", 64, 3) + bytes(24)), record(0x400B, 1, struct.pack("<I", 0)), record(0x400B, 1, struct.pack("<I", 9) + bytes(16)),
        record(0x400F, 3, struct.pack("<ffff", float("nan"), 1, 1, 1)), record(0x402C, 0x2000, bytes(24)), record(0x4033, 0x0302, b""), record(0x4005, 0, b""), record(0x4027, 0x0200, bytes(36)),
    ]
    got = plus.decode_bodies(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type int, flags int, raw binary")).orderBy("i").collect()
    assert [r.fault for r in got] == [None, None, "object number", "brush number", "count", "body", "body", None, None, "reserved type", None]
    assert got[0].solid and [tuple(b) for b in got[0].boxes] == [(1, -2, 3, 4)] and got[0].object is None
    assert (got[1].object, got[1].closed, [tuple(p) for p in got[1].points]) == (5, True, [(0.5, 1.0), (2.0, -3.0)])
    assert got[7].append and (got[8].object, got[8].mode) == (2, 3) and got[10].unit == 2
