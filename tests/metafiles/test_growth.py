"""What is shuffled grows with the rows given, not with the lines and pixels made of them; results stay those of plain Python."""

import itertools
import random
import struct
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strokelake.functions import binary, dib, layouts, pixels, points
from strokelake.operators import assembly, batches, clips, objects, packbits, paint, play, regions, text
from strokelake.sources import metafiles


def exchanges(frame):
    """Shuffles of a plan."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_frames_over_tiles_from_one_shuffle(spark):
    rng = random.Random(3)
    rects = [(g, x, y, x + rng.randint(0, 40), y + rng.randint(0, 30)) for g in ("a", None) for _ in range(60) for x, y in [(rng.randint(4060, 4120), rng.randint(-90, 20))]]
    table = spark.createDataFrame(rects, "g string, left int, top int, right int, bottom int")
    made = regions.frame(table, ["g"], 2, 3)
    assert exchanges(made) == 1
    spans = made.collect()
    for g in ("a", None):
        whole = {(x, y) for k, l, t, r, b in rects if k == g for x in range(l, r) for y in range(t, b)}
        core = {(x, y) for x, y in whole if all((x + i, y + j) in whole for i, j in itertools.product(range(-2, 3), range(-3, 4)))}
        got = [(x, r.y) for r in spans if r.g == g for x in range(r.x0, r.x1)]
        assert core and len(got) == len(set(got)) and set(got) == whole - core


def test_a_tile_of_many_rectangles_is_held_as_spans():
    rng = random.Random(4)
    kind = pa.schema([("_ty", pa.int64()), ("_tx", pa.int64()), *[(c, pa.int32()) for c in ("_l", "_t", "_r", "_b")]])
    rows = [{"_ty": ty, "_tx": 0, "_l": x, "_t": y, "_r": x + rng.randint(1, 9), "_b": y + rng.randint(1, 5)} for ty in (0, 1) for _ in range(400) for x, y in [(rng.randint(0, 20), rng.randint(0, 9))]]
    tiles = regions._Tiles([], 1, 1)
    boxes = lambda tables: sorted(tuple(r.values()) for t in tables for r in tiles.frames(t).to_pylist())
    parts = (pa.RecordBatch.from_pylist(rows[i : i + 50], kind) for i in range(0, len(rows), 50))
    cut = list(batches.whole_groups(parts, tiles.keys, tiles.shorter, 100))
    assert max(t.num_rows for t in cut) < 200 and boxes(cut) == boxes([pa.Table.from_pylist(rows, kind)]) != []


def test_trees_of_any_depth_from_one_shuffle(spark):
    n = clips.NESTING
    chain = lambda k, deep: [(k, i, clips.XOR, None, None, None, None) for i in range(deep)] + [(k, deep + i, clips.RECT, i, 0, i + 2, 3) for i in range(deep + 1)]
    rows = chain("fits", n) + chain("deep", n + 1) + chain(None, 2)
    table = spark.createDataFrame(rows, "k string, node int, type int, left int, top int, right int, bottom int")
    spans, faults = clips.evaluate_trees(table, ["k"], (0, 0, 300, 2))
    assert exchanges(spans) == 1
    assert sorted((str(r.k), r.y0, r.y1, r.x0, r.x1) for r in spans.collect()) == [("None", 0, 2, 0, 1), ("None", 0, 2, 3, 4), ("fits", 0, 2, 0, 1), ("fits", 0, 2, n + 1, n + 2)]
    assert [tuple(r) for r in faults.collect()] == [("deep", "nesting")]


def test_shapes_over_bands_from_one_shuffle(spark):
    rng = random.Random(5)
    rows = [(k, *(float(v) for v in (a, b, c, d))) for k in (1, None) for pts in [[(rng.randint(0, 40), rng.randint(-700, 700)) for _ in range(7)]] for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1])]
    edges = spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double")
    for spans, totals, odd in ((regions.even_odd_spans(edges, ["k"]), regions.even_odd_totals(edges, ["k"]), True), (regions.winding_spans(edges, ["k"]), None, False)):
        assert exchanges(spans) == 1
        want = {}
        for k in (1, None):
            for y in range(-700, 700):
                hits = sorted((x0 + (y + 0.5 - y0) * (x1 - x0) / (y1 - y0), 1 if y1 > y0 else -1) for e, x0, y0, x1, y1 in rows if e == k and min(y0, y1) <= y + 0.5 < max(y0, y1))
                n, inside = 0, []
                for (x, d), (nx, _) in zip(hits, hits[1:]):
                    n += 1 if odd else d
                    if (n % 2 if odd else n) and nx > x:
                        inside.append((x, nx))
                if inside:
                    want[k, y] = sum(b - a for a, b in inside)
        got = {}
        for r in spans.collect():
            got[r.k, r.y] = got.get((r.k, r.y), 0) + r.x1 - r.x0
        assert {i: round(v, 6) for i, v in got.items() if v} == {i: round(v, 6) for i, v in want.items()} != {}
        if totals is not None:
            assert {r.k: round(r.covered, 4) for r in totals.collect()} == {k: round(sum(v for (i, _), v in want.items() if i == k), 4) for k in (1, None)}


def test_curves_are_shuffled_before_they_are_cut(spark):
    curves = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 3000.0, 40.0, -3000.0, 40.0, 5.0), (1, 40.0, 5.0, 30.0, 9.0, 9.0, 7.0, 0.0, 0.0)], "k int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    got = regions.curve_totals(curves, ["k"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan[plan.rindex("Exchange ") :].count("Generate explode") == 1
    spans = regions.winding_spans(regions.flatten_curves(curves, ["k"]), ["k"]).collect()
    assert tuple(got.first())[1:3] == (len(spans), len({r.y for r in spans})) and abs(got.first().covered - sum(r.x1 - r.x0 for r in spans)) < 1e-6 and len(spans) > regions.BAND


def test_bidi_and_double_bytes_in_bulk():
    """As the rules say, character by character, and a long text in a fraction of the time of a loop over its characters."""
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("aאב1٣ ,-") for _ in range(rng.randint(0, 12)))
        kinds = [{"a": "L", "א": "R", "ב": "R", "1": "N", "٣": "N"}.get(c) for c in t]
        base = next((int(k == "R") for k in kinds if k in ("L", "R")), 0)
        last, own = "R" if base else "L", "R" if base else "L"
        for i, k in enumerate(kinds):
            if k == "N" and last == "L":
                kinds[i] = "L"
            elif k in ("L", "R"):
                last = k
        sides = [k and ("L" if k == "L" else "R") for k in kinds]
        for i, k in enumerate(list(sides)):
            if k is None:
                near = {next((s for s in reversed(sides[:i]) if s), own), next((s for s in sides[i:] if s), own)}
                kinds[i] = near.pop() if len(near) == 1 else own
        levels = [{"L": 2 * base, "R": 1, "N": 2}[k] for k in kinds]
        order = list(range(len(levels)))
        for level in (2, 1):
            runs = [list(g) for _, g in itertools.groupby(order, lambda i: levels[i] >= level)]
            order = [i for g in runs for i in (g[::-1] if levels[g[0]] >= level else g)]
        assert text._levels(t).tolist() == levels and text._order(text._levels(t)).tolist() == order
    for page in text.DOUBLE_BYTE:
        table = text.double_byte_table(page)
        for _ in range(100):
            data, want, i = bytes(rng.choice([0, 0x41, 0x7E, 0x81, 0xA3, 0xC4, 0xFE, 0xFF]) for _ in range(rng.randint(0, 12))), "", 0
            while i < len(data):
                n = 2 if text.is_lead(page, data[i]) and i + 1 < len(data) and data[i + 1] else 1
                c = table[int.from_bytes(data[i : i + n], "big")]
                want, i = want + (chr(text.DOUBLE[page][0]) if c == text.NONE else c), i + n
            assert text._read_double(data, page) == want
    long, began = "ab אב 12 " * 100_000, time.process_time()
    text._order(text._levels(long)), text._read_double(b"\xa3\xb1a" * 300_000, 936)
    assert time.process_time() - began < 1.5


def test_bidi_of_a_batch_in_bounded_pieces(spark, monkeypatch):
    """of a batch no more is held as levels and places than a bounded piece or one text; levels don't go to Python again."""
    rng = random.Random(9)
    values = [None, "", "אב", *["".join(rng.choice("ab אבג12 -") for _ in range(rng.choice([1, 7, 60, 300]))) for _ in range(200)], "a" * 5000, "", None]
    array = pa.array(["before", *values]).slice(1)
    want = [None if t is None else text._levels(t).tolist() for t in values]
    turned = [None if x is None else text._order(np.array(x, "int32")).tolist() for x in want]
    monkeypatch.setattr(text, "PIECE", 1000)
    made = list(text._both_lists(iter([array, array.slice(0, 0)])))
    levels, display = ([x for part in made for x in part.field(k).to_pylist()] for k in ("levels", "display"))
    assert levels == want and display == turned
    assert all(len(part) == 1 or len(part.field("levels").values) <= 1000 for part in made) and len(made) > 10
    monkeypatch.undo()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(values)], "k int, t string").select("k", text.bidi("t").alias("b")).select("k", "b.levels", "b.display")
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1
    assert {r.k: (r.levels, r.display) for r in rows.collect()} == dict(enumerate(zip(want, turned)))


def test_gradients_from_one_shuffle_of_the_brushes(spark):
    stops = "array(named_struct('at', 0D, 'r', 0L, 'g', 9L, 'b', 255L), named_struct('at', 0.5D, 'r', 100L, 'g', 9L, 'b', 9L), named_struct('at', 0.5D, 'r', 10L, 'g', 7L, 'b', 0L), named_struct('at', 1D, 'r', 20L, 'g', 200L, 'b', 0L))"
    rows = [(k, float(1 + (k or 0) % 3), 1.0, -1.0, float(k != 4), 2.0, 3.0, 1.0, float(k != 3), (k or 0) % 5) for k in (0, 1, 2, 3, None, 5, 6, 8, 9)] + [(4, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 5.0, 0)]
    brushes = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, e double, f double, x double, width double, mode int").withColumn("stops", F.expr(stops))
    made = paint.linear_gradients(brushes, ["k"], 5, 3)
    assert exchanges(made) == 1
    p = brushes.filter("k is null or k not in (3, 4)").select("*", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"))
    t = pixels.wrapped(pixels.gradient_parameter(F.col("i") % 5 + 0.5, F.floor(F.col("i") / 5) + 0.5, {n: F.col(n) for n in "abcdefx"} | {"width": F.col("width")}), F.col("mode"))
    want = p.withColumn("t", t).select("k", (F.col("i") % 5).alias("px"), F.floor(F.col("i") / 5).cast("int").alias("py"), *[c.alias(n) for n, c in pixels.gradient_color(F.col("t"), F.col("stops")).items()])
    assert sorted(map(str, made.filter("r is not null").collect())) == sorted(map(str, want.collect()))
    assert [(r.k, r["count"]) for r in made.filter("r is null").groupBy("k").count().orderBy("k").collect()] == [(3, 15), (4, 15)]
    cut = paint._Gradients(["k"], 100, 3000)
    batch = brushes.filter("k = 5").toArrow().to_batches()[0]
    assert max(b.num_rows for b in cut.run(iter([batch]))) <= paint.PIXELS


def test_lines_of_bitmaps_by_whole_arrays(spark):
    rng = random.Random(6)
    w, h = 37, 9
    for bits in (1, 4, 8, 16, 24, 32):
        stride = (w * bits + 31) // 32 * 4
        data = rng.randbytes(stride * h)
        head = {"width": w, "height": h, "stride": stride, "top_down": bits == 8, "bits": bits, "masks": [0x7C00, 0x3E0, 0x1F, 0] if bits == 16 else [0x3FF00000, 0xFFC00, 0x3FF, 0xC0000000], "colors": 1 << bits if bits < 9 else 0, "entry": 4, "palette_at": 2, "pixels_at": 2 + (4 << bits if bits < 9 else 0)}
        colors = rng.randbytes(4 << bits) if bits < 9 else b""
        made = list(dib._Lines(1, 0, []).image(dib.np.frombuffer(b"xx" + colors + data, "uint8"), head, None))
        for y, x in itertools.product(range(h), range(w)):
            line = data[(y if bits == 8 else h - 1 - y) * stride :]
            v = int.from_bytes(line[:stride], "little") >> (x * bits) & (1 << bits) - 1
            if bits < 8:
                v = line[x * bits // 8] >> 8 - bits - x * bits % 8 & (1 << bits) - 1
            scaled = lambda at, most: ((v >> at & most) * 255 + most // 2) // most
            want = {16: lambda: (255, scaled(10, 31), scaled(5, 31), scaled(0, 31)), 24: lambda: (255, v >> 16, v >> 8 & 255, v & 255), 32: lambda: (scaled(30, 3), scaled(20, 1023), scaled(10, 1023), scaled(0, 1023))}.get(bits, lambda: (255, *colors[4 * v : 4 * v + 3][::-1]))()
            assert int(made[0][1][y, x]) == int.from_bytes(bytes(want), "big"), (bits, x, y)
    # An image of more pixels than are held at once comes in several batches.
    content = (40).to_bytes(4, "little") + (16000).to_bytes(4, "little") + (50).to_bytes(4, "little") + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes(24) + bytes(1024) + bytes(16000 * 50)
    head = dib.heads(spark.createDataFrame([(1, bytearray(content))], "k int, content binary")).select("k", "content", "dib", F.lit(None).cast("array<bigint>").alias("l")).toArrow().to_batches()
    parts = list(dib._Lines(1, 0, ["k", "y", "colors", "fault"]).run(iter(head)))
    assert len(parts) == 2 and sum(p.num_rows for p in parts) == 50 and [y for p in parts for y in p.column(1).to_pylist()] == list(range(50))


def test_records_are_decoded_and_split_without_interpreted_loops(spark):
    rng = random.Random(9)
    rows = [(form, code, rng.randbytes(rng.choice([4, 20, 200]))) for form, code, _, _ in layouts.layout_rows() for _ in range(2)] + [("WMF", -1, b""), ("EMF", None, bytes(30)), (None, 3, bytes(30)), ("WMF", 0x0940, bytes(24)), ("WMF", 0x0940, None)]
    frame = spark.createDataFrame([(*r[:2], r[2] and bytearray(r[2])) for r in rows], "format string, type int, raw binary")
    made = layouts.decode(frame)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "transform(" not in plan
    listed = {(form, code % 256 if form == "WMF" else code): (name, fields) for form, code, name, fields in layouts.layout_rows()}
    bare = {code: fields for _, code, _, fields in layouts._placed("WMF", layouts.WMF_BARE)}
    codes = {"u8": "<B", "i16": "<h", "u16": "<H", "i32": "<i", "u32": "<I", "f32": "<f"}
    for r in made.collect():
        name, fields = listed.get((r.format, r.type % 256 if r.format == "WMF" else r.type), (None, None)) if r.type is not None and r.type >= 0 else (None, None)
        full = next((c for f, c, n, _ in layouts.layout_rows() if f == "WMF" and n == name and c in bare), None)
        if full is not None and r.format == "WMF" and r.raw is not None and len(r.raw) == 2 * ((r.type >> 8) + 3):
            fields = bare[full]
        want = None if fields is None else {}
        for label, kind, at in fields or []:
            v = struct.unpack_from(codes[kind], r.raw, at)[0] if r.raw is not None and at + layouts._SIZES[kind] <= len(r.raw) else None
            want[label] = None if v is None or v != v or abs(v) == float("inf") else float(v)
        assert (r.name, r.fields) == (name, want), (r.format, r.type)
    one = points.polygons(spark.createDataFrame([("WMF", 0x538, bytearray(bytes(6) + b"\x02\0\x01\0\x02\0" + b"\x01\0\xff\xff" * 3)), ("WMF", 0x325, None), ("EMF", 7, bytearray(28))], "format string, type int, raw binary"))
    assert "transform(" not in one._jdf.queryExecution().executedPlan().toString()
    assert [r.polygons and [[tuple(p) for p in q] for q in r.polygons] for r in one.collect()] == [[[(1, -1)], [(1, -1)] * 2], None, None]


def test_files_are_played_many_in_a_task(spark):
    rows = [(f, i, name, {"x": float(i), "y": 1.0}) for f in ("a", None, "b") for i, name in enumerate(["SaveDC", "MoveTo", "SetWindowOrg", None, "LineTo"])]
    made = play.contexts(spark.createDataFrame(rows, "file string, seq int, name string, fields map<string,double>").repartition(3))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("Exchange ") == 1
    assert sorted((str(r.file), r.seq, r.depth, r.x, r.worg_x) for r in made.collect()) == [(f, i, 1, 1.0 * (i > 1), 2.0 * (i > 2)) for f in ("None", "a", "b") for i in range(5)]


def test_shares_of_known_places_need_no_window(spark):
    rows = spark.createDataFrame([(d, k, 10, n) for d, n in ((1, 3), (2, 4)) for k in range(n)], "d int, k int, extra int, breaks int")
    known = text.justify(rows, ["d"], ["k"], F.col("extra"), F.col("breaks"), F.col("k") + 1)
    assert "Window" not in known._jdf.queryExecution().executedPlan().toString()
    assert sorted(known.collect()) == sorted(text.justify(rows, ["d"], ["k"], F.col("extra"), F.col("breaks")).collect())
    assert [r.share for r in known.orderBy("d", "k").collect()] == [4, 3, 3, 3, 3, 2, 2]


def test_points_are_read_in_one_pass(spark):
    nan = struct.pack("<f", float("nan"))
    rows = [(bytes([5, 0x80, 200, 0x7F, 3]), 0, 2, 0x800), (b"\x05\x80", 0, 1, 0x800), (b"\x01\0\xff\xff", 0, 1, 0x4000), (nan + bytes(4), 0, 1, None), (b"", 0, 0, 0), (b"", 0, 1 << 40, 0), (None, 0, 1, 0), (b"x" * 9, None, 1, 0)]
    frame = spark.createDataFrame([(k, r[0] if r[0] is None else bytearray(r[0]), *r[1:]) for k, r in enumerate(rows)], "k int, raw binary, at long, n long, flags int")
    made = frame.select("k", points.plus_points(F.col("raw"), F.col("at"), F.col("n"), F.col("flags")).alias("p"))
    assert "regexp" not in made._jdf.queryExecution().executedPlan().toString()
    assert [r.p and [tuple(x) for x in r.p] for r in made.orderBy("k").collect()] == [[(5.0, 200.0), (4.0, 203.0)], None, [(1.0, -1.0)], [(None, 0.0)], [], None, None, None]


def test_objects_from_one_shuffle(spark):
    """short files are put together inside tasks, long ones by scans, and both give the same."""
    part = lambda f, at, n, data, total=None: (f, at, n, 5, total is not None, total, data)
    rows = [part("a", 0, 1, b"abcd", 9), part("a", 1, 1, b"efgh", 9), part("a", 2, 1, b"i\0\0\0", 9), part("a", 3, 2, b"x"), part("a", 4, 3, b"q", 2)]
    rows += [part(None, 0, 1, b"ab", 4), part(None, 1, 1, b"cd"), part(None, 2, 64, b"z"), part(None, 3, 1, b"y"), part("b", 7, 2, b"", 5)]
    table = spark.createDataFrame(rows, "file string, at long, id int, type int, continued boolean, total long, data binary").repartition(3)
    for short in (9, 4, 0):
        whole, faults = objects.assemble(table, ["file"], "at", short=short)
        if short == 9:
            assert exchanges(whole) == exchanges(faults) == 2  # one is the test's own
        assert sorted((str(r.file), r["first"], r["last"], r.id, r.n_fragments, bytes(r.data)) for r in whole.collect()) == [("None", 0, 1, 1, 2, b"abcd"), ("a", 0, 2, 1, 3, b"abcdefghi"), ("a", 3, 3, 2, 1, b"x")]
        assert sorted((str(r.file), r.position, r.fault) for r in faults.collect()) == [("None", 2, "identity"), ("a", 4, "unfinished object"), ("b", 7, "unfinished object")]


def test_objects_go_on_over_batches():
    kind = pa.schema([("file", pa.int32()), ("position", pa.int64()), ("id", pa.int32()), ("type", pa.int32()), ("continued", pa.bool_()), ("total", pa.int64()), ("data", pa.binary())])
    rows = [(f, k, 1, 5, k < 6, 20 if k < 6 else 0, b"abc") for f in (1, 2, 3) for k in range(7 if f < 3 else 4)]
    made = pa.schema([kind.field(0), *[pa.field(n, pa.int64()) for n in ("first", "last")], *[pa.field(n, pa.int32()) for n in ("id", "type", "n_fragments")], pa.field("data", pa.binary())])
    wrong = pa.schema([kind.field(0), pa.field("position", pa.int64()), pa.field("fault", pa.string())])
    for size in (1, 2, 5, 30):
        cut = lambda sizes: (pa.RecordBatch.from_pylist([dict(zip(kind.names, [*r[:6], len(r[6]) if sizes else r[6]])) for r in rows[i : i + size]], kind.set(6, pa.field("data", pa.int64())) if sizes else kind) for i in range(0, len(rows), size))
        got = pa.Table.from_batches(assembly.Assembly(1, 99, 3, False, made).run(cut(False)), made).to_pylist()
        assert [tuple(r.values()) for r in got] == [(f, 0, 6, 1, 5, 7, (b"abc" * 7)[:20]) for f in (1, 2)]
        assert [tuple(r.values()) for r in pa.Table.from_batches(assembly.Assembly(1, 99, 3, True, wrong).run(cut(True)), wrong).to_pylist()] == [(3, 0, "unfinished object")]


def test_small_files_share_a_batch():
    """a batch a file costs more than the walk of a small file."""
    wmf = lambda n: struct.pack("<HHHIHIH", 2, 9, 0x300, 12 + n, 0, max(3, n), 0) + struct.pack("<IH", n, 0x0201) + bytes(2 * n - 6) + struct.pack("<IH", 3, 0)
    made = [(str(k), wmf(5) if k % 3 else b"", [0x0201, 0] if k % 3 else [None]) for k in range(700)] + [("long", wmf(2 << 20), [0x0201, 0]), (None, wmf(2 << 20), [0x0201, 0])]
    files = pa.RecordBatch.from_pydict({"file": [m[0] for m in made], "content": pa.array([m[1] for m in made], pa.binary())})
    out = list(metafiles.walk_batches(iter([files.slice(0, 100), files.slice(100)])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) == 2 and max(sum(len(r["raw"] or b"") for r in b.to_pylist()) for b in out) < 5 << 20
    assert [(r["file"], r["seq"], r["type"]) for r in rows] == [(name, k, t) for name, _, types in made for k, t in enumerate(types)]


def test_words_are_read_from_whole_arrays(spark):
    rng = random.Random(7)
    values = [b"", b"\1", b"\1\2\3", None, *[rng.randbytes(n) for n in (2, 7, 64, 65, 100_001)], b"\xff" * 10]
    table = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in enumerate(values)], "k int, v binary").select("k", binary.xor_words(F.col("v")).alias("x"))
    assert "ArrowEvalPython" in table._jdf.queryExecution().executedPlan().toString()

    def plain(v):
        total = 0
        for i in range(0, len(v), 2):
            total ^= int.from_bytes(v[i : i + 2], "little")
        return total

    assert {r.k: r.x for r in table.collect()} == {k: None if v is None else plain(v) for k, v in enumerate(values)}


def plain_packbits(data):
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and (i + 1 >= n or data[i + 1] != data[i]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def test_packbits_of_a_batch_in_bounded_steps(monkeypatch):
    """packets are those of a plain loop, whatever is encoded at once, and what is encoded at once is bounded."""
    rng = random.Random(8)
    values = [b"", b"a", b"aa", None, bytes(128), bytes(129), b"x" + bytes(129) + b"y", bytes(257) + b"ab", bytes(range(256)) * 3, b"ab" * 64 + b"bb", b""]
    values += [bytes(rng.choice(b"abc") if rng.random() < 0.5 else 97 for _ in range(rng.choice([1, 5, 130, 900]))) for _ in range(60)]
    values += [b"".join(bytes([rng.randrange(256)]) * rng.choice([1, 1, 1, 2, 127, 128, 129, 256, 300]) for _ in range(40)) for _ in range(20)]
    array, seen, once = pa.array([b"before", *values], pa.binary()).slice(1), [], packbits._packed
    monkeypatch.setattr(packbits, "_packed", lambda x, begins: seen.append(len(x)) or once(x, begins))
    for window in (129, 200, 1000, 1 << 17):
        monkeypatch.setattr(packbits, "WINDOW", window)
        seen.clear()
        packed = packbits.pack(array)
        assert packed.to_pylist() == [None if v is None else plain_packbits(v) for v in values] and 0 < max(seen) <= window
        assert packbits.unpack(packed).to_pylist() == values
    bad = [b"\5ab", b"\0a\xff", b"\0a", b"\x80", None]
    assert packbits.unpack(pa.array(bad, pa.binary())).to_pylist() == [None, None, b"a", b"", None]
    assert packbits.pack(array.slice(0, 0)).to_pylist() == packbits.unpack(array.slice(0, 0)).to_pylist() == []
