"""Objects, region trees, clips, bitmaps, double-byte text and layouts, each against plain Python."""

import codecs
import random
import struct

import pytest
from pyspark.sql import functions as F

from strokelake.functions import dib, layouts
from strokelake.operators import clips, objects, text
from strokelake.sources import metafiles


def plain_assembly(rows, most):
    """rows of one file (at, id, type, continued, total, data) in order: objects and the first fault."""
    out, held = [], None
    for at, number, kind, continued, total, data in rows:
        if number > 63 or not 1 <= kind <= 9:
            return out, (at, "identity")
        if held is None:
            if not continued:
                if not data:
                    return out, (at, "empty object")
                if len(data) > most:
                    return out, (at, "object bytes")
                out.append((at, at, number, kind, 1, data))
                continue
            if total == 0:
                return out, (at, "total size")
            if total > most:
                return out, (at, "object bytes")
            held = [at, number, kind, total, b"", 0]
        if (number, kind) != tuple(held[1:3]) or (continued and total != held[3]):
            return out, (at, "inconsistent continuation")
        held[4] += data
        held[5] += 1
        done = len(held[4]) >= held[3]
        if (not done and not continued) or (done and len(held[4]) - held[3] > 3):
            return out, (at, "continuation length")
        if done:
            out.append((held[0], at, number, kind, held[5], held[4][: held[3]]))
            held = None
    return out, held and (held[0], "unfinished object")


def test_objects_are_put_together(spark):
    rng, rows, want, faults = random.Random(5), [], {}, {}
    for file in [*range(14), None]:
        at, mine = 0, []
        wild = file is not None and file % 3 == 0
        for _ in range(12):
            number, kind = rng.choice([1, 1, 2, 63]), rng.choice([3, 5])
            data = bytes(rng.randrange(256) for _ in range(rng.choice([3, 8, 20, 41])))
            step = rng.choice([4, 7, 50])
            parts = [data[i : i + step] for i in range(0, len(data), step)]
            always = rng.random() < 0.5
            if rng.random() < 0.4:
                parts[-1] += bytes(rng.randrange(4))
            for k, p in enumerate(parts):
                continued = len(parts) > 1 and (k < len(parts) - 1 or always)
                mine.append((at, number, kind, continued, len(data) if continued else None, p))
                at += rng.randint(1, 3)
            if wild and rng.random() < 0.2:
                mine.append(rng.choice([(at, 64, 3, False, None, b"x"), (at, 1, 0, False, None, b"x"), (at, 1, 3, False, None, b""), (at, 1, 3, True, 0, b"x"), (at, 1, 3, True, 90, b"x"), (at, 9, 9, True, 4, b"x" * 9), (at, 2, 9, True, 50, b"xx")]))
                at += 1
        want[file], faults[file] = plain_assembly(mine, 60)
        rows += [(file, *r) for r in mine]
    frags = spark.createDataFrame(rows, "file int, at long, id int, type int, continued boolean, total long, data binary").repartition(3)
    whole, wrong = objects.assemble(frags, ["file"], "at", most=60)
    got = {f: [] for f in want}
    for r in whole.collect():
        got[r.file].append((r["first"], r["last"], r.id, r.type, r.n_fragments, bytes(r.data)))
    assert {f: sorted(x) for f, x in got.items()} == want
    assert {r.file: (r.position, r.fault) for r in wrong.collect()} == {f: x for f, x in faults.items() if x} and any(faults.values())
    assert objects.assemble(frags.limit(0), ["file"], "at")[0].count() == 0


def test_fragments_are_read_from_records(spark):
    made = [(0x8000 | 5 << 8 | 7, struct.pack("<I", 30) + b"abcde"), (5 << 8 | 7, b"xyz")]
    raw = [bytearray(struct.pack("<HHII", 0x4008, f, 12 + len(d) + -len(d) % 4, len(d)) + d + bytes(-len(d) % 4)) for f, d in made]
    rows = objects.fragments(spark.createDataFrame([(i, f, r) for i, ((f, _), r) in enumerate(zip(made, raw))], "i int, flags int, raw binary")).orderBy("i").collect()
    assert [(r.id, r.type, r.continued, r.total, bytes(r.data)) for r in rows] == [(7, 5, True, 30, b"abcde"), (7, 5, False, None, b"xyz")]


def test_region_trees_equal_cells(spark):
    rng, rows, want = random.Random(6), [], {}
    area = (0, 0, 9, 7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.25:
            kind = rng.choice([clips.RECT] * 4 + [clips.EMPTY, clips.INFINITE])
            x, y = rng.randint(-2, 8), rng.randint(-2, 6)
            box = (x, y, x + rng.randint(0, 5), y + rng.randint(0, 5)) if kind == clips.RECT else (None,) * 4
            inside = {(i, j) for i in range(9) for j in range(7) if kind == clips.INFINITE or kind == clips.RECT and box[0] <= i < box[2] and box[1] <= j < box[3]}
            return [(kind, *box)], inside
        op = rng.randint(1, 5)
        (a, u), (b, v) = tree(depth - 1), tree(depth - 1)
        return [(op, None, None, None, None), *a, *b], {1: u & v, 2: u | v, 3: u ^ v, 4: u - v, 5: v - u}[op]

    for k in range(12):
        nodes, want[k] = tree(4)
        rows += [(k, 10 * i, *n) for i, n in enumerate(nodes)]
    rows += [(20, 0, 1, *(None,) * 4), (20, 1, clips.EMPTY, *(None,) * 4), (21, 0, clips.EMPTY, *(None,) * 4), (21, 1, clips.EMPTY, *(None,) * 4), (22, 0, 7, *(None,) * 4), (23, 0, clips.PATH, *(None,) * 4)]
    frame = spark.createDataFrame(rows, "k int, node int, type int, left int, top int, right int, bottom int").repartition(3)
    spans, faults = clips.evaluate_trees(frame, ["k"], area)
    got = {k: set() for k in want}
    for r in spans.collect():
        cells = {(x, y) for x in range(r.x0, r.x1) for y in range(r.y0, r.y1)}
        assert cells and not cells & got[r.k]
        got[r.k] |= cells
    assert got == want
    assert {r.k: r.fault for r in faults.collect()} == {20: "missing nodes", 21: "extra nodes", 22: "node type", 23: "node type"}


def test_clips_equal_cells(spark):
    rng, rows, want = random.Random(7), [], {}
    everywhere = {(x, y) for x in range(-60, 70) for y in range(-60, 70)}
    for k in range(10):
        clip, meta = None, everywhere
        for at in range(rng.randint(1, 14)):
            op = rng.choice(["replace", "intersect", "union", "xor", "difference", "complement", "offset", "offset", "reset", "meta", None])
            x, y, dx, dy = rng.randint(0, 8), rng.randint(0, 6), rng.randint(-2, 2), rng.randint(-2, 2)
            box = (x, y, x + rng.randint(0, 6), y + rng.randint(0, 6))
            a = {(i, j) for i in range(box[0], box[2]) for j in range(box[1], box[3])}
            c = everywhere if clip is None else clip
            if op == "offset":
                clip = clip and {(i + dx, j + dy) for i, j in clip} | ({p for p in everywhere if max(map(abs, p)) > 40} if (50, 50) in clip else set())
            elif op == "reset":
                clip = None
            elif op == "meta":
                meta, clip = meta & c, None
            elif op:
                clip = {"replace": a, "intersect": c & a, "union": c | a, "xor": c ^ a, "difference": c - a, "complement": a - c}[op]
            rows.append((k, at, op, *box, dx, dy))
        want[k] = {p for p in meta & (everywhere if clip is None else clip) if 0 <= p[0] < 9 and 0 <= p[1] < 7}
    frame = spark.createDataFrame(rows, "k int, at int, op string, left int, top int, right int, bottom int, dx int, dy int").repartition(3)
    spans, faults = clips.clip_spans(frame, ["k"], "at", (0, 0, 9, 7))
    got = {k: set() for k in want}
    for r in spans.collect():
        cells = {(x, y) for x in range(r.x0, r.x1) for y in range(r.y0, r.y1)}
        assert cells and not cells & got[r.k]
        got[r.k] |= cells
    assert got == want and faults.count() == 0
    spans, faults = clips.clip_spans(spark.createDataFrame([(1, i, "union", 0, 0, 1, 1, 0, 0) for i in range(5)], frame.schema), ["k"], "at", (0, 0, 9, 7), most=4)
    assert spans.count() == 0 and [tuple(r) for r in faults.collect()] == [(1, "clip steps")]


def test_bitmaps(spark):
    core = struct.pack("<IHHHH", 12, 3, 2, 1, 24) + bytes([1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 0, 0]) + bytes([11, 12, 13, 14, 15, 16, 17, 18, 19, 0, 0, 0])
    head = lambda w, h, bits, comp=0, used=0, planes=1: struct.pack("<IiiHHIIiiII", 40, w, h, planes, bits, comp, 0, 0, 0, used, 0)
    two = bytes([10, 20, 30, 0, 40, 50, 60, 0])
    images = {
        "core": core,
        "mono": head(10, -2, 1) + two + bytes([0b10100000, 0b01000000, 0, 0]) + bytes([0xFF, 0xC0, 0, 0]),
        "masks": head(1, 1, 16, 3) + struct.pack("<IIIHH", 0xF800, 0x7E0, 0x1F, 0xFFFF, 0),
        "index": head(1, 1, 4, used=1) + two[:4] + bytes([0x10, 0, 0, 0]),
        "short": head(4, 4, 8) + two,
        "palette": head(1, 1, 1) + b"abc",
        "version": struct.pack("<I", 64) + bytes(60),
        "planes": head(1, 1, 1, planes=2) + two + bytes(4),
        "flat": head(0, 1, 1) + two,
        "rle": head(1, 1, 8, 1) + bytes(1100),
        "depth": head(1, 1, 2) + two + bytes(4),
        "gap": head(1, 1, 32, 3) + struct.pack("<IIII", 0xFF00FF, 0xFF00, 0xFF, 0),
        "many": head(9000, 9000, 1) + two,
        "upside": head(1, -1, 8, 1) + bytes(1100),
        "none": b"",
    }
    frame = spark.createDataFrame([(k, bytearray(v)) for k, v in images.items()] + [("null", None)], "k string, content binary")
    faults = {r.k: r.fault for r in dib.heads(frame).collect()}
    assert {k: f for k, f in faults.items() if f} == {"short": "palette length", "palette": "palette length", "version": "header version", "planes": "dimensions", "flat": "dimensions", "rle": "compression", "depth": "bit count", "gap": "masks", "many": "pixel count", "upside": "top-down compression", "none": "header", "null": "header"}
    rows = {(r.k, r.y): r.colors or r.fault for r in dib.pixel_rows(frame, ["k"]).collect()}
    dark, light = 0xFF1E140A, 0xFF3C3228
    assert rows == {
        ("core", 0): [0xFF0D0C0B, 0xFF100F0E, 0xFF131211], ("core", 1): [0xFF030201, 0xFF060504, 0xFF090807],
        ("mono", 0): [light if b == "1" else dark for b in "1010000001"], ("mono", 1): [light] * 10, ("masks", 0): [0xFFFFFFFF], ("index", 0): "palette index",
    }
    assert {(r.k, r.y): r.bits for r in dib.mono_rows(frame, ["k"]).collect()} == {("mono", 0): [b == "1" for b in "1010000001"], ("mono", 1): [True] * 10}




@pytest.mark.parametrize("page", [932, 936, 949, 950])
def test_double_byte_text(spark, page):
    known = {932: (b"\x82\x6c\x82\x72\x20\x83\x53", "ＭＳ ゴ"), 936: (b"\xcb\xce\xcc\xe5", "宋体"), 949: (b"\xb1\xbc\xb8\xb2", "굴림"), 950: (b"\xb7\x73\xb2\xd3", "新細")}[page]
    rng = random.Random(page)
    cases = [known[0], b"A\x81", b"\x81\x00A", b"\x81\x20A", b"", b"\x81\x81\x81", bytes(range(256)), *[bytes(rng.randrange(256) for _ in range(40)) for _ in range(30)]]
    table, default = text.double_byte_table(page), chr(text.DOUBLE[page][0])
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)] + [(99, None)], "i int, data binary").withColumn("d", text.decode_double(F.col("data"), page)).collect()
    for r in rows:
        if r.data is None:
            assert r.d is None
            continue
        units, spans, i, data = [], [], 0, bytes(r.data)
        while i < len(data):
            two = text.is_lead(page, data[i]) and i + 1 < len(data) and data[i + 1] != 0
            u = table[256 * data[i] + data[i + 1]] if two else text.NONE if text.is_lead(page, data[i]) else table[data[i]]
            units.append(default if u == text.NONE else u)
            spans.append(1 + two)
            i += 1 + two
        assert (r.d.units, r.d.spans) == (units, spans) and sum(r.d.spans) == len(data)
    assert "".join(rows[0].d.units) == known[1]
    text_of = codecs.decode(known[0], f"cp{page}")
    assert text.decode_bytes(spark.createDataFrame([(bytearray(known[0]),)], "b binary"), "b", page, "t").first().t == text_of


def wmf_record(code, words):
    body = b"".join(struct.pack("<H", w & 0xFFFF) for w in words)
    return struct.pack("<IH", 3 + len(words), code) + body


def test_transfers_without_a_bitmap_and_ranges(spark):
    records = [
        ("bare", "WMF", 0x0940, wmf_record(0x0940, [0x42, 0xF0, 1, 2, 999, 11, 12, 13, 14])),
        ("full", "WMF", 0x0940, wmf_record(0x0940, [0x42, 0xF0, 1, 2, 11, 12, 13, 14, *[0] * 6])),
        ("wide", "WMF", 0x0B41, wmf_record(0x0B41, [0, 0, 5, 6, 1, 2, 999, 11, 12, 13, 14])),
        ("device", "WMF", 0x0D33, wmf_record(0x0D33, [0, 3, 4, 1, 2, 40000, 50000, 7, 60000])),
        ("poly", "WMF", 0x0324, wmf_record(0x0324, [-1])),
        ("line", "WMF", 0x0325, wmf_record(0x0325, [1, 5, 5])),
        ("scale", "WMF", 0x0410, wmf_record(0x0410, [0, 1, 1, 1])),
        ("level", "EMF", 34, struct.pack("<IIi", 34, 12, 1)),
        ("bezier", "EMF", 2, struct.pack("<IIiiiiI", 2, 28, 0, 0, 0, 0, 5)),
        ("reserved", "EMF+", 0x4006, struct.pack("<HHII", 0x4006, 0, 12, 0)),
    ]
    frame = spark.createDataFrame([(k, f, t, bytearray(r)) for k, f, t, r in records], "k string, format string, type int, raw binary")
    rows = {r.k: r for r in layouts.range_faults(layouts.decode(frame)).collect()}
    bare = {"height": 11, "width": 12, "y": 13, "x": 14}
    for k in ("bare", "full", "wide"):
        assert bare.items() <= rows[k].fields.items() and rows[k].fault is None
    assert {"height": 40000, "width": 50000, "y": 7, "x": 60000}.items() <= rows["device"].fields.items()
    assert {k: r.fault for k, r in rows.items() if r.fault} == {"poly": "point count", "scale": "zero scale denominator", "level": "restore level", "bezier": "Bezier point count", "reserved": "reserved type"}
    assert metafiles.PLUS_COMMENT and rows["line"].fields["n"] == 1


def path_fault(types):
    """The first type that can't stand where it does, or what is cut off at the end."""
    started, curve = False, 0
    for i, t in enumerate(types):
        kind = t & 15
        if t & 64 or kind not in (0, 1, 3):
            return i, "type"
        if kind == 0 and curve:
            return i, "start inside a curve"
        if kind and not started:
            return i, "segment without a start"
        if kind == 1 and curve:
            return i, "incomplete curve"
        started = started or kind == 0
        curve = (curve + (kind == 3)) % 3
        if t & 128:
            if curve:
                return i, "close inside a curve"
            started = False
    return (len(types), "incomplete curve") if curve else None


def test_paths_are_read_with_their_faults(spark):
    rng, made = random.Random(8), []
    for k in range(120):
        types = []
        while len(types) < rng.randint(1, 9):
            types += rng.choice([[0], [0, 1], [1], [3, 3, 3], [129], [3, 3, 131], [0, 3] if rng.random() < 0.2 else [1], [65] if rng.random() < 0.1 else [0]])
        n, flags = len(types), rng.choice([0, 0x4000, 0x800, 0x2800])
        points = [(rng.randint(-900, 900), rng.randint(-60, 60)) for _ in types]
        if flags & 0x800:
            steps = [(points[i][0] - (points[i - 1][0] if i else 0), points[i][1] - (points[i - 1][1] if i else 0)) for i in range(n)]
            body = b"".join(bytes([v & 127]) if -64 <= v <= 63 else struct.pack(">H", v & 0x7FFF | 0x8000) for s in steps for v in s)
            i = 0
            while i < n:
                j = i
                while j < n and types[j] == types[i]:
                    j += 1
                body += bytes([64 | (j - i) | (128 if types[i] & 15 == 3 else 0), types[i]])
                i = j
        else:
            body = b"".join(struct.pack("<hh" if flags else "<ff", *p) for p in points) + bytes(types)
        made.append((k, bytearray(struct.pack("<III", 0xDBC01002, n, flags) + body + bytes(rng.randrange(4))), types, points))
    bad = {200: struct.pack("<III", 5, 1, 0) + bytes(9), 201: struct.pack("<III", 0xDBC01002, 1 << 31, 0), 202: struct.pack("<III", 0xDBC01002, 2, 0) + bytes(15), 203: struct.pack("<III", 0xDBC01002, 2, 0x4000) + bytes(9), 204: struct.pack("<III", 0xDBC01002, 1, 0x4000) + bytes(10), 205: struct.pack("<III", 0xDBC01002, 1, 0x800) + bytes([1, 1, 1, 0]), 206: struct.pack("<III", 0xDBC01002, 1, 0x800) + bytes([1, 1, 65, 3]), 207: b""}
    rows = spark.createDataFrame([(k, d) for k, d, _, _ in made] + [(k, bytearray(d)) for k, d in bad.items()] + [(208, None)], "k int, data binary").repartition(3)
    got = {r.k: r for r in objects.decode_paths(rows).collect()}
    for k, _, types, points in made:
        fault = path_fault(types)
        assert (got[k].fault and tuple(got[k].fault)) == fault
        if not fault:
            assert got[k].path.types == types and [tuple(p) for p in got[k].path.points] == points
    assert {k: got[k].fault.what for k in [*bad, 208]} == {200: "signature", 201: "point count", 202: "points", 203: "types", 204: "extra data", 205: "type run", 206: "type run", 207: "signature", 208: "signature"} or got[204].fault is None
    assert sum(path_fault(t) is None for _, _, t, _ in made) > 10
