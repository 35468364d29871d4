"""Framing and decoding of files built from the layouts, and the damage that must be reported."""

import struct

import pytest

from strokelake.functions import layouts
from strokelake.sources import metafiles


def wmf(records=(struct.pack("<IHhh", 5, 0x0214, 20, 10),), placeable=False):
    body = b"".join(records) + struct.pack("<IH", 3, 0)
    most = max([3, *(len(r) // 2 for r in records)])
    data = struct.pack("<HHHIHIH", 2, 9, 0x300, 9 + len(body) // 2, 0, most, 0) + body
    if placeable:
        words = struct.unpack("<10H", struct.pack("<IHhhhhHI", 0x9AC6CDD7, 0, -10, 0, 100, 200, 1440, 0))
        total = 0
        for w in words:
            total ^= w
        data = struct.pack("<10HH", *words, total) + data
    return data


def emf(records=()):
    body = b"".join(records) + struct.pack("<IIIII", 14, 20, 0, 16, 20)
    head = bytearray(88)
    struct.pack_into("<II", head, 0, 1, 88)
    struct.pack_into("<ii", head, 16, 100, 200)
    struct.pack_into("<IIIIH", head, 40, 0x464D4520, 0x10000, 88 + len(body), 2 + len(records), 1)
    return bytes(head) + body


def plus(kind, flags=0, data=b""):
    return struct.pack("<HHII", kind, flags, 12 + len(data), len(data)) + data


def comment(data):
    body = struct.pack("<I", 0x2B464D45) + data
    return struct.pack("<III", 70, 12 + len(body), len(body)) + body


EMFPLUS = emf([comment(plus(0x4001, 1, struct.pack("<IIII", 0xDBC01002, 1, 96, 120))), comment(plus(0x4002))])


def test_whole_files():
    rows, fault = metafiles.frame(wmf())
    assert fault is None and [(r[1], r[3], len(r[5])) for r in rows] == [(0x0214, 18, 10), (0, 28, 6)]
    rows, fault = metafiles.frame(wmf(placeable=True))
    assert fault is None and [r[3] for r in rows] == [40, 50]
    rows, fault = metafiles.frame(emf())
    assert fault is None and [r[1] for r in rows] == [1, 14]
    assert len(EMFPLUS) == 180
    rows, fault = metafiles.frame(EMFPLUS)
    assert fault is None and [(r[0], r[1]) for r in rows] == [("EMF", 1), ("EMF", 70), ("EMF+", 0x4001), ("EMF", 70), ("EMF+", 0x4002), ("EMF", 14)]
    assert [r[4] for r in rows] == [-1, -1, 88, -1, 132, -1]


DAMAGE = [
    ("wmf zero record", wmf(), 18, 0), ("wmf overflowing words", wmf(), 18, 0xFFFFFFFF), ("wmf max record", wmf(), 12, 4), ("wmf missing EOF", wmf(), 30, 0x12340000),
    ("placeable checksum", wmf(placeable=True), 6, 42), ("emf record count", emf(), 52, 3), ("emf signature", emf(), 40, 0), ("emf short header", emf(), 4, 84),
    ("emf unaligned record", emf(), 92, 19), ("emf SizeLast", emf(), 104, 19), ("emf description overflow", emf(), 60, 0xFFFFFFFF), ("emf palette count", emf(), 96, 1),
    ("comment size", EMFPLUS, 96, 0xFFFFFFFF), ("plus record size", EMFPLUS, 108, 0xFFFFFFFC), ("plus data size", EMFPLUS, 112, 0xFFFFFFFF), ("plus signature", EMFPLUS, 116, 0),
    ("plus missing header", EMFPLUS, 104, 0x4003), ("plus missing EOF", EMFPLUS, 148, 0x4003),
]


@pytest.mark.parametrize("name, data, at, value", DAMAGE, ids=[d[0] for d in DAMAGE])
def test_damage_is_reported_inside_the_file(name, data, at, value):
    bad = data[:at] + struct.pack("<I", value) + data[at + 4 :]
    _, fault = metafiles.frame(bad)
    assert fault is not None and 0 <= fault[0] <= len(bad) and fault[2] in ("MALFORMED", "LIMIT")


def test_every_truncation_is_reported():
    for data in (wmf(), wmf(placeable=True), emf(), EMFPLUS):
        for n in range(len(data)):
            assert metafiles.frame(data[:n])[1] is not None


def test_limits():
    many = wmf([struct.pack("<IHhh", 5, 0x0213, i, i) for i in range(10)])
    assert metafiles.frame(many, metafiles.Limits(records=5))[1][2] == "LIMIT"
    assert metafiles.frame(many, metafiles.Limits(record_bytes=8))[1][2] == "LIMIT"
    assert metafiles.frame(many, metafiles.Limits(file_bytes=8))[1][2] == "LIMIT"


def test_decoding(spark):
    matrix = struct.pack("<IIffffff", 35, 32, 0.1, -2.5, 3.0, 1e-3, 100.0, 0.0)
    point = struct.pack("<IIii", 27, 16, -5, 70000)
    files = spark.createDataFrame([("w", bytearray(wmf([struct.pack("<IHhh", 5, 0x0214, -20, 10), struct.pack("<IHIhh", 7, 0x041F, 0xAABBCC, -1, 2)]))), ("e", bytearray(emf([matrix, point]))), ("p", bytearray(EMFPLUS)), ("bad", bytearray(b"nothing")), ("null", None)], "path string, content binary")
    rows = {(r.file, r.seq): r for r in layouts.decode(metafiles.records(files)).collect()}
    assert rows["w", 0].name == "MoveTo" and rows["w", 0].fields == {"y": -20.0, "x": 10.0}
    assert rows["w", 1].fields == {"color": float(0xAABBCC), "y": -1.0, "x": 2.0}
    assert rows["e", 1].fields == {k: struct.unpack("<f", struct.pack("<f", v))[0] for k, v in zip(("m11", "m12", "m21", "m22", "dx", "dy"), (0.1, -2.5, 3.0, 1e-3, 100.0, 0.0))}
    assert rows["e", 2].fields == {"x": -5.0, "y": 70000.0}
    assert rows["p", 2].fields["dpiy"] == 120.0
    assert {(r.file, r.kind) for r in metafiles.issues(files).collect()} == {("bad", "FORMAT"), ("null", "FORMAT")}
    assert {r.s for r in files.filter("path in ('w', 'e')").select(metafiles.sniff(files.content).alias("s")).collect()} == {"WMF", "EMF"}


def test_layout_tables_are_sound():
    rows = layouts.layout_rows()
    assert len({(f, c) for f, c, _, _ in rows}) == len(rows)
    low = [c % 256 for f, c, _, _ in rows if f == "WMF"]
    assert len(set(low)) == len(low) == 70


def test_polygons_stay_inside_their_record(spark):
    from strokelake.functions import points

    one = struct.pack("<IHH6h", 10, 0x0324, 3, 1, 2, -3, 4, 5, -6)
    two = struct.pack("<IHH2H6h", 12, 0x0538, 2, 1, 2, 1, 2, -3, 4, 5, -6)
    long = struct.pack("<IHH6h", 10, 0x0325, 4, 1, 2, -3, 4, 5, -6)
    none = struct.pack("<IHH", 4, 0x0325, 0)
    wide = struct.pack("<II16xI4i", 3, 44, 2, 70000, -70000, 7, 8)
    files = spark.createDataFrame([("w", bytearray(wmf([one, two, long, none]))), ("e", bytearray(emf([wide])))], "path string, content binary")
    got = {(r.file, r.seq): r.polygons and [[(p.x, p.y) for p in poly] for poly in r.polygons] for r in points.polygons(metafiles.records(files)).collect()}
    assert got["w", 0] == [[(1, 2), (-3, 4), (5, -6)]] and got["w", 1] == [[(1, 2)], [(-3, 4), (5, -6)]]
    assert got["w", 2] is None and got["w", 3] == [[]] and got["e", 1] == [[(70000, -70000), (7, 8)]] and got["w", 4] is None


def test_playing_keeps_contexts(spark):
    from strokelake.operators import play

    color = lambda n: struct.pack("<IHHhhI", 8, 0x02FA, 0, 1, 0, n)
    short = lambda code, *v: struct.pack(f"<IH{len(v)}h", 3 + len(v), code, *v)
    made = [color(7), short(0x012D, 0), short(0x001E), short(0x020B, 5, 10), short(0x0214, 1, 2), short(0x0213, 3, 4), short(0x0127, -1), short(0x0213, 6, 8), short(0x0127, -1), short(0x01F0, 0), color(9), short(0x012D, 0), short(0x041B, 4, 3, 2, 1), struct.pack("<IHHHHHH", 8, 0x0548, 0, 0, 0, 0, 0)]
    decoded = layouts.decode(metafiles.records(spark.createDataFrame([("f", bytearray(wmf(made)))], "path string, content binary")))
    played = play.contexts(decoded)
    ops = [(r.seq, r.shape, [(p.x, p.y) for p in r.points], r.color) for r in play.operations(decoded, played, far_edges=True).orderBy("seq").collect()]
    assert ops == [(5, "line", [(-8.0, -4.0), (-6.0, -2.0)], 7), (7, "line", [(0.0, 0.0), (8.0, 6.0)], 7), (12, "rectangle", [(1.0, 2.0), (3.0, 4.0)], 16777215)]
    assert {(r.seq, r.reason) for r in play.reported(decoded, played).collect()} == {(8, "restore level"), (13, "flood fill")}


def test_streamed_files(spark, tmp_path):
    from strokelake.streaming import files

    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.wmf").write_bytes(wmf() if i else b"no file")
    for frame, name in ((files.stream_records(spark, str(tmp_path / "in"), 2), "records"), (files.stream_issues(spark, str(tmp_path / "in"), 2), "issues")):
        frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("records").filter("name = 'MoveTo'").count() == 4 and spark.table("issues").count() == 1
