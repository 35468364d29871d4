"""Native operators against plain Python, and every registered query against its SQL."""

import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strokelake.functions import geometry, pixels
from strokelake.operators import codecs, play, regions, state, text
from strokelake.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_sql(spark, base, name):
    frame = registry.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    cursor = base.execute(registry.oracles()[name])
    there = [c[0] for c in cursor.description]
    assert sorted(there) == columns
    plain = lambda v: round(v, 3) if isinstance(v, float) else v
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[there.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)


def test_rop3_is_its_own_truth_table(spark):
    rows = spark.range(256).select(F.col("id").cast("int").alias("code"))
    got = rows.select("code", pixels.rop3(F.col("code"), F.lit(0xF0), F.lit(0xCC), F.lit(0xAA)).alias("v"), pixels.rop3_uses(F.col("code"), "D").alias("d")).collect()
    assert all(r.v == r.code for r in got)
    assert {r.code: r.d for r in got}[0xCC] is False and {r.code: r.d for r in got}[0x88] is True


def test_matrices(spark):
    a = {"m11": 1.0, "m12": 2.0, "m21": -1.0, "m22": 0.5, "dx": 3.0, "dy": -4.0}
    b = {"m11": 0.0, "m12": 1.0, "m21": -1.0, "m22": 0.0, "dx": 10.0, "dy": 20.0}
    lit = lambda m: {k: F.lit(v) for k, v in m.items()}
    both = geometry.apply(geometry.then(lit(a), lit(b)), F.lit(7.0), F.lit(9.0))
    step = geometry.apply(lit(b), *geometry.apply(lit(a), F.lit(7.0), F.lit(9.0)))
    r = spark.range(1).select(*both, *step).first()
    assert r[0] == pytest.approx(r[2]) and r[1] == pytest.approx(r[3])
    k = spark.range(1).select(geometry.arc_control_length(F.lit(math.pi / 2)), geometry.flatten_steps(F.lit(12.0))).first()
    assert k[0] == pytest.approx(4 / 3 * math.tan(math.pi / 8)) and k[1] == 6


def cells(spans):
    return {(r.y, x) for r in spans for x in range(r.x0, r.x1)}


def test_regions_equal_grids(spark):
    rects = [(1, 0, 0, 6, 5, 0), (1, 3, 2, 9, 8, 1), (1, 2, 4, 4, 12, 1), (1, 5, 5, 5, 9, 0), (1, 20, 1, 27, 7, 0)]
    frame = spark.createDataFrame(rects, "g int, left int, top int, right int, bottom int, side int")
    a, b = (regions.scan_lines(frame.filter(F.col("side") == s), ["g"]) for s in (0, 1))
    grid = [{(y, x) for _, l, t, r, m, k in rects if k == s for y in range(t, m) for x in range(l, r)} for s in (0, 1)]
    for op, want in (("intersect", grid[0] & grid[1]), ("union", grid[0] | grid[1]), ("xor", grid[0] ^ grid[1]), ("difference", grid[0] - grid[1])):
        spans = regions.combine(a, b, ["g"], op).collect()
        assert cells(spans) == want and sum(r.x1 - r.x0 for r in spans) == len(want)
    whole = grid[0] | grid[1]
    core = {(y, x) for y, x in whole if all((y + i, x + j) in whole for i, j in itertools.product((-1, 0, 1), (-2, -1, 0, 1, 2)))}
    assert cells(regions.frame(frame, ["g"], 2, 1).collect()) == whole - core


def test_codecs(spark):
    values = [b"", b"a", b"aaaa", b"abcabc" * 50, bytes(300) + b"x" * 129 + bytes(range(256)), None]
    frame = spark.createDataFrame([(i, None if v is None else bytearray(v)) for i, v in enumerate(values)], "i int, data binary")
    for r in frame.withColumn("back", codecs.unpackbits(codecs.packbits("data"))).collect():
        assert (None if r.back is None else bytes(r.back)) == values[r.i]
    bad = spark.createDataFrame([(bytearray(b"\x05ab"),)], "data binary").select(codecs.unpackbits(F.col("data")).alias("b")).first()
    assert bad.b is None
    parts = frame.filter("data is not null").select("i", F.posexplode(codecs.fragments(F.col("data"), 31)).alias("k", "part"))
    for r in codecs.join_fragments(parts, ["i"], "k").collect():
        assert bytes(r.content) == values[r.i] and r.whole
    lost = codecs.join_fragments(parts.filter("k <> 1"), ["i"], "k").filter("i = 3").first()
    assert not lost.whole


def test_empty_null_and_repeated_documents_are_extracted(spark, tmp_path):
    """a file for every row, also without bytes or text and where an id comes twice."""
    rows = [(1, ""), (2, None), (3, "a" * 4000), (4, "é" * 6001), (5, "x" * 9000), (5, "y" * 9000), (5, ""), (5, None), (6, "same"), (6, "same"), (None, "no id"), (None, "other" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [(r.doc_id, r.n_bytes, r.digest, r.whole) for r in registry.queries()["wmfc_extract"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(registry.oracles()["wmfc_extract"]).fetchall(), key=repr) and len(got) == len(rows)
    pieces = spark.createDataFrame(rows, "k long, t string").select("t", codecs.fragments(F.encode("t", "UTF-8"), 4000).alias("p")).distinct().collect()
    assert {r.t: r.p and [(p.current, p.remaining, len(p.bytes)) for p in r.p] for r in pieces if not r.t or len(r.t) == 4000} == {"": [(0, 0, 0)], None: None, "a" * 4000: [(4000, 0, 4000)]}


def test_slots_are_the_lowest_free(spark):
    ops = [("create", 0)] * 3 + [("delete", 1), ("create", 0), ("select", 2), ("delete", 0), ("delete", 2), ("create", 9), ("create", 9), ("create", 9), ("select", 0)]
    frame = spark.createDataFrame([(1, i, *op) for i, op in enumerate(ops)] + [(2, 0, "delete", 0), (2, 1, "create", 0), (None, 5, "create", 0)], "user_id int, event_id int, op string, handle int")
    got = [(r.user_id, r.slot, r.fault) for r in state.allocate_slots(frame, ["user_id"], ["event_id"], "op", "handle", 3).orderBy("user_id", "event_id").collect()]
    assert got == [(None, 0, None), *[(1, n, None) for n in (0, 1, 2, 1, 1, 2, 0, 2, 0, 2)], (1, None, "slots"), (2, None, "undefined handle")]


def test_code_pages_and_reordering(spark):
    pages = {(r.page, r.byte): r.code_point for r in text.code_pages(spark).collect()}
    assert len(pages) == 2560 and pages[1252, 0x80] == 0x20AC and pages[1252, 0x81] == 0x81 and pages[1257, 0xA1] == 0xF8FC
    frame = spark.createDataFrame([("abc",), ("אבג",), ("ab אב 12 cd",), ("",), (None,)], "t string")
    rows = frame.withColumn("l", text.bidi_levels("t")).withColumn("o", text.display_order("l")).collect()
    assert rows[0].l == [0, 0, 0] and rows[1].l == [1, 1, 1] and rows[1].o == [2, 1, 0]
    assert rows[2].l == [0, 0, 0, 1, 1, 1, 2, 2, 0, 0, 0] and "".join(rows[2].t[i] for i in rows[2].o) == "ab 12 בא cd"
    assert rows[3].l == [] and rows[4].l is None


def test_rle_bytes(spark):
    images = [([1, 1, 1, 2, 3, 4, 5, 5, 0, 0], 5, 4), ([7] * 300 + list(range(256)) + [9] * 44, 300, 8), ([3], 1, 4), ([1, 2, 1, 2, 1, 2, 1], 7, 4), ([], 0, 8)]
    frame = spark.createDataFrame([(i, *x) for i, x in enumerate(images)], "i int, p array<int>, w int, b int").withColumn("h", F.when(F.col("w") > 0, F.size("p") / F.col("w")).otherwise(0).cast("int"))
    back = frame.withColumn("d", codecs.encode_rle(F.col("p"), F.col("w"), F.col("b"))).withColumn("r", codecs.decode_rle(F.col("d"), F.col("w"), F.col("h"), F.col("b")))
    assert {r.i: (r.r.pixels, r.r.fault) for r in back.collect()} == {i: (x[0], None) for i, x in enumerate(images)}
    bad = {b"\x05\x01\0\1": "run outside row", b"\0\5\1\1": "run outside row", b"\0\0\0\0\0\0\0\1": "row overflow", b"\0\2\1": "delta", b"\0\2\0\2": "delta outside image", b"\0\4\1": "absolute bytes", b"\1": "command", b"\1\1": "missing end"}
    rows = spark.createDataFrame([(bytearray(b),) for b in [*bad, b"\2\x09\0\2\1\1\1\x08\0\1"]], "d binary")
    got = {bytes(r.d): r.r for r in rows.withColumn("r", codecs.decode_rle(F.col("d"), F.lit(4), F.lit(2), F.lit(8))).collect()}
    assert {b: got[b].fault for b in bad} == bad and all(got[b].pixels is None for b in bad)
    assert got[b"\2\x09\0\2\1\1\1\x08\0\1"].pixels == [None, None, None, 8, 9, 9, None, None]


def test_double_byte_pages_are_read(spark):
    frame = spark.createDataFrame([(bytearray(b"A\x83\x53\x81"),), (None,)], "d binary")
    got = text.decode_bytes(frame, "d", 932, "t").collect()
    assert [r.t for r in got] == ["Aゴ・", None]


def test_text_queries_read_whole_documents(spark, base):
    import hashlib

    whole = dict(base.execute("select doc_id, text from documents").fetchall())
    for r in registry.queries()["bidi_levels"](spark, FOLDER).collect():
        assert r.text.replace(" אבג 12 ", "", 1) == whole[r.doc_id] and len(r.levels) == len(r.text)
        assert sorted(r.display) == list(range(len(r.text))) and any(r.levels)
    pages = {(r.page, r.byte): chr(r.code_point) for r in text.code_pages(spark).collect()}
    for r in registry.queries()["codepage_documents"](spark, FOLDER).collect():
        data = whole[r.doc_id].encode()
        for page in (874, 1252, 1253, 1255, 1257):
            assert r[f"sha256_{page}"] == hashlib.sha256("".join(pages[page, b] for b in data).encode()).hexdigest()


def test_entry_imports_without_the_training_operators(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert "walk_wmf_summary" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    sys.modules.pop("__spark_entry__", None)


def test_playing_objects_modes_and_reports(spark):
    rows = [
        ("CreateFontIndirect", {"height": 9.0}), ("CreatePenIndirect", {"color": 255.0}), ("CreateBrushIndirect", {"color": 7.0}), ("SelectObject", {"object": 1.0}), ("SelectObject", {"object": 2.0}),
        ("LineTo", {"x": 4.0, "y": 4.0}), ("DeleteObject", {"object": 1.0}), ("LineTo", {"x": 5.0, "y": 5.0}), ("DeleteObject", {"object": 1.0}), ("Rectangle", {"left": 9.0, "top": 8.0, "right": 1.0, "bottom": 2.0}),
        ("SetMapMode", {"mode": 2.0}), ("SetPixel", {"x": 1.0, "y": 1.0, "color": 3.0}), ("Polygon", {"n": 3.0}), ("TextOut", {"length": 1.0}), (None, None), ("SelectObject", {"object": float(0x80000006)}), ("LineTo", {"x": 0.0, "y": 0.0}), ("SetMapMode", {"mode": 9.0}), ("SetPixel", {"x": 1.0, "y": 1.0, "color": 3.0}), ("EOF", {}),
    ]
    frame = spark.createDataFrame([("f", k, "WMF", n, f) for k, (n, f) in enumerate(rows)], "file string, seq int, format string, name string, fields map<string, double>")
    played = play.contexts(frame)
    drawn = {r.seq: r for r in play.operations(frame, played, far_edges=False).collect()}
    # The font takes slot 0; the deleted pen gives way to the black one; a WMF box is ordered and leaves out its far edges.
    assert (drawn[5].color, drawn[7].color, drawn[16].color) == (255, 0, 0xFFFFFF) and drawn[9].color == 7
    assert [tuple(p) for p in drawn[9].points] == [(1.0, 2.0), (8.0, 7.0)]
    scale = 96 / 25.4 / 10
    assert [tuple(p) for p in drawn[11].points] == [(math.floor(scale), math.floor(-scale))] == [tuple(p) for p in drawn[18].points]
    assert {r.seq: r.reason for r in play.reported(frame, played).collect()} == {8: "unknown object", 12: "not drawn", 13: "not drawn", 14: "unknown record"}


def test_every_type_of_the_formats_has_a_name():
    from collections import Counter

    from strokelake.functions import layouts

    assert Counter(r[0] for r in layouts.layout_rows()) == {"WMF": 70, "EMF": 119, "EMF+": 55}
    assert len({(r[0], r[2]) for r in layouts.layout_rows()}) == 244


def test_plus_points_refuse_what_does_not_fit(spark):
    from strokelake.functions import points

    rows = [(b"\x01\x7f\x40\x05", 2, 0x800), (b"\x01\x7f\x40\x85\x00", 2, 0x800), (b"\x01\x7f\x40\x85", 2, 0x800), (b"\x01\x7f\x40", 2, 0x800), (b"\x01\x00\xff\xff", 1, 0x4000), (b"\x01\x00\xff", 1, 0x4000), (b"\0\0\x80\x3f\0\0\0\xc0", 1, 0), (b"", 0, 0)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, raw binary, n long, flags int")
    got = {r.k: r.p and [tuple(x) for x in r.p] for r in frame.select("k", points.plus_points(F.col("raw"), F.lit(0), F.col("n"), F.col("flags")).alias("p")).collect()}
    assert got[0] == [(1.0, -1.0), (-63.0, 4.0)] and got[1] == [(1.0, -1.0), (-63.0, 1279.0)] and got[4] == [(1.0, -1.0)] and got[6] == [(1.0, -2.0)]
    assert got[2] is None and got[3] is None and got[5] is None and got[7] == []


def test_open_brackets_and_effects(spark):
    from pyspark.sql import functions as F

    from strokelake.operators import state

    rows = [("a", 1, "begin"), ("a", 2, "end"), ("a", 3, "begin"), ("a", 4, None), ("b", 1, "begin"), ("b", 2, "end"), ("c", 1, "describe"), ("c", 2, "use"), ("c", 3, "describe"), ("c", 4, "use"), ("d", 1, "use"), ("d", 2, "describe")]
    frame = spark.createDataFrame(rows, "file string, seq int, op string")
    opened = lambda f: [tuple(r) for r in state.open_brackets(f, ["file"], ["seq"], "op").collect()]
    assert opened(frame) == [("a", 3)] and opened(frame.limit(0)) == []
    bound = state.bind_effects(frame, ["file"], ["seq"], F.col("op") == "describe", F.col("op") == "use")
    assert {(r.file, r.seq): (r.effect, r.fault) for r in bound.filter("op = 'use'").collect()} == {("c", 2): (1, None), ("c", 4): (3, None), ("d", 1): (None, "effect without description")}
    assert bound.filter("op is null or op <> 'use'").filter("effect is not null or fault is not null").count() == 0
