"""State carried over blocks of a file, against plain loops, with blocks so small that several levels are needed."""

import random

import pytest
from pyspark.sql import functions as F

from strokelake.operators import replay, scan, state


def made(n, seed, ops, gaps=2):
    """Files 0 to 3 and one without a key; file 0 has a third of the rows and more."""
    rng = random.Random(seed)
    at, rows = 0, []
    for _ in range(n):
        at += rng.randint(1, gaps)
        rows.append((rng.choice([0, 0, 1, 2, 3, None]), at, *ops(rng)))
    return rows


@pytest.mark.parametrize("block", [6, 256])
def test_sums_of_a_scan(spark, block):
    rows = made(120, 1, lambda r: (r.randint(-9, 9), "x"))
    frame = spark.createDataFrame(rows, "k int, at long, v long, _at string").repartition(4)
    got = scan.scan(frame, ["k"], "at", F.struct(F.col("v").alias("n")), lambda a, b: F.struct((a["n"] + b["n"]).alias("n")), block)
    assert got.columns == ["k", "at", "v", "_at", "_before", "_upto"]
    want, sums = {}, {}
    for k, at, v, _ in rows:
        want[at] = (sums.get(k), sums.get(k, 0) + v)
        sums[k] = sums.get(k, 0) + v
    assert {r.at: (r._before and r._before.n, r._upto.n) for r in got.collect()} == want
    assert scan.scan(frame.limit(0), ["k"], "at", F.struct("v"), lambda a, b: b).count() == 0


@pytest.mark.parametrize("block", [6, 256])
def test_save_restore_over_blocks(spark, block):
    rows = made(150, 2, lambda r: (r.choice(["save", "restore", "restore", "set", "draw", None]), r.randint(0, 99)))
    got = state.save_restore(spark.createDataFrame(rows, "k int, at long, op string, v long").repartition(3), ["k"], "at", "op", "v", 5, block)
    want, now = {}, {}
    for k, at, op, v in rows:
        value, stack = now.get(k, (5, []))
        if op == "save":
            stack = [*stack, value]
        elif op == "restore" and stack:
            *stack, value = stack
        elif op == "set":
            value = v
        now[k] = value, stack
        want[at] = value, len(stack)
    assert {r.at: (r.state, r.depth) for r in got.collect()} == want


@pytest.mark.parametrize("block, most", [(7, 1024), (256, 4)])
def test_restore_levels_and_first_faults(spark, block, most):
    rows = made(200, 3, lambda r: (r.choice(["save", "save", "save", "restore", "set", "draw"]), r.randint(0, 99), r.choice([-1, -1, -1, -2, 1, 2, 3, 0] if r.random() < 0.1 else [-1, -1, -2, 2])))
    got = state.restore_levels(spark.createDataFrame(rows, "k int, at long, op string, v long, n int").repartition(3), ["k"], "at", "op", "v", "n", 5, most, block)
    want, now, ended = {}, {}, set()
    for k, at, op, v, n in rows:
        if k in ended:
            continue
        value, stack = now.get(k, (5, []))
        fault = None
        if op == "save":
            fault = "saved states" if len(stack) >= most else None
            stack = [*stack, value]
        elif op == "restore":
            to = len(stack) + n if n < 0 else n - 1
            if n == 0 or not 0 <= to < len(stack):
                fault = "restore level"
            else:
                value, stack = stack[to], stack[:to]
        elif op == "set":
            value = v
        if fault:
            ended.add(k)
        now[k] = value, stack
        want[at] = (None, None, fault) if fault else (value, len(stack), None)
    assert {r.at: (r.state, r.depth, r.fault) for r in got.collect()} == want and ended


def product(x, y):
    return (x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3], x[4] * y[0] + x[5] * y[2] + y[4], x[4] * y[1] + x[5] * y[3] + y[5])


@pytest.mark.parametrize("block", [6, 256])
def test_world_and_container_matrices(spark, block):
    kinds = ["set", "reset", "before", "after", "before", "save", "begin", "save", "begin", "restore", "end", "draw"]
    turns = [(1, 0, 0, 1), (0, 1, -1, 0), (2, 0, 0, 1), (1, 1, 0, 1), (-1, 0, 0, 1)]

    def op(r):
        kind = r.choice(kinds)
        return kind, r.choice([1, 1, 1, 2]), None if kind == "begin" and r.random() < 0.3 else tuple(map(float, (*r.choice(turns), r.randint(-3, 3), r.randint(-3, 3))))

    rows = made(150, 4, op)
    frame = spark.createDataFrame(rows, f"k int, at long, op string, idx int, m {scan.MATRIX}").repartition(3)
    got = state.plus_transforms(frame, ["k"], "at", "op", "idx", "m", block)
    one, want, now, ended = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), {}, {}, set()
    for k, at, kind, index, m in rows:
        if k in ended:
            continue
        world, box, stack = now.get(k, (one, one, []))
        fault = None
        if kind in ("restore", "end"):
            found = [i for i, s in enumerate(stack) if s[:2] == (index, kind == "end")]
            if found:
                world, box = stack[found[-1]][2:]
                stack = stack[: found[-1]]
            else:
                fault = "saved state index"
                ended.add(k)
        elif kind in ("save", "begin"):
            stack = [*stack, (index, kind == "begin", world, box)]
            if kind == "begin":
                world, box = one, product(product(m or one, world), box)
        elif kind != "draw":
            world = {"set": m, "reset": one, "before": product(m, world), "after": product(world, m)}[kind]
        now[k] = world, box, stack
        want[at] = (None, None, None, fault) if fault else (world, box, len(stack), None)
    found = {r.at: (r.world and tuple(r.world), r.container and tuple(r.container), r.depth, r.fault) for r in got.collect()}
    assert found == want and len(want) > 20


def test_short_files_are_stepped_through_and_long_ones_scanned(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, i, rng.choice(["save", "save", "save", "restore", "set", "before", "after", "begin", None]), rng.randint(0, 9), -1, i % 2, (0.0, 1.0, -1.0, 0.0, float(i), 1.0)) for k, n in ((0, 20), (1, 4), (None, 13)) for i in range(n)]
    frame = spark.createDataFrame(rows, f"k int, at long, op string, v long, n int, idx int, m {scan.MATRIX}").repartition(3)
    runs = (
        lambda: state.save_restore(frame, ["k"], "at", "op", "v", 5, 6),
        lambda: state.restore_levels(frame, ["k"], "at", "op", "v", "n", 5, 1024, 6),
        lambda: state.plus_transforms(frame, ["k"], "at", "op", "idx", "m", 6),
    )
    for run in runs:
        made = run()
        # One shuffle, and no interpreted loops over blocks.
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        found = []
        for blocks in (512, 2):
            monkeypatch.setattr(replay, "SHORT_BLOCKS", blocks)
            found.append(sorted(str(r).replace("=-0.0", "=0.0") for r in run().select(*made.columns).collect()))
        monkeypatch.undo()
        assert found[0] == found[1] and len(found[0]) > 3
