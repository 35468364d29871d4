"""Best-fit packing by length patterns.

Only the histogram of lengths (at most ``capacity`` bins) reaches the driver. There, patterns of one to three documents that
fill a sequence are enumerated, their repeat counts are fitted to the histogram by non-negative least squares and rounded,
and what is left is packed best-fit by decreasing length, still as counts. The plan says how many sequences repeat which
pattern; each document finds its place from its rank among those of its length, which is counted per salted group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, numbered, renamed

#: Groups over which the documents of one length are ranked, so that a length that a third of all rows has is no hot key.
SALTS = 64


def fill_patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int, most: int = 6000, waste: int = 0, common: int = 160) -> list[tuple[int, ...]]:
    """Lengths that together fill a sequence: pairs, then triples of the more frequent lengths, within ``waste`` of full.

    ``most`` patterns, and triples that begin with the ``common`` most frequent lengths, are what the fit looks at; documents
    that no chosen pattern takes are packed best-fit, so these bounds on the driver's work leave nothing out.
    """
    have = set(lengths.tolist())
    frequency = dict(zip(lengths.tolist(), counts.tolist()))
    out = [(a, b) for a in have for slack in range(waste + 1) if (b := capacity - slack - a) in have and b <= a and (a != b or frequency[a] > 1)]
    first = sorted(have, key=lambda n: -frequency[n])[:common]
    triples = []
    for i, a in enumerate(first):
        for b in first[i:]:
            for slack in range(waste + 1):
                if (c := capacity - slack - a - b) in have:
                    triples.append(tuple(sorted((a, b, c), reverse=True)))
    triples = sorted(set(triples), key=lambda p: -min(frequency[n] for n in p))
    return (sorted(set(out)) + triples)[:most]


def fit_repeats(patterns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by accelerated projected gradients."""
    at = {n: i for i, n in enumerate(lengths.tolist())}
    row = np.array([at[n] for p in patterns for n in p])
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    # Scaled by what the histogram holds, so that rare lengths count as much as frequent ones.
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    forward = lambda x: np.bincount(row, x[col], len(lengths)) * weight
    back = lambda r: np.bincount(col, (r * weight)[row], len(patterns))
    probe = np.ones(len(patterns))
    for _ in range(30):  # largest eigenvalue, for the step
        probe = back(forward(probe))
        probe /= np.linalg.norm(probe)
    step = 1 / (1.05 * np.linalg.norm(back(forward(probe))) + 1e-12)
    target, x, y, t = counts * weight, np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (was - 1) / t * (new - x), new
    return x


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) pairs that use every length exactly as often as the histogram has it."""
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    plan: Counter = Counter()
    lengths = np.array(list(left), np.int64)
    counts = np.array(list(left.values()), np.float64)
    patterns = fill_patterns(lengths, counts, capacity) if len(lengths) else []
    if patterns:
        repeats = fit_repeats(patterns, lengths, counts)
        for k in np.argsort(-repeats, kind="stable").tolist():
            need = Counter(patterns[k])
            if n := min(int(repeats[k]), *(left[a] // m for a, m in need.items())):
                plan[patterns[k]] += n
                for a, m in need.items():
                    left[a] -= n * m
    for pattern, n in _best_fit({a: c for a, c in left.items() if c}, capacity):
        plan[pattern] += n
    return sorted(plan.items())


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit by decreasing length. Sequences of equal content are one entry with a count, so the work doesn't grow with the rows."""
    rooms: dict[int, Counter] = {}  # free room -> contents -> sequences
    order: list[int] = []  # the rooms, ascending
    def add(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = Counter()
            order.insert(bisect_left(order, room), room)
        rooms[room][content] += n

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect_left(order, length)
            if i == len(order):  # no sequence has room: open as many as it takes, each with as many of these as fit
                each = min(capacity // length, n)
                add(capacity - each * length, (length,) * each, n // each)
                n -= n // each * each
                continue
            room = order[i]
            content, have = next(iter(sorted(rooms[room].items())))
            each = min(room // length, n)
            take = min(have, n // each)
            rooms[room][content] -= take
            if not rooms[room][content]:
                del rooms[room][content]
                if not rooms[room]:
                    del rooms[room], order[i]
            add(room - each * length, content + (length,) * each, take)
            n -= take * each
    return [(tuple(sorted(c, reverse=True)), n) for contents in rooms.values() for c, n in contents.items()]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): which ranks of a length stand where in which run of sequences."""
    out, used, sequence = [], Counter(), 0
    for pattern, n in plan:
        at = 0
        for length in pattern:
            out.append((length, used[length], n, sequence, at))
            used[length] += n
            at += length
        sequence += n
    return out


def place(pieces: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of 1 to ``capacity`` tokens; each sequence is filled from 0 without gaps.

    ``pieces`` is read three times, so give a checkpointed or stored frame. Ties and repeated rows each get a place of their own;
    null keys are keys like any other; an empty table gives an empty result. Columns of any name go with their rows, but that the
    two new ones replace those of their names. Lengths of null, under 1 or over ``capacity``
    are an error.
    """
    spark: SparkSession = pieces.sparkSession
    rows, names = numbered(pieces)
    length, ordered = names[length_col], [names[k] for k in keys]
    # A full piece is a sequence by itself and needs no rank; its number is negative.
    full = rows.filter(F.col(length) == capacity).withColumns({"_sequence": -1 - F.monotonically_increasing_id(), "_offset": F.lit(0).cast("long")})
    rows = rows.filter(F.col(length).isNull() | (F.col(length) != capacity))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*ordered), F.lit(SALTS)).cast("int")).withColumn("_length", F.col(length).cast("int"))
    groups = salted.groupBy("_length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    found = groups.collect()  # at most capacity x SALTS counts
    if any(r["_length"] is None or not 1 <= r["_length"] <= capacity for r in found):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    histogram: Counter = Counter()
    first = []
    for r in sorted(found, key=lambda r: (r["_length"], r["_salt"])):
        first.append((r["_length"], r["_salt"], histogram[r["_length"]]))
        histogram[r["_length"]] += r["_n"]
    plan = plan_patterns(dict(histogram), capacity)
    # Both tables are bounded by capacity x SALTS rows and by the patterns in use, whatever the number of documents.
    starts = spark.createDataFrame(first, "_length int, _salt int, _first long")
    slots: dict[int, list] = {}
    for n_tokens, rank, n, sequence, at in _slots(plan):
        slots.setdefault(n_tokens, []).append((rank, n, sequence, at))
    runs = spark.createDataFrame([(k, v) for k, v in slots.items()], T.StructType([T.StructField("_length", T.IntegerType()), T.StructField("_runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("rank", "n", "sequence", "at")])))]))
    within = salted.withColumn("_rank", F.expr(f"row_number() over (partition by _length, _salt order by {', '.join(ordered)}) - 1"))
    ranked = within.join(maybe_broadcast(starts), ["_length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_first"))
    placed = ranked.join(maybe_broadcast(runs), "_length").withColumn("_run", F.expr("filter(_runs, r -> _rank >= r.rank and _rank < r.rank + r.n)[0]"))
    placed = placed.select(*names.values(), F.expr("_run.sequence + _rank - _run.rank").alias("_sequence"), F.expr("_run.at").alias("_offset")).unionByName(full)
    return renamed(placed, names, {"sequence_id": "_sequence", "offset": "_offset"})


def assemble(placed: DataFrame, ids_col: str = "ids") -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, lengths``, from placed pieces that kept their ids (at most ``capacity`` ids a group)."""
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", ids_col))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.col(f"p.{ids_col}")).alias("ids"), F.transform("p", lambda p: F.size(p[ids_col])).alias("lengths"))


def check_crc(ids: list[int]) -> int:
    """crc32 of ids as unsigned little-endian 32-bit integers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
