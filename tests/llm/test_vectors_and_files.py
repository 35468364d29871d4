"""Hard negatives, clusters and token files against brute force, plain round trips and the mapped files themselves."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strokelake.llm import clusters, common, negatives, token_files

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, _id string, cluster string, _vector string, _label string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "v", "w") for r in rows], SCHEMA).repartition(3)


def numbers(vector, scale):
    return [int(np.floor(scale * float(np.float32(x)))) for x in vector]


def made(n, dims=8, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = [[i, int(rng.integers(labels)), [float(x) for x in rng.normal(size=dims).astype("f4")]] for i in range(n)]
    for i in range(0, n, 6):  # copies, near copies and zero vectors make ties
        rows[i][2] = list(rows[1][2])
    for i in range(5, n, 31):
        rows[i][2] = [0.0] * dims
    return [tuple(r) for r in rows]


AWKWARD = [
    (1001, None, [0.5] * 8), (1002, 1, None), (1003, 1, [0.5] * 7 + [None]), (1004, 1, [0.5] * 7 + [float("nan")]), (1005, 1, [0.5] * 7 + [float("inf")]),
    (None, 1, [0.5] * 8), (1006, 1, [3e38] * 8), (1000, 2, []), (1007, 2, []), (1010, 3, []), (1100, 2, [1.0, 2.0, 3.0]), (1101, 2, [1.0, 2.0, 2.0]), (1102, 0, [1.0, 1.0, 1.5]),
]


def brute_negatives(rows, every, s):
    """Plain loops; the last rows of AWKWARD that can't take part are left out by the same words as the docstring's."""
    ok = [(i, label, numbers(v, s.scale)) for i, label, v in rows if None not in (i, label, v) and None not in v and all(np.isfinite(v)) and all(abs(x) < 1e6 for x in v)]
    out = []
    for a, la, va in ok:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in ok if i != a and len(v) == len(va))
        for p, pid, _ in [r for r in scored if r[2] == la][: s.positives]:
            window = [(n, i) for n, i, label in scored if label != la and s.low * -p <= 100 * -n <= s.high * -p]
            out += [(a, pid, k + 1, i, -p, -n) for k, (n, i) in enumerate(window[: s.negatives])]
    return sorted(out)


@pytest.mark.parametrize("settings", [negatives.Settings(codes=4, sample=50), negatives.Settings(codes=4, sample=50, anchor_block=7, row_block=40, positives=3, negatives=2), negatives.Settings(low=10, high=100)])
def test_hard_negatives_equal_brute_force(spark, settings):
    rows = made(300) + AWKWARD
    from pyspark.sql import functions as F

    got = negatives.mine_negatives(frame(spark, rows), F.expr("vec_id % 10 = 0"), settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(map(tuple, got.collect()))
    assert found == brute_negatives(rows, 10, settings) and len(found) > 150
    assert {1000, 1100} <= {r[0] for r in found}  # rows without components score 0, those of three meet one another


def test_hard_negatives_of_large_numbers_and_few_rows(spark):
    from pyspark.sql import functions as F

    rows = [(i, i % 2, [float(np.float32(x)) for x in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(60, 3)) * 2e5)]
    s = negatives.Settings(codes=2)
    assert sorted(map(tuple, negatives.mine_negatives(frame(spark, rows), F.expr("vec_id % 5 = 0"), s).collect())) == brute_negatives(rows, 5, s)
    assert negatives.mine_negatives(frame(spark, []), F.expr("vec_id % 5 = 0")).count() == 0
    assert negatives.mine_negatives(frame(spark, rows), F.expr("vec_id < 0")).count() == 0
    repeated = rows[:20] * 2 + [(7, 9, rows[7][2])]  # an id names one row, the least by label
    assert sorted(map(tuple, negatives.mine_negatives(frame(spark, repeated), F.expr("vec_id % 5 = 0"), s).collect())) == brute_negatives(rows[:20], 5, s)


def test_intervals_hold_and_leave_rows_out():
    """The interval of each score holds the true one, and far fewer rows than all are scored again."""
    s = negatives.Settings()
    rng = np.random.default_rng(1)
    x = np.floor(256 * (rng.normal(size=(4000, 64)) / 8)).astype(np.int64)
    books = negatives.fit_codebooks(x[:2000].tolist(), s)
    batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(4000)), "_label": pa.array(rng.integers(0, 10, 4000)), "_vector": pa.array(x.tolist(), pa.list_(pa.int32())), "_windows": pa.array([[]] * 4000, pa.list_(pa.null()))})
    codes = np.stack([negatives._code(negatives._pieces(x)[:, m].astype(float), books[64][m].astype(float)) for m in range(32)], 1)
    left = negatives._pieces(x) - np.stack([books[64][m][codes[:, m]] for m in range(32)], 1)
    full = pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.astype(np.uint8).tobytes() for c in codes]), pa.array(np.sqrt((left.astype(float) ** 2).sum((1, 2))))], names=[*batch.schema.names, "_codes", "_residual"])
    anchors, rows = negatives.Anchors([batch.slice(0, 40)], 64, books[64]), negatives.Rows(full, 64)
    low, high = negatives._bounds(anchors.tables(0, 40), rows, slice(0, 4000), anchors.norms)
    true = rows.vectors @ anchors.vectors.T
    assert (low <= true).all() and (true <= high).all()
    assert (high - low).mean() < 2.5 * true.std()
    need = np.partition(low, -5, axis=0)[-5]
    assert (high >= need).mean() < 0.1


def brute_clusters(rows, k, rounds, dims, scale):
    kept = [(i, numbers(v, scale)) for i, _, v in rows if v is not None and len(v) == dims and None not in v and all(np.isfinite(v)) and all(abs(x) < 1e5 for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = lambda c: sum(d for _, n, d in found if c in (n, None))
    return sorted(((str(i), n, d, total(n), total(None), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found))


@pytest.mark.parametrize("k, rounds", [(16, 3), (5, 0), (3, 6), (500, 2)])
def test_clusters_equal_brute_force(spark, k, rounds):
    rows = made(150) + made(20, seed=3) + AWKWARD + [(None, 1, [0.25] * 8)]
    got = clusters.cluster_vectors(frame(spark, rows), k, rounds, dims=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_clusters(rows, k, rounds, 8, 64)


def test_clusters_of_no_rows(spark):
    got = clusters.cluster_vectors(frame(spark, []), dims=8)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_scan_looks_at_few_centroids_and_is_exact():
    rng = np.random.default_rng(2)
    centroids = (rng.normal(size=(64, 16)) * 400).astype(np.int64)
    centroids[7] = centroids[3]  # a tie goes to the smaller number
    x = centroids[rng.integers(0, 64, 5000)] + (rng.normal(size=(5000, 16)) * 30).astype(np.int64)
    true = ((x[:, None] - centroids[None]) ** 2).sum(2)
    number, distance, _ = clusters.nearest(x, np.zeros(5000, np.int64), centroids)
    assert (number == true.argmin(1)).all() and (distance == true.min(1)).all() and 7 not in number
    again, _, looked = clusters.nearest(x, number, centroids)
    assert (again == number).all() and looked < 2 * 5000


TEXTS = [None, "", "one", "Two words, <|endoftext|> and 3.5 more!", "x " * 5000, "日本語 café É", "one", "the old mill " * 700]


@pytest.mark.parametrize("length, shard_bytes", [(16, 1 << 10), (2048, 1 << 28)])
def test_token_files_round_trip(spark, tmp_path, length, shard_bytes):
    from tokenizers import Tokenizer

    path = common.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(3 * i - 5, t, "n") for i, t in enumerate(TEXTS * 9)] + [(4, "again the same id", "n"), (4, "again the same id", "n"), (None, "no id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = str(tmp_path / "files")
    shards = token_files.write_token_files(docs, path, folder, 1, length, shard_bytes)
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 1] for _, t, _ in rows}
    expected, at = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, np.array(ids[r[1]], "<u2").tobytes())):
        expected.append((i, at, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()), ids[t]))
        at += len(ids[t])
    got = sorted(map(tuple, token_files.read_token_files(shards, folder, with_ids=True).collect()), key=lambda r: r[1])
    assert got == expected
    for r in shards.collect():
        file = token_files.TokenFile(folder, r.shard)
        n = -(-r.n_ids // length)
        sequences = [file.sequence(i) for i in range(n)]
        masks = [np.array(file.mask(i)) for i in range(n)]
        assert {len(s) for s in sequences} | {len(m) for m in masks} <= {length} and sum(m.sum() for m in masks) == r.n_ids
        run = np.concatenate(sequences)[np.concatenate(masks)]
        assert run.tolist() == [x for e in expected if r.base <= e[1] < r.base + r.n_ids for x in e[4]]
        one = file.sequence(n - 1)  # a view of the mapped file, not a copy
        assert not one.flags.owndata and not one.flags.writeable and file.batch((n - 1) // token_files.BATCH).ctypes.data <= one.ctypes.data


def test_token_files_of_no_rows_and_of_one_id(spark, tmp_path):
    path = common.vocabulary("word_bpe_49k.json")
    none = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path, str(tmp_path / "a"))
    assert none.count() == 0 and token_files.read_token_files(none, str(tmp_path / "a")).count() == 0
    hot = spark.createDataFrame([(7, f"text {i % 3}") for i in range(300)] + [(i, "other") for i in range(20)], "doc_id long, text string").repartition(6)
    shards = token_files.write_token_files(hot, path, str(tmp_path / "b"), shard_bytes=100)
    got = token_files.read_token_files(shards, str(tmp_path / "b")).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([7] * 300 + list(range(20))) and shards.count() > 5
    assert shards.agg({"n_docs": "max"}).first()[0] < 150  # the hot id fills several shards
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
