"""Hard negatives by product quantisation with stored residual norms.

Every row is indexed: the codes of its pieces and the norm of what they leave out. An anchor's lookup tables give the score
with the quantised row; the true score is within the anchor's norm times the residual's of it. So a row is left out only if
that interval can't reach a window's best; whatever may is scored again in whole numbers, and the windows are exact.

Anchors and rows are each dealt into blocks. A cell is a block of anchors with a block of rows; its rows stream past the
anchors, which with their best rows are all that a task holds. Each cell sends the best of its rows on, to be merged by anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .vectors import integer_vectors, matrix


@dataclass(frozen=True)
class Settings:
    """A window holds the scores from ``low`` to ``high`` percent of a positive's score."""

    scale: int = 256
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    #: Rows from which codebooks are fitted, those of the smallest hashed ids; every row is indexed with them.
    sample: int = 4096
    #: Codes of a subspace of two components.
    codes: int = 256
    rounds: int = 6
    #: Anchors and rows of a cell, about.
    anchor_block: int = 4096
    row_block: int = 1 << 18


#: Components of a subspace; rows and anchors that are scored at once inside a task.
WIDTH, ROWS, ANCHORS = 2, 2048, 128

LEAST = np.iinfo(np.int64).min


def _pieces(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, WIDTH), with a zero behind an odd component."""
    n, d = x.shape
    return np.pad(x, ((0, 0), (0, -d % WIDTH))).reshape(n, (d + WIDTH - 1) // WIDTH, WIDTH)


def _code(part: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * (part @ book.T), axis=1)


def fit_codebooks(vectors: list[list[int]], settings: Settings) -> dict[int, np.ndarray]:
    """For each length of vectors, (subspaces, codes, WIDTH) whole numbers, by k-means from evenly spaced rows of the sample."""
    out = {}
    for d in {len(v) for v in vectors}:
        own = [v for v in vectors if len(v) == d]
        parts = _pieces(np.array(own, np.float64).reshape(len(own), d))
        books = np.zeros((parts.shape[1], settings.codes, WIDTH))
        for m in range(parts.shape[1]):
            part = parts[:, m]
            distinct = np.unique(part, axis=0)
            book = distinct[np.linspace(0, len(distinct) - 1, settings.codes).astype(int)]
            for _ in range(settings.rounds):
                code = _code(part, book)
                n = np.bincount(code, minlength=settings.codes)
                sums = np.stack([np.bincount(code, part[:, i], settings.codes) for i in range(WIDTH)], 1)
                book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
            books[m] = book
        out[d] = np.rint(books).astype(np.int64)
    return out


def index_rows(rows: DataFrame, books: dict[int, np.ndarray], settings: Settings) -> DataFrame:
    """The rows with ``_codes`` and ``_residual``, the norm of what the codes leave out; lengths without a codebook are all residual."""

    def encode(batches):
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("_vector")).to_numpy(zero_copy_only=False)
            codes, residual = np.empty(len(sizes), object), np.zeros(len(sizes))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = _pieces(matrix(batch.column("_vector").take(pa.array(at)), d).astype(np.int64))
                book = books.get(d, np.zeros((x.shape[1], 1, WIDTH), np.int64))
                found = np.stack([_code(x[:, m].astype(np.float64), book[m].astype(np.float64)) for m in range(x.shape[1])], 1) if d else np.zeros((len(at), 0))
                left = x - np.stack([book[m][found[:, m]] for m in range(x.shape[1])], 1) if d else x
                residual[at] = np.sqrt((left.astype(np.float64) ** 2).sum((1, 2)))
                raw = found.astype(np.uint8)
                codes[at] = [r.tobytes() for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(residual)], names=[*batch.schema.names, "_codes", "_residual"])

    return rows.mapInArrow(encode, T.StructType([*rows.schema.fields, T.StructField("_codes", T.BinaryType()), T.StructField("_residual", T.DoubleType())]))


class Anchors:
    """A block of anchors of one length, in the order of their labels."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, book: np.ndarray):
        table = pa.Table.from_batches(batches).combine_chunks()
        order = np.argsort(table["_label"].to_numpy(), kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        self.ids, self.labels = table["_id"].to_numpy(), table["_label"].to_numpy()
        self.vectors = matrix(table["_vector"].chunk(0), dims).astype(np.int64)
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))
        self.windows = table["_windows"].to_pylist()
        self.book, self.reach = book, np.abs(book).max(initial=0)

    def tables(self, a: int, b: int) -> np.ndarray:
        """(subspaces, codes, anchors): what each code adds to the scores of the anchors a to b."""
        parts = _pieces(self.vectors[a:b])
        exact = np.einsum("mks,ams->mka", self.book, parts)
        small = self.vectors.shape[1] * float(self.reach) * float(np.abs(parts).max(initial=0)) < 2**31
        return np.ascontiguousarray(exact.astype(np.int32 if small else np.float64))


class Rows:
    """Rows of a batch as they are scored."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        self.ids, self.labels = batch.column("_id").to_numpy(), batch.column("_label").to_numpy()
        self.vectors = matrix(batch.column("_vector"), dims).astype(np.int64)
        width = (dims + WIDTH - 1) // WIDTH
        self.codes = np.frombuffer(b"".join(batch.column("_codes").to_pylist()), np.uint8).reshape(len(self.ids), width)
        residual = batch.column("_residual").to_numpy()
        # Sums of doubles err by far less than this share of what is summed.
        self.slack = residual + 1e-11 * (residual + np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1)))


def _bounds(tables: np.ndarray, rows: Rows, at: np.ndarray | slice, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest scores that the rows can have with the anchors, as (rows, anchors)."""
    codes = rows.codes[at]
    score = np.zeros((len(codes), len(norms)), tables.dtype)
    for m in range(len(tables)):
        score += tables[m].take(codes[:, m], axis=0)
    off = rows.slack[at][:, None] * norms[None] + 1
    return score - off, score + off


def _exact(rows: Rows, i: np.ndarray, anchors: Anchors, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        s = slice(k, k + (1 << 15))
        out[s] = np.einsum("nd,nd->n", rows.vectors[i[s]], anchors.vectors[j[s]])
    return out


class Best:
    """For each of some lists, the rows of the highest scores, ties by the smaller id."""

    def __init__(self, lists: int, most: int):
        self.scores, self.ids, self.n = np.full((lists, most), LEAST), np.zeros((lists, most), np.int64), np.zeros(lists, np.int64)

    def last(self) -> np.ndarray:
        """What a score must reach to enter each list."""
        return self.scores[:, -1]

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        most, touched = self.scores.shape[1], np.unique(lists)
        held = np.repeat(touched, self.n[touched])
        taken = np.arange(most)[None] < self.n[touched][:, None]
        lists = np.concatenate([lists, held])
        scores, ids = np.concatenate([scores, self.scores[touched][taken]]), np.concatenate([ids, self.ids[touched][taken]])
        order = np.lexsort((ids, -scores, lists))
        lists, scores, ids = lists[order], scores[order], ids[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        keep = place < most
        self.scores[lists[keep], place[keep]], self.ids[lists[keep], place[keep]] = scores[keep], ids[keep]
        np.maximum.at(self.n, lists[keep], place[keep] + 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        taken = np.arange(self.scores.shape[1])[None] < self.n[:, None]
        return np.nonzero(taken)[0], self.ids[taken], self.scores[taken]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column, or minus infinity."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -np.inf)


class Positives:
    """The first rows of each anchor's own label."""

    def __init__(self, anchors: Anchors, settings: Settings):
        self.anchors, self.k = anchors, settings.positives
        self.best = Best(len(anchors.ids), self.k)

    def see(self, rows: Rows) -> None:
        anchors = self.anchors
        for a in range(0, len(anchors.ids), ANCHORS):
            tables = anchors.tables(a, a + ANCHORS)
            for label in np.unique(anchors.labels[a : a + ANCHORS]).tolist():
                mine = np.flatnonzero(anchors.labels[a : a + ANCHORS] == label)
                at = np.flatnonzero(rows.labels == label)
                for r in range(0, len(at), ROWS):
                    part = at[r : r + ROWS]
                    low, high = _bounds(np.ascontiguousarray(tables[:, :, mine]), rows, part, anchors.norms[a + mine])
                    itself = rows.ids[part][:, None] == anchors.ids[a + mine][None]
                    low[itself] = high[itself] = -np.inf
                    need = np.maximum(_kth(low, self.k), self.best.last()[a + mine])
                    i, j = np.nonzero((high >= need[None]) & ~itself)
                    i, j = part[i], a + mine[j]
                    self.best.add(j, _exact(rows, i, anchors, j), rows.ids[i])

    def found(self) -> list[pa.Array]:
        lists, ids, scores = self.best.rows()
        return [pa.array(self.anchors.ids[lists]), pa.array(ids), pa.array(scores)]


class Negatives:
    """The first rows of other labels in each window of an anchor."""

    def __init__(self, anchors: Anchors, settings: Settings):
        self.anchors, self.k = anchors, settings.negatives
        self.windows = [(j, p["id"], p["score"], -(-settings.low * p["score"] // 100), settings.high * p["score"] // 100) for j, w in enumerate(anchors.windows) for p in w]
        self.of = np.full((len(anchors.ids), settings.positives), -1)
        for n, (j, *_) in enumerate(self.windows):
            self.of[j, np.argmin(self.of[j])] = n
        self.low, self.high = (np.array([w[c] for w in self.windows], np.int64) for c in (3, 4))
        self.best = Best(len(self.windows), self.k)

    def see(self, rows: Rows) -> None:
        anchors = self.anchors
        for a in range(0, len(anchors.ids), ANCHORS):
            tables, norms = anchors.tables(a, a + ANCHORS), anchors.norms[a : a + ANCHORS]
            for r in range(0, len(rows.ids), ROWS):
                part = slice(r, min(r + ROWS, len(rows.ids)))
                low, high = _bounds(tables, rows, part, norms)
                same = rows.labels[part][:, None] == anchors.labels[a : a + ANCHORS][None]
                high[same] = -np.inf  # never reaches a window
                wanted = np.zeros(low.shape, bool)
                each = []
                for of in self.of[a : a + ANCHORS].T:
                    there = np.flatnonzero(of >= 0)
                    w = of[there]
                    if not len(w):
                        continue
                    lo, hi = self.low[w], self.high[w]
                    inside = (low[:, there] >= lo) & (high[:, there] <= hi) & ~same[:, there]
                    need = np.maximum(np.maximum(_kth(np.where(inside, low[:, there], -np.inf), self.k), self.best.last()[w]), lo)
                    may = (low[:, there] <= hi) & (high[:, there] >= need)
                    wanted[:, there] |= may
                    each.append((there, w, may))
                i, j = np.nonzero(wanted)
                score = np.zeros(low.shape, np.int64)
                score[i, j] = _exact(rows, r + i, anchors, a + j)
                for there, w, may in each:
                    i, j = np.nonzero(may)
                    s = score[i, there[j]]
                    ok = (s >= self.low[w[j]]) & (s <= self.high[w[j]])
                    self.best.add(w[j[ok]], s[ok], rows.ids[r + i[ok]])

    def found(self) -> list[pa.Array]:
        lists, ids, scores = self.best.rows()
        w = [self.windows[n] for n in lists.tolist()]
        return [pa.array([self.anchors.ids[x[0]] for x in w], pa.int64()), pa.array([x[1] for x in w], pa.int64()), pa.array([x[2] for x in w], pa.int64()), pa.array(ids), pa.array(scores)]


def _search(anchors: DataFrame, index: DataFrame, books: dict[int, np.ndarray], n_anchors: int, n_rows: int, kind: type, columns: str, settings: Settings) -> DataFrame:
    """What ``kind`` finds in each cell. Each row meets each block of anchors once, and each anchor each block of rows."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    qs = max(1, -(-n_anchors // settings.anchor_block))
    rs = max(-(-n_rows // settings.row_block), -(-tasks // qs))
    own = lambda n: F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    window = "array<struct<id: bigint, score: bigint>>"
    sides = [
        anchors.select(F.lit(0).alias("_side"), each(rs).alias("_r"), own(qs).alias("_q"), "_id", "_label", "_vector", F.lit(None).cast("binary").alias("_codes"), F.lit(None).cast("double").alias("_residual"), F.col("_windows").cast(window)),
        index.select(F.lit(1).alias("_side"), own(rs).alias("_r"), each(qs).alias("_q"), "_id", "_label", "_vector", "_codes", "_residual", F.lit(None).cast(window).alias("_windows")),
    ]
    cells = sides[0].unionByName(sides[1]).withColumns({"_cell": F.col("_q").cast("long") * rs + F.col("_r"), "_dims": F.size("_vector")}).drop("_q", "_r")
    parts = min(qs * rs, max(tasks, 10_000))
    dealt = cells.repartitionById(parts, F.pmod("_cell", F.lit(parts)).cast("int")).sortWithinPartitions("_cell", "_dims", "_side")
    names = [c.split()[0] for c in columns.split(", ")]

    def stream(batches):
        cell, waiting, search = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_cell", "_dims", "_side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now, side, rows = tuple(keys[a, :2].tolist()), keys[a, 2], batch.slice(a, b - a)
                if now != cell:
                    if search:
                        yield pa.RecordBatch.from_arrays(search.found(), names=names)
                    cell, waiting, search = now, [], None
                if side == 0:
                    waiting.append(rows)
                elif waiting or search:
                    if waiting:
                        book = books.get(now[1], np.zeros(((now[1] + WIDTH - 1) // WIDTH, 1, WIDTH), np.int64))
                        search, waiting = kind(Anchors(waiting, now[1], book), settings), []
                    search.see(Rows(rows, now[1]))
        if search:
            yield pa.RecordBatch.from_arrays(search.found(), names=names)

    return dealt.mapInArrow(stream, columns)


def mine_negatives(rows: DataFrame, anchors: Column, settings: Settings = Settings(), id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that satisfy ``anchors``.

    A score is the inner product of the numbers floor(scale * x), ties go to the smaller id. An anchor's positives are the first
    ``positives`` other rows of its label; a positive's negatives are the first ``negatives`` rows of other labels within its
    window, ranked from 1. A window without such a row gives none; neither does a positive with a score under 0.

    Rows with a null id, label or vector, with a null or non-finite component, or with one so large that a score
    might pass a long take no part. Rows meet rows of as many components. An id names one row: of rows that repeat it, the least by
    label, then by vector, counts. An empty table gives an empty result; other columns are not read, so clashing names do no harm.
    """
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    vectors = integer_vectors(kept, id_col, vector_col, settings.scale, F.lit(float(1 << 61)) / F.greatest(F.size(vector_col), F.lit(1)), F.col(label_col).cast("long").alias("_label"), anchors.alias("_anchor"))
    vectors = vectors.withColumn("_id", F.col("_id").cast("long")).groupBy("_id").agg(F.min(F.struct("_label", "_vector", "_anchor")).alias("_row")).select("_id", "_row.*")
    vectors = common.checkpoint(vectors)
    sample = vectors.orderBy(F.xxhash64("_id"), "_id").limit(settings.sample).select("_vector").collect()
    books = fit_codebooks([r[0] for r in sample], settings)
    index = common.checkpoint(index_rows(vectors.select("_id", "_label", "_vector", F.coalesce("_anchor", F.lit(False)).alias("_anchor")), books, settings))
    n_rows, n_anchors = index.agg(F.count(F.lit(1)), F.count_if("_anchor")).first()
    seeds = index.filter("_anchor").select("_id", "_label", "_vector")
    near = _search(seeds.withColumn("_windows", F.lit(None)), index, books, n_anchors, n_rows, Positives, "anchor bigint, id bigint, score bigint", settings)
    near = near.withColumn("_k", F.expr("row_number() over (partition by anchor order by score desc, id)")).filter(F.col("_k") <= settings.positives)
    windows = near.groupBy(F.col("anchor").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("id", "score"))).alias("_windows"))  # a few each
    found = _search(common.checkpoint(seeds.join(windows, "_id")), index, books, n_anchors, n_rows, Negatives, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint", settings)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id)")).filter(F.col("rank") <= settings.negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
