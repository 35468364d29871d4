"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A text is a bag of hashed terms: its words, the shapes of its words, and immediate repetitions. The weighted terms of a bounded
sample of labelled texts are decomposed on the driver; the projection and the labelled vectors (of fixed size) are broadcast,
every document is projected, its exact cosines with all labelled vectors are computed block by block, and the nearest vote with
weights that grow with their similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, byte_slices

#: Hash buckets of word shapes and repetitions, and of all terms.
SHAPES, TERMS = 512, 4096


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled texts that the model is fitted on and the vectors that vote: 4096 x 64 floats are 1 MB.

    ``neighbours`` vote with the ``power`` of their cosine; texts are scored in blocks of ``block`` rows.
    """

    sample: int = 4096
    dimensions: int = 64
    neighbours: int = 15
    power: int = 8
    block: int = 512
    threshold: float = 0.3
    seed: int = 20240229


def _shape(word: str) -> str:
    """Runs of capitals, letters and digits as one sign each; marks as they are. Six signs at most."""
    out: list[str] = []
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
            if len(out) == 6:
                break
    return "".join(out)


class Terms:
    """Counts of hashed terms, one row a text."""

    def __init__(self):
        self.memo = TwoGenerations(300_000)

    @staticmethod
    def _code(word: bytes) -> int:
        text = word.decode()
        low = text.lower().encode()
        shape = zlib.crc32(_shape(text).encode()) % (SHAPES - 4) + 4
        return zlib.crc32(low, 1) >> 1 << 32 | (SHAPES + zlib.crc32(low) % (TERMS - SHAPES)) << 12 | shape

    def counts(self, texts: list[str]) -> np.ndarray:
        parts = [t.encode().split() for t in texts]
        new = self.memo.missing(set().union(*parts))
        self.memo.put(new, map(self._code, new))
        known = self.memo.young.__getitem__
        sizes = np.array([len(p) for p in parts])
        codes = np.fromiter((known(w) for p in parts for w in p), np.int64, int(sizes.sum()))
        self.memo.turn()
        row = np.repeat(np.arange(len(texts)), sizes)
        # Buckets 1 and 2 count words equal to the one before, and to the one before that.
        cells = [row * TERMS + (codes >> 12 & 0xFFF), row * TERMS + (codes & 0xFFF)]
        for gap in (1, 2):
            again = np.flatnonzero((codes[gap:] == codes[:-gap]) & (row[gap:] == row[:-gap])) if len(codes) > gap else np.zeros(0, np.int64)
            cells.append(row[again + gap] * TERMS + gap)
        return np.bincount(np.concatenate(cells), minlength=len(texts) * TERMS).reshape(len(texts), TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Square roots of relative counts by inverse document frequency; shapes count a little more than words."""
    x = np.sqrt(counts / np.maximum(counts[:, SHAPES:].sum(axis=1, keepdims=True), 1)) * idf
    return _unit(np.hstack([_unit(x[:, :SHAPES]), 0.6 * _unit(x[:, SHAPES:])]))


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    settings: Settings

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        s = self.settings
        cosines = _unit(_weigh(counts, self.idf) @ self.projection) @ self.vectors.T
        k = min(s.neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near_cosines = np.take_along_axis(cosines, near, 1)
        weight = np.maximum(near_cosines, 1e-3).astype(np.float64) ** s.power
        voted = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.where((counts.sum(axis=1) > 0) & (near_cosines.max(axis=1) > 1e-3), np.clip(voted, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most ``sample`` labelled rows whose crc32(id as text) mod 5 is not 0, those of the smallest hashed ids.

    Labels of one id are averaged; null ids and labels are left out. Without any label every score is 0.5.
    """
    spark = docs.sparkSession
    learn = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).filter(~held_out(F.col(id_col)))
    learn = learn.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(settings.sample)
    chosen = learn.collect()  # at most ``sample`` pairs of numbers
    if not chosen:
        return Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), 0.5, settings)
    table = spark.createDataFrame([(r["id"], r["label"]) for r in chosen], "id long, label double")

    def sparse(batches):
        terms = Terms()
        for batch in batches:
            counts = terms.counts([t or "" for t in batch.column(2).to_pylist()])
            rows = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.astype("<u2").tobytes() for r in rows]), pa.array([c[r].astype("<f4").tobytes() for c, r in zip(counts, rows)])], names=["id", "label", "at", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(table), "id").select("id", "label", "text")
    # At most ``sample`` rows of at most TERMS counts: the bound of what reaches the driver. Repeated ids count once.
    found = rows.mapInArrow(sparse, "id long, label double, at binary, n binary").dropDuplicates(["id"]).toPandas().sort_values("id", ignore_index=True)
    if not len(found):
        return Model(np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0), 0.5, settings)
    at, n = ([np.frombuffer(x, kind) for x in found[name]] for name, kind in (("at", "<u2"), ("n", "<f4")))
    idf = (np.log((1 + len(found)) / (1 + np.bincount(np.concatenate(at), minlength=TERMS))) + 1).astype(np.float32)

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        """Weighted rows, a few at a time: the counts stay sparse, and the driver never holds the whole matrix."""
        for a in range(0, len(found), settings.block):
            b = min(a + settings.block, len(found))
            counts = np.zeros((b - a, TERMS), np.float32)
            for k in range(a, b):
                counts[k - a, at[k]] = n[k]
            yield slice(a, b), _weigh(counts, idf)

    def forward(basis: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ basis for _, x in blocks()])

    def back(wide: np.ndarray) -> np.ndarray:
        return sum((x.T @ wide[rows] for rows, x in blocks()), np.zeros((TERMS, wide.shape[1]), np.float32))

    # Randomised truncated decomposition.
    wide = np.random.default_rng(settings.seed).standard_normal((len(found), settings.dimensions + 16)).astype(np.float32)
    for _ in range(3):
        basis, _ = np.linalg.qr(back(wide))
        wide, _ = np.linalg.qr(forward(basis))
    basis, _ = np.linalg.qr(back(wide))
    placed = forward(basis)
    _, _, turn = np.linalg.svd(placed, full_matrices=False)
    turn = turn.T[:, : settings.dimensions]
    projection = np.ascontiguousarray(basis @ turn, np.float32)
    label = found["label"].to_numpy(np.float64)
    return Model(idf, projection, _unit(placed @ turn), label, float(label.mean()), settings)


def held_out(id_column) -> F.Column:
    return F.crc32(id_column.cast("long").cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score`` for each row, from the text alone.

    Null and empty texts, and those with no neighbour at all, get the share of label 1 among the labelled; repeated rows each give a row; a null id stays; other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of a size that the settings fix

    def run(batches):
        terms, fitted = Terms(), shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in byte_slices(texts, 4 << 20):
                for c in range(a, b, fitted.settings.block):
                    part = texts[c : min(b, c + fitted.settings.block)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(c, len(part)), pa.array(fitted.scores(terms.counts(part)), pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of the rows whose text scores at least the threshold.

    Null and empty texts score as in ``score``; repeated rows and ties are judged alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        terms, fitted = Terms(), shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            keep = [fitted.scores(terms.counts(texts[a:b])) >= fitted.settings.threshold for a, b in byte_slices(texts, 4 << 20)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
