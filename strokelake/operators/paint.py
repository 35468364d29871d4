"""Pixels of brushes, by whole arrays: a task works on many brushes at once and on a bounded number of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokelake.functions import pixels
from strokelake.functions.shared import spread

#: Pixels to work on at once.
PIXELS = 1 << 17

_NUMBERS = ("a", "b", "c", "d", "e", "f", "x", "width")


def _floats(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


class _Gradients:
    """Colours of linear gradients at the centres of an image's pixels, out of batches of brushes."""

    def __init__(self, keys: list[str], width: int, height: int):
        self.keys, self.width, self.height = keys, width, height

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = max(1, min(self.height, PIXELS // self.width))
        brushes = max(1, PIXELS // (self.width * lines))
        for batch in batches:
            for at in range(0, batch.num_rows, brushes):
                for y in range(0, self.height, lines):
                    yield self.paint(batch.slice(at, brushes), y, min(self.height, y + lines))

    def stops(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Places and colours of the stops of each brush, filled up behind with stops that no parameter reaches."""
        counts = np.asarray(column.value_lengths().fill_null(0))
        n, flat = len(counts), column.flatten()
        row = np.repeat(np.arange(n), counts)
        col = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        at, colors = np.full((n, int(counts.max(initial=0)) + 1), np.inf), np.zeros((3, n, int(counts.max(initial=0)) + 1))
        at[row, col] = _floats(flat.field("at"))
        for k, c in enumerate("rgb"):
            colors[k, row, col] = _floats(flat.field(c))
        return at, colors

    def paint(self, brushes: pa.RecordBatch, top: int, end: int) -> pa.RecordBatch:
        n, each = brushes.num_rows, (end - top) * self.width
        a, b, c, d, e, f, left, wide = (_floats(brushes.column(k))[:, None] for k in _NUMBERS)
        places = np.arange(top * self.width, end * self.width)
        x, y = (places % self.width)[None], (places // self.width)[None]
        mode = np.asarray(brushes.column("mode").cast(pa.int64()).fill_null(-1))[:, None]
        with np.errstate(all="ignore"):
            det = a * d - b * c
            t = ((x + 0.5) * (d / det) + (y + 0.5) * (-c / det) + -(e * (d / det) + f * (-c / det))) / wide - left / wide
            turn = t - 2 * np.floor(t / 2)
            t = np.where(mode == pixels.CLAMP, np.clip(t, 0.0, 1.0), np.where((mode == pixels.FLIP_X) | (mode == pixels.FLIP_XY), np.where(turn > 1, 2 - turn, turn), t - np.floor(t)))
            at, colors = self.stops(brushes.column("stops"))
            passed = np.zeros((n, each), np.int64)
            for k in range(at.shape[1]):
                passed += at[:, k : k + 1] <= t
            low, row = np.maximum(passed - 1, 0), np.arange(n)[:, None]
            high = np.where(np.isinf(at[row, np.minimum(passed, at.shape[1] - 1)]), low, passed)
            from_, to = at[row, low], at[row, high]
            part = np.where(to > from_, (t - from_) / (to - from_), 0.0)
            none = ((det == 0) | (wide == 0) | np.isnan(t) | (passed == 0)).ravel()
            made = [np.floor(v[row, low] + (v[row, high] - v[row, low]) * part + 0.5).ravel() for v in colors]
        rows = pa.array(np.repeat(np.arange(n), each))
        out = [brushes.column(k).take(rows) for k in self.keys] + [pa.array(np.broadcast_to(v, (n, each)).ravel().astype("int32")) for v in (x, y)]
        out += [pa.array(np.where(none, 0, v).astype("int32"), mask=none) for v in made]
        return pa.RecordBatch.from_arrays(out, names=[*self.keys, "px", "py", "r", "g", "b"])


def linear_gradients(brushes: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """``keys, px, py, r, g, b``: what each brush paints on each pixel of an image, taken at the pixel's centre.

    ``brushes`` have the columns of ``pixels.gradient_parameter`` (``x, width, a`` to ``f``), ``mode`` as for ``pixels.wrapped``
    and ``stops`` as for ``pixels.gradient_color``, and colours are those of these three; null where a brush paints nothing.
    Brushes are dealt out as they are, their pixels are made inside tasks.
    """
    kinds = ", ".join(f"{k} {brushes.schema[k].dataType.simpleString()}" for k in keys)
    numbers = [F.col(c).cast("double").alias(c) for c in _NUMBERS]
    dealt = spread(brushes, *keys).select(*keys, *numbers, "mode", "stops")
    return dealt.mapInArrow(_Gradients(keys, width, height).run, f"{kinds}, px int, py int, r int, g int, b int")
