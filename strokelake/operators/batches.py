"""Whole groups out of sorted Arrow batches, so that a task works on many small groups at once and on a bounded number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows to work on at once; a larger group is taken whole unless it can be shortened.
ROWS = 100_000


def beginnings(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where another group begins, from rows sorted by their keys; null equals null."""
    n, new = rows.num_rows, np.zeros(rows.num_rows, bool)
    for k in keys:
        column = rows.column(k).combine_chunks()
        a, b = column.slice(0, n - 1), column.slice(1)
        either = pc.xor(pc.is_null(a), pc.is_null(b))
        new[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), either).to_numpy(zero_copy_only=False)
    new[:1] = True
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], shorter: Callable[[pa.Table], pa.Table] | None = None, rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of whole groups; ``shorter`` turns the rows of one group so far into fewer that mean the same."""
    held, count, limit = [], 0, rows
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < limit:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(beginnings(table, keys))[-1])
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
        if not last and shorter is not None:
            rest = shorter(rest)
        held, count = rest.combine_chunks().to_batches(), rest.num_rows
        limit = max(rows, 2 * count)
    if count:
        yield pa.Table.from_batches(held)
