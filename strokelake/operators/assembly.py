"""Objects out of continued fragments, for files of bounded size: fragments are shuffled once, sorted, and put together inside tasks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import beginnings

#: What a fragment is, behind its keys.
FRAGMENT = ("position", "id", "type", "continued", "total", "data")


class Assembly:
    """Objects, or the first fault, of each file, from fragments ``keys, position, id, type, continued, total, data`` sorted by keys and position; none is null but keys.

    A task streams past its fragments. Where an object ends is looked up among the running sizes of the fragments that are alike, and only the
    object that is open is held from one batch to the next. For faults the data are sizes.
    """

    def __init__(self, keys: int, most: int, filling: int, faults: bool, schema: pa.Schema):
        self.keys, self.most, self.filling, self.faults, self.schema = keys, most, filling, faults, schema

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.open, self.wrong, last = None, False, None
        for batch in batches:
            if batch.num_rows:
                named = pa.Table.from_batches([batch.select(list(range(self.keys)))])
                # The last row before stands in front: it tells whether its file goes on, and names it if it ended.
                keys = named if last is None else pa.concat_tables([last, named])
                first = beginnings(keys, keys.column_names)[keys.num_rows - batch.num_rows :]
                yield self._named(keys, self._follow(batch, first, keys.num_rows - batch.num_rows))
                last = named.slice(batch.num_rows - 1)
        if self.open is not None and self.faults:
            yield self._named(last, [(0, self.open[0], "unfinished object")])

    def _named(self, keys: pa.Table, rows: list[tuple]) -> pa.RecordBatch:
        """Rows that begin with the place of their keys."""
        fields = list(self.schema)[self.keys :]
        at, *values = zip(*rows) if rows else [()] * (len(fields) + 1)
        taken = [c.combine_chunks().take(pa.array(at, pa.int64())) for c in keys.columns]
        return pa.RecordBatch.from_arrays([*taken, *[pa.array(v, f.type) for v, f in zip(values, fields)]], schema=self.schema)

    def _follow(self, batch: pa.RecordBatch, first: np.ndarray, shift: int) -> list[tuple]:
        n, out = batch.num_rows, []
        columns = dict(zip(FRAGMENT, batch.columns[self.keys :]))
        new = first.copy()
        for name in ("id", "type", "continued", "total"):
            c = columns[name]
            new[1:] |= pc.not_equal(c.slice(0, n - 1), c.slice(1)).to_numpy(zero_copy_only=False)
        new[0] = True
        starts = np.flatnonzero(new)
        until = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))).tolist()
        files = np.append(np.flatnonzero(first), n)
        position, number, kind, continued, total = (columns[name].to_pylist() for name in FRAGMENT[:5])
        if self.faults:
            ends, content = [0, *np.cumsum(columns["data"].to_numpy()).tolist()], None
        else:
            wide = columns["data"].cast(pa.large_binary())
            ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1].tolist()
            content = memoryview(wide.buffers()[2] or b"")
        first, i = first.tolist(), 0

        def found(last: int, begun: int, count: int, parts: list) -> None:
            if not self.faults:
                out.append((shift + last, begun, position[last], number[last], kind[last], count, b"".join(parts)))

        def fault(place: int, at: int, what: str) -> None:
            self.open, self.wrong = None, True
            if self.faults:
                out.append((shift + at, place, what))

        while i < n:
            if first[i]:
                if self.open is not None:
                    fault(self.open[0], i - 1, "unfinished object")
                self.wrong, first[i] = False, False
            if self.wrong:
                i = int(files[np.searchsorted(files, i, "right")])
                continue
            size = ends[i + 1] - ends[i]
            if not (0 <= number[i] <= 63 and 1 <= kind[i] <= 9):
                fault(position[i], i, "identity")
                continue
            if self.open is None and not continued[i]:
                if size == 0 or size > self.most:
                    fault(position[i], i, "object bytes" if size else "empty object")
                    continue
                found(i, position[i], 1, [] if self.faults else [content[ends[i] : ends[i + 1]]])
                i += 1
                continue
            if self.open is None:
                if total[i] == 0 or total[i] > self.most:
                    fault(position[i], i, "object bytes" if total[i] else "total size")
                    continue
                self.open = [position[i], number[i], kind[i], total[i], 0, 0, []]
            begun, *alike, whole, got, count, parts = self.open
            if [number[i], kind[i]] != alike or (continued[i] and total[i] != whole):
                fault(position[i], i, "inconsistent continuation")
                continue
            # The first fragment up to which the bytes reach the total, if there is one among those that are alike.
            j = min(bisect_left(ends, ends[i] + whole - got, i + 1, until[i] + 1), until[i]) if continued[i] else i + 1
            got, count = got + ends[j] - ends[i], count + j - i
            if got > whole + self.filling or (got < whole and not continued[i]):
                fault(position[j - 1], j - 1, "continuation length")
                continue
            if not self.faults and ends[j] > ends[i]:
                parts.append(content[ends[i] : ends[j] - max(0, got - whole)])
            if got < whole:
                self.open[4:6] = got, count
            else:
                found(j - 1, begun, count, parts)
                self.open = None
            i = j
        if self.open is not None:
            # What is held on is copied, not to keep the batch.
            self.open[6] = [b"".join(self.open[6])]
        return out
