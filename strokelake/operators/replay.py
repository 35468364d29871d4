"""State of files of bounded size: records are shuffled once, sorted, and stepped through one after the other inside tasks.

A task streams past its sorted records and holds the state of one file. Files of more records than ``SHORT_BLOCKS`` blocks would make a task too
long; they go to the segmented scans, which spread a file over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strokelake.functions.shared import spread

from .batches import beginnings

#: Blocks of a file that one task steps through.
SHORT_BLOCKS = 512


class _Files:
    """Runs a machine over sorted batches: it begins anew with each file, and rows for which it returns None are left out."""

    def __init__(self, machine, width: int, keys: list[int], added: pa.Schema, names: list[str]):
        self.machine, self.width, self.keys, self.added, self.names = machine, width, keys, added, names

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = None, self.machine.step
        for batch in batches:
            if not batch.num_rows:
                continue
            places = [str(k) for k in range(len(self.keys))]
            keys = pa.Table.from_arrays([pa.chunked_array([batch.column(k)]) for k in self.keys], names=places)
            first = beginnings(keys, places)
            begins = keys.slice(0, 1).to_pylist()[0]
            first[0] = last is None or begins != last
            last = keys.slice(keys.num_rows - 1, 1).to_pylist()[0]
            made = []
            for new, *values in zip(first.tolist(), *[batch.column(k).to_pylist() for k in range(self.width, batch.num_columns)]):
                if new:
                    self.machine.begin()
                made.append(step(*values))
            kept = [m for m in made if m is not None]
            whole = batch.select(list(range(self.width)))
            if len(kept) < len(made):
                whole = whole.filter(pa.array(np.array([m is not None for m in made])))
            columns = zip(*kept) if kept else [()] * len(self.added)
            yield pa.RecordBatch.from_arrays([*whole.columns, *[pa.array(c, f.type) for c, f in zip(columns, self.added)]], names=self.names)


def by_length(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of files of up to ``most`` records, and those of longer ones, or None if there are none. Null keys are a file like any other."""
    key = F.struct(*keys)
    large = rows.groupBy(key.alias("_file")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_file")
    if large.isEmpty():
        return rows, None
    named = rows.withColumn("_file", key)
    few, many = (named.join(large, "_file", how).select(*rows.columns) for how in ("left_anti", "left_semi"))
    return few, many


def replay(rows: DataFrame, keys: list[str], position: str, machine, inputs: list[Column], added: StructType, long: Callable[[DataFrame], DataFrame] | None = None, most: int = 0) -> DataFrame:
    """``rows`` with the columns that a machine adds: ``begin()`` starts a file, ``step(*inputs)`` gives a record's values, or None to leave it out.

    Files of more than ``most`` records are given to ``long``, if there is one; it must return the same columns. Null keys are a file like any other.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    at = [rows.columns.index(k) for k in keys]
    kind = StructType([*rows.schema.fields, *added.fields])
    files = _Files(machine, len(rows.columns), at, to_arrow_schema(added), kind.names)

    def short(part: DataFrame) -> DataFrame:
        ordered = spread(part, *keys).sortWithinPartitions(*keys, position)
        return ordered.select("*", *[c.alias(f"_input_{k}") for k, c in enumerate(inputs)]).mapInArrow(files.run, kind)

    if long is None:
        return short(rows)
    few, many = by_length(rows, keys, most)
    return short(few) if many is None else short(few).unionByName(long(many).select(*kind.names))
