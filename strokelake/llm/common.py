"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]"

#: Default folder of the public vocabulary files; every operator takes the path as a parameter.
TOKENIZERS = "/opt/tokenizers"


def vocabulary(name: str, folder: str = TOKENIZERS) -> str:
    """Path of a public tokenizer file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{folder}/{name}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's shared folder; where none is configured a local one is made, but only on a local master (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that the caller wrote, on whatever file system it stands."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cuts lineage reliably: the rows go to the shared checkpoint folder, so a lost executor costs nothing."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Up to so many bytes a side is broadcast; beyond that it is joined by shuffles.
BROADCAST_BYTES = 32 << 20


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About what a value takes in a row."""
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.ArrayType):
        return 16 + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    return F.lit(8)


def maybe_broadcast(frame: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if all its rows together take few enough bytes. It should be cheap to read, e.g. checkpointed."""
    total = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in frame.schema.fields), F.lit(32))
    return F.broadcast(frame) if (frame.agg(F.sum(total.cast("long"))).first()[0] or 0) <= most else frame


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns named c0, c1 and so on, which no internal name meets, and the new name of each column."""
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def renamed(rows: DataFrame, names: dict[str, str], results: dict[str, str]) -> DataFrame:
    """The columns under their own names again, and behind them the results (name, internal name), which replace columns of their names."""
    taken = {r.lower() for r in results}
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in taken], *[F.col(n).alias(r) for r, n in results.items()])


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


class TwoGenerations:
    """A bounded memo for one Python worker: when the young half is full it becomes the old half, so frequent keys survive."""

    def __init__(self, limit: int = 250_000):
        self.limit, self.young, self.old = limit, {}, {}

    def missing(self, keys: set) -> list:
        """Moves known keys to the young half and returns those that must be computed."""
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        return out

    def put(self, keys, values) -> None:
        self.young.update(zip(keys, values))

    def turn(self) -> None:
        """Call between batches, never while a batch looks keys up."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def byte_slices(texts: list, most: int):
    """Yields (start, end) so that each slice holds about ``most`` bytes, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


DOUBLE_SPACE = re.compile(r"\s ")
