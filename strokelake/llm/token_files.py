"""Token ids as Arrow files of equal-length sequences, with zero-copy random access.

The ids of all texts, in the order of their documents, are one long run. It is cut into shards at documents, and a shard into
sequences of equal length; only the last one of a shard is filled up. A shard is an Arrow file: the stream format with a
footer that says where each batch is, its columns ``ids`` and ``mask`` (true for an id, false for filling) fixed-size lists,
uncompressed. So sequence i is a slice of the mapped file, without a copy. Beside it, a second such file says where each document stands.

Shards are bounded by quantiles of the document ids, so that tokens, not texts, are shuffled, and each once. A file is
written under a name of its own and then renamed; a task that runs again writes the same bytes.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import WordEncoder, _ENCODERS, _tokenizer

#: Bytes of text that make up a shard, about, and sequences of a batch.
SHARD_BYTES, BATCH = 256 << 20, 256


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a path or URI, as executors reach it."""
    folder = re.sub(r"^file:/(?!/)", "file:///", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _names(folder: str, shard: int) -> tuple[str, str]:
    return f"{folder}/{shard:06d}.arrow", f"{folder}/{shard:06d}.documents.arrow"


class ShardWriter:
    """Writes one shard while ids come in; holds a batch of sequences and the places of a few thousand documents."""

    def __init__(self, folder: str, shard: int, length: int, kind: np.dtype):
        self.system, folder = _place(folder)
        self.names, self.length, self.kind = _names(folder, shard), length, kind
        self.temporary = [f"{n}.{uuid.uuid4().hex}" for n in self.names]
        item = lambda t: pa.list_(pa.field("item", t, nullable=False), length)
        self.schema = pa.schema([pa.field("ids", item(pa.from_numpy_dtype(kind)), nullable=False), pa.field("mask", item(pa.bool_()), nullable=False)])
        self.places = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = [self.system.open_output_stream(n) for n in self.temporary]
        self.files = [ipc.new_file(o, s) for o, s in zip(self.out, (self.schema, self.places))]
        self.waiting, self.n_waiting, self.n_ids, self.n_docs, self.docs = [], 0, 0, 0, ([], [], [])

    def add(self, doc_ids: list, ids: list[np.ndarray]) -> None:
        sizes = [len(x) for x in ids]
        self.docs[0].extend(doc_ids)
        self.docs[1].extend((self.n_ids + np.cumsum([0, *sizes[:-1]])).tolist())
        self.docs[2].extend(sizes)
        self.n_docs += len(sizes)
        self.n_ids += sum(sizes)
        self.waiting += ids
        self.n_waiting += sum(sizes)
        if self.n_waiting >= BATCH * self.length:
            self._write(self.n_waiting // self.length)
        if len(self.docs[0]) >= 10_000:
            self._write_places()

    def _write(self, sequences: int) -> None:
        """Writes whole sequences; what is left over waits, and at the end is filled up."""
        run = np.concatenate(self.waiting) if self.waiting else np.zeros(0, self.kind)
        n = min(len(run), sequences * self.length)
        for a in range(0, sequences, BATCH):
            b = min(a + BATCH, sequences)
            ids = run[a * self.length : b * self.length]
            real = len(ids)
            if real < (b - a) * self.length:
                ids = np.pad(ids, (0, (b - a) * self.length - real))
            mask = np.arange(len(ids)) < real if real < len(ids) else np.ones(len(ids), bool)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self.schema)]
            self.files[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.waiting, self.n_waiting = [run[n:]], len(run) - n

    def _write_places(self) -> None:
        self.files[1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.docs], schema=self.places))
        self.docs = ([], [], [])

    def close(self) -> tuple[int, int]:
        """Number of documents and of ids."""
        self._write(-(-self.n_waiting // self.length))
        self._write_places()
        for f, o in zip(self.files, self.out):
            f.close()
            o.close()
        for a, b in zip(self.temporary, self.names):
            self.system.move(a, b)
        return self.n_docs, self.n_ids


class TokenFile:
    """Random access to a shard; on a local or mounted file system its arrays are views of the mapped file."""

    def __init__(self, folder: str, shard: int):
        system, folder = _place(folder)
        open_file = (lambda n: pa.memory_map(n)) if isinstance(system, fs.LocalFileSystem) else system.open_input_file
        self.file, self.places = (ipc.open_file(open_file(n)) for n in _names(folder, shard))
        self.length = self.file.schema.field("ids").type.list_size
        self._ends = None

    def batch(self, k: int) -> np.ndarray:
        """All ids of a batch, one sequence behind the other."""
        return self.file.get_batch(k).column("ids").flatten().to_numpy()

    def _row(self, i: int) -> tuple[int, int]:
        if self._ends is None:
            self._ends = np.cumsum([self.file.get_batch(k).num_rows for k in range(self.file.num_record_batches)]).tolist()
        k = bisect_right(self._ends, i)
        return k, i - (self._ends[k - 1] if k else 0)

    def sequence(self, i: int) -> np.ndarray:
        k, row = self._row(i)
        return self.batch(k)[row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> pa.Array:
        k, row = self._row(i)
        return self.file.get_batch(k).column("mask").slice(row, 1).flatten()

    def documents(self):
        """(doc_id, start, ids) of each document, in order; ids that stand in one batch are a view."""
        k, at, run = 0, 0, np.zeros(0, self.file.schema.field("ids").type.value_type.to_pandas_dtype())
        for p in range(self.places.num_record_batches):
            for doc_id, start, n in zip(*(c.to_pylist() for c in self.places.get_batch(p).columns)):
                if start + n - at > len(run):
                    parts, have = [run[start - at :]], len(run) - (start - at)
                    while have < n:
                        parts.append(self.batch(k))
                        have, k = have + len(parts[-1]), k + 1
                    run, at = np.concatenate(parts) if len(parts[0]) else parts[-1] if len(parts) == 2 else np.concatenate(parts), start
                yield doc_id, start, run[start - at : start - at + n]


def _shards(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> list[int]:
    """Document ids at which the second and later shards begin, ascending; an id that fills several shards stands there several times."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(tasks, -(-size // shard_bytes))
    found = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    return found or []


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, length: int = 2048, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every whole text and ``end_id`` behind them to ``folder``; returns ``shard, n_docs, n_ids, base`` of each shard.

    Documents stand in ascending order of ``id_col`` (a long; null first), those that share an id by their ids, but for an id of
    which there are more rows than shards hold: its rows are spread over shards as they come. ``base`` counts the ids of all shards
    before. A null or empty text is the end id alone; an empty table gives no shard; other columns aren't read.
    """
    spark: SparkSession = docs.sparkSession
    make_folder(spark, folder)
    bounds = np.array(_shards(docs, id_col, text_col, shard_bytes), np.int64)
    kind = np.dtype("<u2") if _tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else np.dtype("<u4")
    tail = np.array([end_id], kind).tobytes()

    def encode(batches):
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder, seen = _ENCODERS[tokenizer_path], 0
        for batch in batches:
            keys = pc.fill_null(batch.column(0), np.iinfo(np.int64).min).to_numpy()
            first, last = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
            # Equal ids go to one shard, but an id that is the bound of several is dealt to those that begin and end with it.
            spread = last - first > 1
            shards = np.where(spread, first + 1 + (seen + np.arange(len(keys))) % np.maximum(last - first, 1), last)
            seen += len(keys)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in common.byte_slices(texts, 4 << 20):
                raw = [(r if kind.itemsize == 4 else np.frombuffer(r, "<u4").astype(kind).tobytes()) + tail for r in encoder.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(shards[a:b], pa.int32()), batch.column(0)[a:b], pa.array(raw, pa.binary())], names=["_shard", "_id", "_ids"])

    def write(batches):
        writer, shard, rows = None, None, []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if numbers[a] != shard:
                    if writer:
                        rows.append((shard, *writer.close()))
                    shard = int(numbers[a])
                    writer = ShardWriter(folder, shard, length, kind)
                writer.add(batch.column(1)[a:b].to_pylist(), [np.frombuffer(r, kind) for r in batch.column(2)[a:b].to_pylist()])
        if writer:
            rows.append((shard, *writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())], names=["shard", "n_docs", "n_ids"])

    ids = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(encode, "_shard int, _id long, _ids binary")
    dealt = ids.repartitionById(len(bounds) + 1, "_shard").sortWithinPartitions("_shard", "_id", "_ids")
    # A few numbers a shard, so they may pass the driver.
    rows, base = [], 0
    for r in sorted(dealt.mapInArrow(write, "shard int, n_docs long, n_ids long").collect()):
        rows.append((*r, base))
        base += r["n_ids"]
    return spark.createDataFrame(rows, "shard int, n_docs long, n_ids long, base long")


def read_token_files(shards: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """``id_col, start, n_tokens, ids_crc32`` (and ``ids``) of each document in the shards, read from their files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken of little-endian unsigned 32-bit ids.
    """

    def read(batches):
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                for doc_id, start, ids in TokenFile(folder, shard).documents():
                    wide = ids.astype("<u4")
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(wide), wide.astype(np.int64) if with_ids else None))
                    if len(rows) == 4096:
                        yield give(rows)
                        rows = []
                yield give(rows)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 if with_ids else 4]
    names = ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]

    def give(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    n = max(1, min(shards.count(), 10_000))
    dealt = shards.repartitionById(n, F.pmod("shard", F.lit(n)))
    return dealt.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids).withColumnRenamed("id", id_col)


def files_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors share."""
    common.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
