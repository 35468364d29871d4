"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation follows the compiled character map of the model: at each place the longest prefix in its double-array trie is
replaced, and every byte that is written remembers the byte of the original text it came from. The normalised text is then
encoded by the library (its own normaliser switched off), segment by segment at word marks that no piece of the vocabulary
crosses, and each piece is projected through the alignment to its span of original bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, byte_slices

MARK = "\u2581"
_MARK = MARK.encode()


class CharacterMap:
    """Longest-prefix rewriting by a compiled map: a 4-byte trie size, the trie's 32-bit units, then strings ended by zero bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length and string offset of the longest entry that begins at a byte; (0, 0) if none does."""
        units, found = self.units, (0, 0)
        if not units:
            return found
        node = self._base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What stands at a byte after normalisation, and how many original bytes that uses up."""
        n, where = self.longest(data, at)
        if n:
            return self.strings[where : self.strings.index(b"\0", where)], n
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + n], n


def normalise(data: bytes, chars: CharacterMap, dummy_prefix: bool, squeeze: bool) -> tuple[bytes, np.ndarray]:
    """Normalised bytes, spaces as word marks, and for each of them (and the end) the original byte it stands for."""
    if not data:
        return b"", np.zeros(1, np.int32)
    if not chars.units and not squeeze:
        raw = np.frombuffer(data, np.uint8)
        source = np.repeat(np.arange(len(raw), dtype=np.int32), np.where(raw == 0x20, 3, 1))
        head = [np.zeros(3, np.int32)] if dummy_prefix else []
        return (_MARK if dummy_prefix else b"") + data.replace(b" ", _MARK), np.concatenate([*head, source, np.array([len(raw)], np.int32)])
    at, out, source = 0, bytearray(), []
    while squeeze and at < len(data):
        text, n = chars.step(data, at)
        if text != b" ":
            break
        at += n
    if at == len(data):
        return b"", np.array([at], np.int32)
    if dummy_prefix:
        out += _MARK
        source += [at] * 3
    spaced = squeeze
    while at < len(data):
        text, n = chars.step(data, at)
        if spaced:
            text = text.lstrip(b" ")
        if text:
            written = text.replace(b" ", _MARK)
            out += written
            source += [at] * len(written)
            spaced = squeeze and text.endswith(b" ")
        at += n
    end = len(data)
    while squeeze and out.endswith(_MARK):
        end = source[len(out) - 3]
        del out[-3:]
        del source[len(out) :]
    return bytes(out), np.array([*source, end], np.int32)


_BETWEEN = re.compile(f"(?<=[^{MARK}])(?={MARK})")


class PieceEncoder:
    """Ids and original byte spans of texts under a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        model = sentencepiece_model_pb2.ModelProto.FromString(raw)
        if not model.trainer_spec.byte_fallback or any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError("needs byte fallback and no user-defined symbols")
        spec = model.normalizer_spec
        self.rules = (CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type == p.NORMAL)
        self.memo = TwoGenerations()
        #: Normalised bytes by which each id moves on; a byte piece moves on at the last byte of its character.
        self.step = np.array([len(p.piece.encode()) for p in model.pieces], np.int32)
        self.lead = np.zeros(len(model.pieces), np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                b = int(p.piece[3:5], 16)
                self.step[i] = b < 0x80
                self.lead[i] = 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4

    def ids(self, normalised: list[bytes]) -> list[bytes]:
        """Ids of normalised texts as little-endian 32-bit integers."""
        if not self.splits:
            return [np.array(self.bare.encode(t.decode()), "<i4").tobytes() for t in normalised]
        parts = []
        for t in normalised:
            if not t:
                parts.append([])
            elif _MARK * 2 in t:
                parts.append([p.encode() for p in _BETWEEN.split(t.decode())])
            else:  # split() takes the marks away; all segments but the first have one in front
                first, *rest = t.split(_MARK)
                parts.append(([first] if first else []) + [_MARK + p for p in rest])
        new = self.memo.missing({p for part in parts for p in part})
        for a, b in byte_slices(new, 256 << 10):
            self.memo.put(new[a:b], [np.array(x, "<i4").tobytes() for x in self.bare.encode([k.decode() for k in new[a:b]], num_threads=1)])
        known = self.memo.young.__getitem__
        out = [b"".join(map(known, part)) for part in parts]
        self.memo.turn()
        return out

    def encode(self, texts: list[str], spans: bool = True) -> list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """(ids, begins, ends) of each text; spans count bytes of the original UTF-8."""
        found = [normalise(t.encode(), *self.rules) for t in texts]
        out = []
        for (_, source), raw in zip(found, self.ids([n for n, _ in found])):
            ids = np.frombuffer(raw, "<i4")
            if not spans:
                out.append((ids, None, None))
                continue
            moves = self.step[ids]
            width = self.lead[ids]
            first = np.flatnonzero(width)
            if len(first):
                moves[first + width[first] - 1] = width[first]
            ends = np.cumsum(moves, dtype=np.int32)
            out.append((ids, source[ends - moves], source[ends]))
        return out


class PieceCounter:
    """Token counts only."""

    def __init__(self, path: str):
        self.encoder = PieceEncoder(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids, _, _ in self.encoder.encode(texts, spans=False)]


_ENCODERS: dict = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``id_col, ids, begins, ends`` (arrays of int, one entry per piece; spans are original UTF-8 bytes) and ``decoded``.

    Ids are the library's for the whole text, without begin or end ids. Null and empty texts give empty arrays and an empty
    decoding; repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    """

    def encode(batches):
        encoder = _encoder(model_path)
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in byte_slices(texts, 4 << 20):
                found = encoder.encode(texts[a:b])
                offsets = pa.array(np.cumsum([0, *(len(x[0]) for x in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in found]), pa.int32())) for k in range(3)]
                decoded = [encoder.library.decode(x[0].tolist()) for x in found] if decode else [None] * (b - a)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *lists, pa.array(decoded, pa.string())], names=["id", "ids", "begins", "ends", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "id long, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The text of each row's ids by the library's decode; null ids give null. All columns stay."""

    def decode(ids):
        library = _encoder(model_path).library
        return ids.map(lambda x: None if x is None else library.decode([int(i) for i in x]))

    return rows.withColumn(out_col, F.pandas_udf(decode, "string")(ids_col))
