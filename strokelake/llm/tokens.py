"""Token counts, and ids cut into pieces, with public vocabularies inside Arrow functions.

A text is split at boundaries that no token can cross; each worker encodes every distinct segment once, in batches
balanced by bytes, and adds up what its segments gave. The result is exactly the library's for the whole text.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOUBLE_SPACE, TwoGenerations, byte_slices

#: Bytes handed to the library at once.
BATCH_BYTES = 256 << 10

_LOADED: dict = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


# --- byte-level BPE: a space after a character that isn't white space always begins a token ---

class ByteLevelCounter:
    """Counts the tokens of a byte-level BPE whose pre-tokenizer begins a token at a space that follows other text."""

    def __init__(self, path: str):
        self.tokenizer, self.memo = _tokenizer(path), TwoGenerations()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of text that each id stands for
        for token, i in vocabulary.items():
            self.width[i] = len(token.encode()) if token in special else len(token)

    def counts(self, texts: list[str]) -> list[int]:
        out, split, whole = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if t[0] == " " or t[-1] == " " or "\0" in t or DOUBLE_SPACE.search(t):
                whole.append(i)  # runs of white space: rare, and encoded as they are, at safe boundaries if long
            else:
                split.append(i)
        parts = [texts[i].split(" ") for i in split]
        for p in parts:
            p[0] = "\0" + p[0]  # the first segment has no space before it
        self._learn({w for p in parts for w in p})
        known = self.memo.young.__getitem__
        for i, p in zip(split, parts):
            out[i] = sum(map(known, p))
        self.memo.turn()
        for i in whole:
            out[i] = sum(self._library(list(self._safe(texts[i]))))
        return out

    @staticmethod
    def _safe(text: str, size: int = BATCH_BYTES):
        """Cuts a long text before a space between two characters that aren't white space."""
        start = 0
        while len(text) - start > size:
            cut = next((m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text[start + size : start + 2 * size])), None)
            if cut is None:
                break
            yield text[start : start + size + cut]
            start += size + cut
        yield text[start:]

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for a, b in byte_slices(texts, BATCH_BYTES) for e in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]

    def _learn(self, keys: set) -> None:
        new = self.memo.missing(keys)
        first = [k for k in new if k[0] == "\0"] if any(k[:1] == "\0" for k in new) else []
        if first:
            self.memo.put(first, self._library([k[1:] for k in first]))
            taken = set(first)
            new = [k for k in new if k not in taken]
        for a, b in byte_slices(new, BATCH_BYTES):
            # The segments stand behind one another; ids are dealt back by the bytes they cover.
            ids = self.tokenizer.encode(" " + " ".join(new[a:b]), add_special_tokens=False).ids
            ends = np.cumsum([len(k.encode()) + 1 for k in new[a:b]])
            covered = np.cumsum(self.width[ids])
            at = np.searchsorted(covered, ends) + 1
            if covered[-1] != ends[-1] or (covered[at - 1] != ends).any():  # never seen; the plain way is exact in any case
                self.memo.put(new[a:b], self._library([" " + k for k in new[a:b]]))
            else:
                self.memo.put(new[a:b], np.diff(at, prepend=0).tolist())


_COUNTERS: dict = {}


def _counter(path: str):
    """The counter of this worker: ``.json`` is read by tokenizers (byte-level BPE), ``.model`` by sentencepiece."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            from .pieces import PieceCounter

            _COUNTERS[path] = PieceCounter(path)
        else:
            _COUNTERS[path] = ByteLevelCounter(path)
    return _COUNTERS[path]


def count_udf(tokenizer_path: str):
    """An Arrow function of a text column that gives the library's token counts; null texts count 0."""

    def count(texts):
        import pandas as pd

        listed = [t or "" for t in texts]
        return pd.Series([n for a, b in byte_slices(listed, 4 << 20) for n in _counter(tokenizer_path).counts(listed[a:b])], dtype="int64")

    return F.pandas_udf(count, "long")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens`` per row: what the library returns for the whole text, special strings as by its default.

    Null and empty texts have no bytes and no tokens; a null id stays null; repeated rows each give a row; other columns are
    not read, so clashing names do no harm; an empty table gives an empty result.
    """

    def count(batches):
        counter = _counter(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [n for a, b in byte_slices(texts, 4 << 20) for n in counter.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


# --- word BPE: white space separates tokens and is dropped ---

#: ASCII marks: a run of them is one pre-token.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Ids of a BPE that lower-cases, drops white space and marks word ends, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.memo = _tokenizer(path), TwoGenerations(400_000)
        # For words of letters only, to which the rest of the normaliser does nothing; a-z stand for themselves as bytes.
        self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [t.encode().lower().split() for t in texts]  # A-Z only; other letters are left to the library
        self._learn(set().union(*parts))
        known = self.memo.young.__getitem__
        out = [b"".join(map(known, p)) for p in parts]
        self.memo.turn()
        return out

    @staticmethod
    def _latin(word: bytes) -> bool:
        """Letters of the Latin blocks only, composed: there, lower-casing is the same everywhere and nothing else applies."""
        return not word.isascii() and (w := word.decode()).isalpha() and max(w) < "\u0250" and "\u0130" not in w and unicodedata.is_normalized("NFC", w)

    def _learn(self, keys: set) -> None:
        """Marks behind letters are tokens of their own, so such a word is its letters' ids and those of the marks."""
        memo, latin, ended = self.memo, self._latin, []
        kinds: tuple[list, list, list] = [], [], []

        def sort_out(words) -> None:
            for k in words:
                kinds[0 if k.isalpha() else 1 if latin(k) else 2].append(k)

        new = memo.missing(keys)
        whole = []
        for k in new:
            base = k.rstrip(_MARKS)
            if len(base) < len(k) and (base.isalpha() or latin(base)):
                ended.append((k, base, k[len(base) :]))
            else:
                whole.append(k)
        sort_out(whole)
        if ended:
            known = set(whole)
            sort_out(k for k in memo.missing({base for _, base, _ in ended}) if k not in known)
        for words, tokenizer in ((kinds[0], self.ascii), (kinds[1], self.latin)):
            for a, b in byte_slices(words, BATCH_BYTES):
                ids = np.array(tokenizer.encode(b" ".join(words[a:b]).decode().lower(), add_special_tokens=False).ids, "<u4")
                cuts = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
                raw = ids.tobytes()
                memo.put(words[a:b], [raw[x:y] for x, y in zip(cuts, cuts[1:])])
        rest = kinds[2]
        for a, b in byte_slices(rest, BATCH_BYTES):
            found = self.tokenizer.encode_batch_fast([k.decode() for k in rest[a:b]], add_special_tokens=False)
            memo.put(rest[a:b], [np.array(e.ids, "<u4").tobytes() for e in found])
        young, marks = memo.young, self.marks
        if len(marks) > 10_000:
            marks.clear()
        for m in {m for _, _, m in ended}.difference(marks):
            marks[m] = np.array(self.tokenizer.encode(m.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        young.update((k, young[base] + marks[m]) for k, base, m in ended)


_ENCODERS: dict = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Ids of every whole text and ``end_id`` behind them, cut into pieces of ``limit`` ids; only the last may be shorter.

    Returns ``id_col, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (array of int). A null or empty text is
    the end id alone. Repeated rows each give their pieces; other columns are not read; an empty table gives no piece.
    """
    kind = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches):
        if tokenizer_path not in _ENCODERS:
            _ENCODERS[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in byte_slices(texts, 4 << 20):
                rows = [[], [], [], [], [], []]
                for key, raw in zip(keys[a:b], encoder.encode(texts[a:b])):
                    raw += tail
                    for piece, at in enumerate(range(0, len(raw), 4 * limit)):
                        part = raw[at : at + 4 * limit]
                        for column, value in zip(rows, (key, piece, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if with_ids else None)):
                            column.append(value)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, kind).withColumnRenamed("id", id_col)
