"""Text of records: code pages, layout origins, justification and reordering."""

from __future__ import annotations

import codecs
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Where the single-byte pages have characters that Python's codecs leave undefined; (page, first byte, first character).
EXCEPTIONS = [
    (874, 0xDB, 0xF8C1), (874, 0xDC, 0xF8C2), (874, 0xDD, 0xF8C3), (874, 0xDE, 0xF8C4), (874, 0xFC, 0xF8C5), (874, 0xFD, 0xF8C6), (874, 0xFE, 0xF8C7), (874, 0xFF, 0xF8C8),
    (1253, 0xAA, 0xF8F9), (1253, 0xD2, 0xF8FA), (1253, 0xFF, 0xF8FB),
    (1255, 0xCA, 0x05BA), (1255, 0xD9, 0xF88D), (1255, 0xDA, 0xF88E), (1255, 0xDB, 0xF88F), (1255, 0xDC, 0xF890), (1255, 0xDD, 0xF891), (1255, 0xDE, 0xF892), (1255, 0xDF, 0xF893), (1255, 0xFB, 0xF894), (1255, 0xFC, 0xF895), (1255, 0xFF, 0xF896),
    (1257, 0xA1, 0xF8FC), (1257, 0xA5, 0xF8FD),
]
# Character sets of fonts to code pages.
CHARSETS = {0: 1252, 77: 10000, 128: 932, 129: 949, 134: 936, 136: 950, 161: 1253, 162: 1254, 163: 1258, 177: 1255, 178: 1256, 186: 1257, 204: 1251, 222: 874, 238: 1250}
# Pages whose characters have one or two bytes.
DOUBLE_BYTE = (932, 936, 949, 950)


def _page_rows(page: int) -> list[tuple[int, int, int]]:
    odd, out = {(p, b): c for p, b, c in EXCEPTIONS}, []
    for byte in range(256):
        text = codecs.decode(bytes([byte]), f"cp{page}", "ignore")
        out.append((page, byte, odd.get((page, byte), ord(text) if text else byte)))
    return out


def code_pages(spark: SparkSession, pages: tuple[int, ...] = (874, 1250, 1251, 1252, 1253, 1254, 1255, 1256, 1257, 1258)) -> DataFrame:
    """``page, byte, code_point`` of single-byte pages, from Python's codecs; undefined bytes stand for themselves but for the exceptions."""
    return spark.createDataFrame([row for page in pages for row in _page_rows(page)], "page int, byte int, code_point int")


# Of each double-byte page the default character, the ranges of lead bytes, and the single bytes that Python's codecs leave out.
DOUBLE = {
    932: (0x30FB, ((0x81, 0x9F), (0xE0, 0xFC)), {0x80: 0x80, 0xA0: 0xF8F0, 0xFD: 0xF8F1, 0xFE: 0xF8F2, 0xFF: 0xF8F3}),
    936: (0x3F, ((0x81, 0xFE),), {0x80: 0x20AC, 0xFF: 0xF8F5}),
    949: (0x3F, ((0x81, 0xFE),), {0x80: 0x80, 0xFF: 0xF8F7}),
    950: (0x3F, ((0x81, 0xFE),), {0x80: 0x80, 0xFF: 0xF8F8}),
}
# Where the pages have characters of the user's own: first and last lead byte, ranges of trail bytes, first character.
OWN_CHARACTERS = {
    936: [(0xAA, 0xAF, ((0xA1, 0xFE),), 0xE000), (0xF8, 0xFE, ((0xA1, 0xFE),), 0xE234), (0xA1, 0xA7, ((0x40, 0x7E), (0x80, 0xA0)), 0xE4C6)],
    949: [(0xC9, 0xC9, ((0xA1, 0xFE),), 0xE000), (0xFE, 0xFE, ((0xA1, 0xFE),), 0xE05E)],
    950: [(0xFA, 0xFE, ((0x40, 0x7E), (0xA1, 0xFE)), 0xE000), (0x8E, 0xA0, ((0x40, 0x7E), (0xA1, 0xFE)), 0xE311), (0x81, 0x8D, ((0x40, 0x7E), (0xA1, 0xFE)), 0xEEB8), (0xC6, 0xC6, ((0xA1, 0xFE),), 0xF6B1), (0xC7, 0xC8, ((0x40, 0x7E), (0xA1, 0xFE)), 0xF70F)],
}
#: Stands for a code without a character while a page is looked up.
NONE = "\uffff"


def is_lead(page: int, byte: int) -> bool:
    return any(a <= byte <= b for a, b in DOUBLE[page][1])


def double_byte_table(page: int) -> list[str]:
    """A character for each code, which is the byte itself or 256 times the lead byte and the trail byte; from Python's codecs and the rules above."""
    table = [NONE] * 65536
    for byte in range(256):
        if not is_lead(page, byte):
            table[byte] = chr(DOUBLE[page][2].get(byte, 0)) if byte in DOUBLE[page][2] else codecs.decode(bytes([byte]), f"cp{page}")
            continue
        for trail in range(1, 256):
            try:
                text = codecs.decode(bytes([byte, trail]), f"cp{page}")
            except UnicodeDecodeError:
                continue
            if len(text) == 1:
                table[256 * byte + trail] = text
    for first, last, trails, at in OWN_CHARACTERS.get(page, []):
        listed = [t for a, b in trails for t in range(a, b + 1)]
        for k, (lead, trail) in enumerate((lead, t) for lead in range(first, last + 1) for t in listed):
            table[256 * lead + trail] = chr(at + k)
    return table


def decode_double(data: Column, page: int) -> Column:
    """{units, spans} of data under a double-byte page: its characters, and how many bytes each of them came from; null for null.

    A lead byte takes the next byte with it unless that is NUL or missing; which bytes are leads is told by matching from the start. A pair or
    a lone lead without a character gives the page's default character. Every byte is in one span.
    """
    default, leads, _ = DOUBLE[page]
    ranges = "".join(f"\\x{a:02x}-\\x{b:02x}" for a, b in leads)
    table = F.split(F.lit("".join(double_byte_table(page))), "")
    tokens = F.regexp_extract_all(F.decode(data, "ISO-8859-1"), F.lit(f"(?s)[{ranges}][^\\x00]|."), F.lit(0))
    code = lambda t: F.when(F.length(t) == 2, F.ascii(t) * 256 + F.ascii(F.substring(t, 2, 1))).otherwise(F.ascii(t))
    unit = lambda t: F.get(table, code(t))
    known = lambda u: F.when(u == NONE, chr(default)).otherwise(u)
    return F.when(data.isNotNull(), F.struct(F.transform(F.transform(tokens, unit), known).alias("units"), F.transform(tokens, lambda t: F.length(t)).alias("spans")))


@functools.cache
def _double_units(page: int) -> tuple[np.ndarray, np.ndarray]:
    """The code point of each code of a page, its default where there is none, and which bytes are leads."""
    units = [DOUBLE[page][0] if c == NONE else ord(c) for c in double_byte_table(page)]
    return np.array(units, "<u4"), np.array([is_lead(page, b) for b in range(256)])


def _read_double(data: bytes, page: int) -> str:
    """The text of ``decode_double``: in a run of lead bytes every other one, from the first, takes the next byte with it."""
    units, leads = _double_units(page)
    b = np.frombuffer(data, "uint8").astype("int64")
    at, lead = np.arange(len(b)), leads[b]
    begin = np.maximum.accumulate(np.where(lead, 0, at + 1))
    behind = np.append(b[1:], 0)[: len(b)]
    pair = lead & ((at - begin) % 2 == 0) & (behind != 0)
    single = ~np.append(False, pair[:-1])[: len(b)]
    return units[np.where(pair, b * 256 + behind, b)[single]].tobytes().decode("utf-32-le", "surrogatepass")


def decode_bytes(rows: DataFrame, data_col: str, page: int, out_col: str) -> DataFrame:
    """Adds the text of data under a code page; null stays null."""
    if page in DOUBLE_BYTE:
        return rows.withColumn(out_col, F.pandas_udf(lambda s: s.map(lambda b: None if b is None else _read_double(b, page)), "string")(data_col))
    moved = [(chr(b), chr(c)) for _, b, c in _page_rows(page) if b != c]
    return rows.withColumn(out_col, F.translate(F.decode(F.col(data_col), "ISO-8859-1"), "".join(a for a, _ in moved), "".join(b for _, b in moved)))


def origins(rows: DataFrame, keys: list[str], order: list[str], advance: Column) -> DataFrame:
    """Adds ``origin``: the sum of all advances before a glyph of its run."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("origin", F.coalesce(F.sum(advance).over(before), F.lit(0)))


def justify(rows: DataFrame, keys: list[str], order: list[str], extra: Column, breaks: Column, rank: Column | None = None) -> DataFrame:
    """Adds ``share``: a break's part of the extra width; what doesn't divide goes to the first breaks, one unit each.

    ``rank`` is a break's place from 1 on, where the rows have it; otherwise it is counted by a window, which sorts them.
    """
    if rank is None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    whole = F.floor(extra / breaks)
    return rows.withColumn("share", (whole + F.when(rank <= extra - whole * breaks, 1).otherwise(0)).cast("long"))


_RTL, _NUMBER = {"R", "AL"}, {"EN", "AN"}


# Kinds of code points: neutral, left to right, right to left, number.
_NEUTRAL, _LEFT, _RIGHT, _DIGIT = range(4)


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point; unassigned ones count as left to right."""
    kind = lambda k: _RIGHT if k in _RTL else _LEFT if k in ("L", "") else _DIGIT if k in _NUMBER else _NEUTRAL
    return np.array([kind(unicodedata.bidirectional(chr(c))) for c in range(0x110000)], "uint8")


def _levels(text: str) -> np.ndarray:
    """Embedding levels of text without explicit controls: strong runs, numbers, and neutrals between them. Runs of one kind are looked at, not their characters."""
    every = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.flatnonzero(np.diff(every, prepend=np.uint8(255)))
    kinds, sizes = every[starts], np.diff(starts, append=len(every))
    at = np.arange(len(kinds), dtype="int32")
    strong = (kinds == _LEFT) | (kinds == _RIGHT)
    base = int(len(kinds) > 0 and kinds[np.argmax(strong)] == _RIGHT)
    own = _RIGHT if base else _LEFT
    # A number after a left-to-right letter is part of its run.
    latest = np.maximum.accumulate(np.where(strong, at, -1))
    last = np.where(latest >= 0, kinds[latest], own)
    kinds = np.where((kinds == _DIGIT) & (last == _LEFT), _LEFT, kinds)
    # Neutrals take the direction of both sides if these agree, else the base's; numbers count as right to left.
    side = np.where(kinds == _LEFT, _LEFT, _RIGHT)
    given = kinds != _NEUTRAL
    before, after = np.maximum.accumulate(np.where(given, at, -1)), np.minimum.accumulate(np.where(given, at, len(at))[::-1])[::-1]
    left = np.where(before >= 0, side[before], own)
    right = np.where(after < len(at), side[np.minimum(after, len(at) - 1)], own)
    kinds = np.where(given, kinds, np.where(left == right, left, own))
    return np.repeat(np.array([0, 2 * base, 1, 2], "int32")[kinds], sizes)


def _order(levels: np.ndarray) -> np.ndarray:
    """Display order: runs are reversed from the highest level down to the lowest odd one; a run of an odd level ends up backwards."""
    starts = np.flatnonzero(np.diff(levels, prepend=-1))
    runs, sizes = levels[starts], np.diff(starts, append=len(levels))
    order = np.arange(len(runs))
    for level in range(int(runs.max(initial=0)), 0, -1):
        high = runs[order] >= level
        edges = np.flatnonzero(np.diff(np.concatenate([[0], high.astype("int8"), [0]])))
        begin, end = edges[::2], edges[1::2]
        to = np.arange(len(order))
        to[high] = np.repeat(begin + end - 1, end - begin) - to[high]
        order = order[to]
    odd, size = runs[order] % 2 == 1, sizes[order]
    step = np.where(odd, -1, 1).astype("int32")
    first = np.where(odd, starts[order] + size - 1, starts[order]) - step * (np.cumsum(size) - size)
    return np.repeat(first.astype("int32"), size) + np.repeat(step, size) * np.arange(len(levels), dtype="int32")


#: Bytes of texts, or levels, to work on at once; a longer text is taken whole.
PIECE = 1 << 18


def _pieces(values: pa.Array) -> Iterator[pa.Array]:
    """The values of a batch in order, so many at once as hold ``PIECE`` bytes or items, one at least."""
    length = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    ends, i = np.cumsum(pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False), dtype="int64"), 0
    while i < len(values):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        yield values.slice(i, j - i)
        i = j


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    places = np.cumsum([0, *[0 if a is None else len(a) for a in arrays]], dtype="int32")
    content = np.concatenate([np.zeros(0, "int32"), *[a for a in arrays if a is not None]])
    return pa.ListArray.from_arrays(pa.array(places), pa.array(content), mask=pa.array([a is None for a in arrays], pa.bool_()))


def _level_lists(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in (p for batch in texts for p in _pieces(batch)):
        yield _lists([None if t is None else _levels(t) for t in part.to_pylist()])


def _order_lists(levels: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in (p for batch in levels for p in _pieces(batch)):
        yield _lists([_order(x.values.to_numpy(zero_copy_only=False).astype("int32")) if x.is_valid else None for x in part])


def _both_lists(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in (p for batch in texts for p in _pieces(batch)):
        levels = [None if t is None else _levels(t) for t in part.to_pylist()]
        yield pa.StructArray.from_arrays([_lists(levels), _lists([None if x is None else _order(x) for x in levels])], ["levels", "display"])


def bidi_levels(text: str) -> Column:
    """The embedding level of each code point; null stays null. Explicit controls count as neutral."""
    return F.arrow_udf(_level_lists, "array<int>")(text)


def display_order(levels: str) -> Column:
    """Logical indices in display order."""
    return F.arrow_udf(_order_lists, "array<int>")(levels)


def bidi(text: str) -> Column:
    """``struct<levels, display>``: ``bidi_levels`` and their ``display_order`` at once, so that texts go to Python once and levels not again."""
    return F.arrow_udf(_both_lists, "levels array<int>, display array<int>")(text)
