"""PackBits over Arrow arrays: a batch is read where it lies and written to one buffer, a bounded number of bytes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes to encode at once; a longer value is cut between packets.
WINDOW = 1 << 17


def _packed(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Packets of the values that begin at these places of ``x``, none of them empty; where runs begin, in ``x`` and in the packets; where the last packet that may yet grow begins."""
    new = np.empty(len(x), bool)
    new[0], new[1:], new[begins] = True, x[1:] != x[:-1], True
    starts = np.flatnonzero(new)
    full, rest = np.divmod(np.diff(np.append(starts, len(x))), 128)
    # A single byte joins the single bytes before it, up to 128 of them; repeated ones are packets of up to 128.
    single = rest == 1
    joins = single & (full == 0)
    joins[1:] &= single[:-1]
    joins[np.searchsorted(starts, begins)] = False
    places = np.arange(len(starts))
    heads = single & ((places - np.maximum.accumulate(np.where(single & ~joins, places, 0))) % 128 == 0)
    size = 2 * full + 2 * (rest > 1) + single + heads
    ends = np.cumsum(size)
    at, out = ends - size, np.empty(ends[-1], np.uint8)
    k = np.flatnonzero(full)
    of = np.repeat(k, full[k])
    to = at[of] + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(full[k]) - full[k], full[k]))
    out[to], out[to + 1] = 129, x[starts[of]]
    k = np.flatnonzero(rest > 1)
    out[ends[k] - 2], out[ends[k] - 1] = 257 - rest[k], x[starts[k]]
    k, h = np.flatnonzero(single), np.flatnonzero(heads)
    out[ends[k] - 1] = x[starts[k]]
    out[ends[h] - 2] = np.diff(np.append(np.searchsorted(k, h), len(k))) - 1
    if single[-1]:
        last = starts[h[-1]] + 128 * full[h[-1]], ends[h[-1]] - 2
    else:
        last = starts[-1] + 128 * full[-1], at[-1] + 2 * full[-1]
    return out, starts, at, int(last[0]), int(last[1])


def _parts(values: pa.Array) -> tuple[np.ndarray, pa.Buffer | bytes]:
    wide = values.cast(pa.large_binary())
    return np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1], wide.buffers()[2] or b""


def _array(ends: list[int], content: bytearray, valid: pa.Array) -> pa.Array:
    wide = pa.Array.from_buffers(pa.large_binary(), len(valid), [valid.buffers()[1], pa.py_buffer(np.array(ends, np.int64)), pa.py_buffer(content)])
    return wide.cast(pa.binary())


def pack(values: pa.Array) -> pa.Array:
    """PackBits of each value; null stays null."""
    ends, content = _parts(values)
    x, out, places, i = np.frombuffer(content, np.uint8), bytearray(), [0], 0
    while i < len(values):
        j = int(np.searchsorted(ends, ends[i] + WINDOW, "right")) - 1
        if j > i:
            inside = ends[i : j + 1] - ends[i]
            base = len(out)
            if inside[-1]:
                made, starts, at, *_ = _packed(x[ends[i] : ends[j]], inside[:-1][np.diff(inside) > 0])
                places += (base + np.append(at, len(made))[np.searchsorted(starts, inside[1:])]).tolist()
                out += made.data
            else:
                places += [base] * (j - i)
            i = j
            continue
        a, b = int(ends[i]), int(ends[i + 1])
        while a < b:
            made, _, _, read, written = _packed(x[a : min(a + WINDOW, b)], np.zeros(1, np.int64))
            if a + WINDOW < b:
                out += made[:written].data
                a += read
            else:
                out += made.data
                a = b
        places.append(len(out))
        i += 1
    return _array(places, out, values.is_valid())


def unpack(values: pa.Array) -> pa.Array:
    """The bytes of each value's packets; null for data that end inside a run."""
    ends, content = _parts(values)
    data, out, places, whole, ends = np.frombuffer(content, np.uint8).data, bytearray(), [0], values.is_valid().to_numpy(zero_copy_only=False).copy(), ends.tolist()
    for k, (i, end) in enumerate(zip(ends, ends[1:])):
        while i < end:
            head = data[i]
            if head < 128:
                if i + 2 + head > end:
                    break
                out += data[i + 1 : i + 2 + head]
                i += 2 + head
            elif head == 128:
                i += 1
            else:
                if i + 1 >= end:
                    break
                out += bytes((data[i + 1],)) * (257 - head)
                i += 2
        if i < end:
            whole[k] = False
            del out[places[-1] :]
        places.append(len(out))
    return _array(places, out, pa.array(whole))
