"""Word shingles as sets of 64-bit hashes, computed for many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rostrum.llm.common import mixed

#: Words of a shingle.
SHINGLE = 5
#: Text bytes hashed at once.
STEP = 1 << 19

_rng = np.random.default_rng(20)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x5851F42D4C957F2D)
_JOIN = np.uint64(0x2545F4914F6CDD1D)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte with A-Z lower-cased, and which bytes are white space."""
    low = np.arange(256)
    low[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return _VALUE[low], blank


def views(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A text column in steps of about :data:`STEP` bytes: first and last row, bytes, and row offsets into them."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    Words are lower-cased (A-Z only) runs of non-white-space. A text of fewer than ``width`` words has its whole word
    sequence as its one shingle; null texts and texts without words have none.
    """
    values, blanks = byte_tables()
    inverse = np.uint64(_inverse(int(_BASE)))
    for first, last, data, offsets in views(column):
        n = len(data)
        if not n:
            yield from (np.zeros(0, np.uint64) for _ in range(first, last))
            continue
        blank = blanks[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        begins = np.flatnonzero(~blank & (edge[:-1] | np.concatenate(([True], blank[:-1]))))
        ends = np.flatnonzero(~blank & (edge[1:] | np.concatenate((blank[1:], [True])))) + 1
        power = np.full(n, _BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * power, out=sums[1:])
        back = np.full(n, inverse)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        words = mixed((sums[ends] - sums[begins]) * back[begins] + (ends - begins).astype(np.uint64))
        at = np.searchsorted(begins, offsets)
        joined = words[: max(0, len(words) - width + 1)].copy()
        for k in range(1, width):
            joined *= _JOIN
            joined += words[k : len(words) - width + 1 + k]
        joined = mixed(joined)
        for row in range(last - first):
            a, b = at[row], at[row + 1]
            if b - a >= width:
                yield np.unique(joined[a : b - width + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for word in words[a:b]:
                    short = short * _JOIN + word
                yield mixed(short)
            else:
                yield np.zeros(0, np.uint64)
