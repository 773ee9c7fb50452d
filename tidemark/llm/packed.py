"""Whole texts as flat byte buffers: vectorised words, 64-bit word hashes and runs.

Every function works on a *chunk* of whole documents (``chunks`` bounds its bytes; one longer document is a chunk of its
own), so a task's memory follows the chunk and not its partition. Separators of all word rules used here are single ASCII
bytes, which never occur inside a multi-byte UTF-8 character, so splitting bytes and splitting text agree.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20
#: Bytes looked up at once in a table of their values: numpy makes an eight-byte index of each.
TILE = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
#: Random 64-bit value of each byte; A-Z take the values of a-z, so hashes ignore ASCII case.
BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE_CASE = BYTE_VALUE.copy()
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words are runs of ASCII digits, lower-cased ASCII letters and all bytes beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(-(-n // (4 * TILE)) * 4 * TILE, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def inverse_powers(n: int) -> np.ndarray:
    """Factors that take the place of a span out of a difference of prefix sums."""
    return _powers(n)[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of whole rows with about ``limit`` bytes of text each."""
    try:
        yield from _regrouped(batches, text, limit)
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the machine: Spark keeps Python workers, idle ones too, from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _regrouped(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text)
        offsets = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.binary_length(lengths).to_numpy(zero_copy_only=False)) + 16)])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size, "right")) - 1)
            part = batch.slice(at, upto - at)
            held.append(part)
            size += int(offsets[upto] - offsets[at])
            at = upto
            if size >= limit or at < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """``table[data]`` of a byte buffer, tile by tile."""
    out = np.empty(len(data), table.dtype)
    for a in range(0, len(data), TILE):
        out[a : a + TILE] = table[data[a : a + TILE]]
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word, in text order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = looked_up(is_word, data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """n+1 prefix sums from which ``span_hash`` takes the hash of any byte span."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    for a in range(0, len(data), TILE):
        b = min(len(data), a + TILE)
        np.multiply(values[data[a:b]], up[a:b], out=out[a + 1 : b + 1])
    return np.cumsum(out, out=out)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end; equal spans have equal hashes wherever they stand."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash (ASCII case ignored) and document of every word, in text order."""
    starts, ends, docs = words(data, offsets, is_word)
    return span_hash(prefix_hash(data), starts, ends), docs


def run_sums(values: np.ndarray, keys_sorted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and the sum of values of each."""
    if not len(keys_sorted):
        return keys_sorted, values
    first = np.flatnonzero(np.concatenate([[True], keys_sorted[1:] != keys_sorted[:-1]]))
    return keys_sorted[first], np.add.reduceat(values, first)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each of many runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
