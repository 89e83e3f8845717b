"""Words of whole Arrow string batches as 64-bit hashes, without a Python object per word.

A word is a run of bytes other than space and U+0009..U+000D, which never occur inside a
multi-byte UTF-8 sequence, so bytes may be cut where the text would be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STATE: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.full(256, 8, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = 1
KIND[[ord(c) for c in ".,!?;:"]] = 2
#: The same with every ASCII mark as a mark, and digits and other scripts as letters.
MARKS = np.full(256, 1, np.uint8)
MARKS[:128] = [1 if chr(c).isalnum() else 8 if c <= 32 else 2 for c in range(128)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


#: Bytes hashed together.
BLOCK = 1 << 17


def powers() -> tuple[np.ndarray, np.ndarray]:
    """BLOCK powers of an odd base and of its inverse modulo 2**64."""
    if not _STATE:
        for name, by in (("up", _BASE), ("down", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            out = np.full(BLOCK + 1, by, np.uint64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _STATE[name] = out
    return _STATE["up"], _STATE["down"]


def hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each byte range data[first:last], in order and apart; at most BLOCK bytes are worked on at once."""
    up, down = powers()
    out, a = np.zeros(len(first), np.uint64), 0
    total = np.zeros(BLOCK + 1, np.uint64)
    while a < len(first):
        begin = int(first[a])
        b = int(np.searchsorted(last, begin + BLOCK, "right"))
        if b > a:
            n = int(last[b - 1]) - begin
            np.cumsum(BYTE[data[begin : begin + n]] * up[:n], out=total[1 : n + 1])
            at = first[a:b] - begin
            out[a:b] = (total[last[a:b] - begin] - total[at]) * down[at]
            a = b
            continue
        value = 0  # one range longer than a block
        for k, c in enumerate(range(begin, int(last[a]), BLOCK)):
            part = data[c : min(c + BLOCK, int(last[a]))]
            value += int((BYTE[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(up[BLOCK]), k, 1 << 64)
        out[a] = np.uint64(value % (1 << 64))
        a += 1
    return mix(out + (last - first).astype(np.uint64))


@dataclass
class Words:
    """first..last: byte ranges in data; doc: offsets of each row's words; hash: uint64."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; a null row is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer row comes alone and whole."""
    if not batch.num_rows:
        return
    _, at = buffers(batch.column(text))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def words(column: pa.Array, lower: bool | str = False, cut: np.ndarray | None = None) -> Words:
    """lower: A-Z are lower-cased; a string: unless it occurs. cut: KIND or MARKS, words also end between a letter and a mark."""
    data, at = buffers(column)
    if lower and not (isinstance(lower, str) and lower.encode() in data.tobytes()):
        data = LOWER[data]
    n = len(data)
    edge = np.ones(n + 1, bool)  # a blank or a row's end stands before this byte
    solid = np.zeros(n + 2, np.int8)
    solid[1:-1] = ~SPACE[data]
    edge[1:n] = solid[1:n] == 0
    edge[at] = True
    if cut is not None and n > 1:
        kind = cut[data]
        turn = np.r_[False, kind[1:] + kind[:-1] == 3]  # 1: letter, 2: mark, 8: anything else
        edge[:n] |= turn
    inner = solid[1:-1].astype(bool)
    first = np.flatnonzero(inner & edge[:-1])
    closes = np.ones(n + 1, bool)
    closes[:n] = ~inner
    closes[at] = True
    if cut is not None and n > 1:
        closes[:n] |= turn
    last = np.flatnonzero(inner & closes[1:]) + 1
    return Words(data, first, last, np.searchsorted(first, at), hashes(data, first, last))


def runs(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive values; entry i is of values[i:i+k]."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed + k, np.uint64)
    for j in range(k):
        out = (out ^ values[j : j + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def crc32_of(ids: np.ndarray) -> np.ndarray:
    """crc32 of each integer as decimal text."""
    import zlib

    return np.fromiter((zlib.crc32(str(int(x)).encode()) for x in ids), np.int64, len(ids))
