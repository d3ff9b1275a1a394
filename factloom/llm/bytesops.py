"""Vectorised byte-level text primitives that the operators' Arrow kernels share.

Texts are handled as UTF-8. A *block* is a list of byte strings joined by one space, so that
no word crosses two texts; blocks are cut at about ``BLOCK_BYTES`` so that the temporary
arrays (a few dozen bytes per text byte) stay bounded whatever an Arrow batch holds. One text
longer than that makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.n = 0
        self.up = self.down = np.empty(0, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 4 * BLOCK_BYTES:  # one very long text: not kept
            return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        if n > self.n:
            self.n = max(n, BLOCK_BYTES + (BLOCK_BYTES >> 1))
            self.up, self.down = _powers(self.n, _BASE), _powers(self.n, pow(_BASE, -1, 1 << 64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of code[b_j] * base**j over j < i (length n + 1)."""
    up, _ = _POWERS.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U64)
    np.cumsum(_BYTE_CODE[buf] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, end): equal bytes give equal hashes anywhere."""
    _, down = _POWERS.get(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def blocks(texts: list[bytes | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts): runs of at most ``limit`` bytes; null counts as empty."""
    first, size, run = 0, 0, []
    for i, text in enumerate(texts):
        text = text or b""
        if run and size + len(text) > limit:
            yield first, run
            first, size, run = i, 0, []
        run.append(text)
        size += len(text) + 1
    if run:
        yield first, run


class Words:
    """The words of one block: maximal runs of bytes other than ``breaks``, which are space
    and 0x09-0x0D unless given.

    ``start``/``end`` are byte ranges in ``buf``; words of text i are
    ``bounds[i]:bounds[i + 1]``; text i's bytes are ``offset[i]:offset[i + 1] - 1`` of ``buf``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, breaks: np.ndarray = _SPACE) -> None:
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = _LOWER[self.buf]
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offset[1:])
        space = breaks[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.bounds = np.searchsorted(self.start, self.offset)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.buf), self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def sum_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]], 0 for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
