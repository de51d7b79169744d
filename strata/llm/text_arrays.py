"""Whole Arrow string columns as flat NumPy arrays: words, lines and span hashes.

Every helper works on the bytes of many texts at once, so a task never loops over
words in Python.  Texts are handled in chunks of at most ``CHUNK_BYTES`` (a longer
text is a chunk of its own), which bounds the memory of a task by its largest text.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: The white space that separates words (fixed values): space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# Two independent families of span hashes; odd multipliers have an inverse modulo 2**64.
_MULT = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INV = tuple(pow(m, -1, 1 << 64) for m in _MULT)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(mult: int, n: int) -> np.ndarray:
    have = _powers.get(mult)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), mult, dtype=np.uint64)
        steps[0] = 1
        _powers[mult] = have = np.multiply.accumulate(steps)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_column(batch: pa.RecordBatch, name: str) -> pa.LargeStringArray:
    """Column ``name`` with nulls as empty texts and 64-bit offsets."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("")


def chunks(texts: pa.LargeStringArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges ``[lo, hi)`` of at most ``limit`` bytes (at least one row each)."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Flat:
    """The bytes of consecutive texts, one after the other; ``off[i]:off[i + 1]`` is text i."""

    def __init__(self, texts: pa.LargeStringArray, lo: int = 0, hi: int | None = None):
        hi = len(texts) if hi is None else hi
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset + lo : texts.offset + hi + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.n = hi - lo
        self.buf = raw[off[0] : off[-1]]
        self.off = off - off[0]

    def owner(self, pos: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.off, pos, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every word, a maximal run without white space."""
        if not len(self.buf):
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        ink = ~SPACE[self.buf]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        # a text boundary ends a word too
        edge = self.off[1:-1]
        edge = edge[(edge > 0) & (edge < len(self.buf))]
        first[edge] |= ink[edge]
        last[edge - 1] |= ink[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, self.owner(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Start, end and text of every line (pieces between \n; an empty text has one empty line)."""
        cut = np.flatnonzero(self.buf == 0x0A)
        start = np.sort(np.concatenate([self.off[:-1], cut + 1]))
        # a text that ends in \n has an empty last line that starts where the next text does
        end = np.sort(np.concatenate([cut, self.off[1:]]))
        before = np.searchsorted(cut, self.off[:-1], side="left")
        per = np.diff(np.append(before, len(cut))) + 1
        return start, end, np.repeat(np.arange(self.n), per)

    def prefix_hash(self, family: int = 0) -> np.ndarray:
        """``h[i]``: sum over the first i bytes of value * mult**position, modulo 2**64."""
        out = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        powers = _power_table(_MULT[family], len(self.buf) + 1)[: len(self.buf)]
        np.cumsum(_BYTE[family][self.buf] * powers, out=out[1:])
        return out

    @staticmethod
    def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes ``start:end``, the same wherever the span stands."""
        inv = _power_table(_INV[family], len(prefix))
        return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))

    @staticmethod
    def hash_without(prefix: np.ndarray, start, cut, after, end, family: int = 0) -> np.ndarray:
        """The span hash of the bytes ``start:cut`` followed by ``after:end``."""
        inv = _power_table(_INV[family], len(prefix))
        gap = (after - cut).astype(np.int64)
        raw = (prefix[cut] - prefix[start]) * inv[start] + (prefix[end] - prefix[after]) * inv[start + gap]
        return mix(raw + (end - start - gap).astype(np.uint64))

    def code_points(self) -> np.ndarray:
        """``c[i]``: code points among the first i bytes."""
        out = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out


def window_hash(word: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of ``size`` consecutive words of one text."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    acc = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        acc = mix(acc + word[at + k] + np.uint64(k + 1))
    return acc, at
