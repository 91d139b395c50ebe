"""Word and shingle hashing over UTF-8 bytes with numpy.

Texts are handled one at a time, so memory follows the longest text. Separators are
ASCII bytes, hence word borders in bytes and in code points agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def _lut(chars: bytes, keep: bool) -> np.ndarray:
    out = np.full(256, not keep)
    out[np.frombuffer(chars, np.uint8)] = keep
    return out


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text: digits, a-z, all above ASCII.
ALNUM = _lut(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]), True)
#: Words [^\x20\x09-\x0D]+.
SPACED = _lut(b"\x20\x09\x0a\x0b\x0c\x0d", False)
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = 0x9E3779B97F4A7C15 | 1
_POW = {1: np.ones(1, U64), -1: np.ones(1, U64)}
_BASE = {1: _MUL, -1: pow(_MUL, -1, 1 << 64)}


def _powers(sign: int, n: int) -> np.ndarray:
    if len(_POW[sign]) < n:
        seq = np.full(max(n, 1 << 15), _BASE[sign], U64)
        seq[0] = 1
        _POW[sign] = np.cumprod(seq, dtype=U64)
    out = _POW[sign][:n]
    if len(_POW[sign]) > 1 << 21:  # after a very long text, let the table go again
        _POW[sign] = _POW[sign][: 1 << 15].copy()
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def spans(u8: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    if not len(u8):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flag = np.zeros(len(u8) + 2, np.int8)
    flag[1:-1] = lut[u8]
    edge = np.flatnonzero(flag[1:] != flag[:-1])
    return edge[::2], edge[1::2]


def hashes(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.empty(0, U64)
    n = len(u8)
    total = np.zeros(n + 1, U64)
    np.cumsum((u8.astype(U64) + U64(1)) * _powers(1, n), out=total[1:])
    raw = (total[ends] - total[starts]) * _powers(-1, n)[starts]
    return mix(raw ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(u8: np.ndarray, lut: np.ndarray) -> np.ndarray:
    return hashes(u8, *spans(u8, lut))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of n neighbours."""
    if len(h) < n:
        return np.empty(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out = out * U64(0x2545F4914F6CDD1D) + h[k : len(h) - n + 1 + k]
    return mix(out)


def shingles(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles; the whole sequence if it is shorter; none if empty."""
    if len(h) >= n:
        return np.unique(windows(h, n))
    return windows(h, len(h)) if len(h) else h


def texts(batch: pa.RecordBatch, name: str = "text"):
    """The UTF-8 bytes of each row as uint8; null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = pc.fill_null(col, "") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] else np.empty(0, np.uint8)
    for i in range(len(col)):
        yield data[offs[i] : offs[i + 1]]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
