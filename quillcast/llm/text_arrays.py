"""Words and their hashes for whole Arrow batches of text, with numpy and without a loop over words.

Texts are handled as UTF-8 bytes. All word classes of the contracts split at ASCII bytes only, so a
byte table decides for each byte whether it belongs to a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _table(codes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(codes)] = True
    return t


#: Bytes of words split at white space, and of words of letters, digits and non-ASCII characters.
NOT_SPACE = ~_table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random word for each byte at each of 64 places: the sum over a word is a hash by tabulation.
PLACES = _RNG.integers(0, 2**64, (64, 256), np.uint64).reshape(-1)
FAR = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]] if len(col) and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES):
    """(first, end) rows with about `most` bytes of text; a longer text is a slice of its own."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def word_bounds(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the number of the first word, with the total last."""
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offs[:-1][offs[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    last = offs[1:-1]
    last = last[(last > 0)] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    place = np.arange(int(first[-1] + lens[-1]), dtype=np.int64)
    at = place + np.repeat(starts - first, lens)
    place -= np.repeat(first, lens)
    byte = data[at].astype(np.int64)
    if int(lens.max()) <= 64:
        part = PLACES[(place << 8) | byte]
    else:
        part = PLACES[((place & 63) << 8) | byte]
        long = place >= 64
        part[long] = mix(part[long] + FAR * (place[long] >> 6).astype(np.uint64))
    return mix(np.add.reduceat(part, first) + FAR * lens.astype(np.uint64))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; shorter by n - 1 than `hashes`."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = hashes[:m].copy()
    for k in range(1, n):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x += hashes[k : k + m]
        x ^= x >> np.uint64(32)
    return mix(x + np.uint64(n))
