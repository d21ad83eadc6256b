"""Words of a column of texts as numpy arrays, taken straight from Arrow's UTF-8 bytes.

A word is a longest run of bytes that are not separators. Separators are ASCII, so runs of bytes
are runs of code points. A-Z are lower-cased; nothing else is. A word is named by a 64-bit hash of
its bytes. Hashes are a chain of mixing steps, in which no two texts are known to collide; no polynomial, whose values collide for
texts of a known form whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd
SEED = 0x51ED270B9F1A2C83
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SPACES = np.ones(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = False
#: Words [^\x20\x09-\x0D]+
NOT_SPACE = _SPACES

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[65:91] = _ALNUM[128:] = True
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM = _ALNUM


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of documents of about so many bytes; a longer document is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = j


def spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each document (n + 1 numbers)."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = is_word[raw]
    edge = np.empty(n + 1, dtype=bool)
    edge[1:n] = w[1:] != w[:-1]
    edge[0] = edge[n] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = w[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


#: Longer words are hashed one by one
LONG_WORD = 1024


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word raw[start:end], lower-cased with fold: eight bytes at a time go through a mixer that is not linear."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = LOWER[raw] if fold else raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    with np.errstate(over="ignore"):
        h = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(SEED))
        live, done = np.flatnonzero(size <= LONG_WORD), 0
        while len(live):
            left = size[live] - done
            part = eight[starts[live] + done]
            short = left < 8
            part[short] &= (U64(1) << (U64(8) * left[short].astype(U64))) - U64(1)
            h[live] = mix((h[live] ^ part) * U64(BASE) + U64(1))
            done += 8
            live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes(), SEED)
    return h


def mix_light(h: np.ndarray) -> np.ndarray:
    """The upper 32 bits of a multiply-shift hash."""
    return (h >> U64(32)).astype(np.uint32)


def one_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def hashed_words(column: pa.Array, is_word: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, bounds): documents [first, last), their words' hashes, and the first word of each."""
    raw, off = text_bytes(column)
    for i, j in chunks(off, size):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, bounds = spans(part, o, is_word)
        yield i, j, word_hashes(part, starts, ends), bounds


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words in each document, and the first one of each.

    A document of fewer words, but not none, has its whole sequence as one.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1], count) + np.repeat(bounds[:-1], count)
    size = np.repeat(np.minimum(n, k), count)
    s = size.astype(U64) * U64(0xA24BAED4963EE407)
    with np.errstate(over="ignore"):
        for i in range(k):
            more = size > i
            if more.all():
                s = mix(s * U64(3) + h[at + i])
            else:
                s[more] = mix(s[more] * U64(3) + h[at[more] + i])
    return s, out


def code_point_starts(raw: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (raw & 0xC0) != 0x80
