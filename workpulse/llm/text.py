"""Words and shingles of many texts at once, as numpy arrays over their UTF-8 bytes.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. A word's value is made of its bytes alone, so equal words
have equal values wherever they stand; a shingle's value mixes those of its words. Up to `PIECE` bytes are a polynomial modulo 2**64,
which is then mixed. Longer polynomials modulo a power of two would be equal for some regular words whatever their base, such as a
Thue-Morse word of 1024 bytes and its complement; so a longer word is cut into pieces, each mixed together with its place, and these are added up.
Two different words or shingles then share a value with a chance of about 2**-64 a pair, regular words of one piece with 2**-51.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 16  # bytes of a word that one polynomial takes
SLICE = 1 << 19  # bytes of text worked on at once; a longer text is a slice of its own
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])  # white space and all other signs of ASCII
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z count as a-z
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, U64), _BACK: np.ones(1, U64)}


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; grown by doubling and kept."""
    have = _powers.setdefault(base, np.ones(1, U64))
    while len(have) < count:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:count]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def tidy(rows):
    """A function over batches that gives the memory of its batches back when its task ends; workers live on for other tasks."""

    def done(batches):
        yield from rows(batches)
        pa.default_memory_pool().release_unused()

    return done


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE, texts: int = 8192):
    """Runs ``i, j`` of at most ``texts`` texts with at most ``most`` bytes together, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1), i + texts)
        yield i, j
        i = j


def parts(column, most: int = SLICE, texts: int = 8192):
    """``i, j, data, offsets`` of each slice of a string column."""
    data, offsets = utf8(column)
    for i, j in slices(offsets, most, texts):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the index of each text's first word (with the count at the end).

    ``between`` marks the bytes that part words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """One 64-bit value for each word; with ``fold``, A-Z count as a-z."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * powers(_BASE, len(data)), out=sums[1:])
    back, sizes = powers(_BACK, len(data) + 1), ends - starts
    out = mixed((sums[ends] - sums[starts]) * back[starts] + sizes.astype(U64))
    long = np.flatnonzero(sizes > PIECE)
    if len(long):
        counts = -(-sizes[long] // PIECE)
        firsts = np.cumsum(counts) - counts
        place = np.arange(int(counts.sum())) - np.repeat(firsts, counts)
        begin = np.repeat(starts[long], counts) + place * PIECE
        end = np.minimum(begin + PIECE, np.repeat(ends[long], counts))
        pieces = (sums[end] - sums[begin]) * back[begin]
        together = np.add.reduceat(mixed(pieces + mixed(place.astype(U64) + U64(1))), firsts)
        out[long] = mixed(together + sizes[long].astype(U64))
    return out


def shingles(values: np.ndarray, firsts: np.ndarray, size: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Values of all runs of ``size`` words within a text, and the index of each text's first one.

    With ``whole``, a text with fewer words, but at least one, gives its whole sequence as its only shingle.
    """
    counts = np.diff(firsts)
    many = np.maximum(counts - size + 1, 0)
    short = (many == 0) & (counts > 0) & whole
    places = np.concatenate([[0], np.cumsum(many + short)])
    if not len(values):
        return np.zeros(0, U64), places
    chained = np.zeros(len(values), U64)
    for k in range(min(size, len(values))):
        factor = U64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        chained[: len(values) - k] += values[k:] * factor
    out = np.empty(places[-1], U64)
    owner = np.repeat(np.arange(len(counts)), many)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out[places[owner] + within] = mixed(chained[firsts[owner] + within] + U64(size))
    for d in np.flatnonzero(short):
        run = values[firsts[d] : firsts[d + 1]]
        factors = powers(0xD6E8FEB86659FD93, len(run) + 1)[1:]
        out[places[d] : places[d] + 1] = mixed((run * factors).sum(keepdims=True, dtype=U64) + U64(len(run)))
    return out, places
