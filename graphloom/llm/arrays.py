"""Numpy kernels over UTF-8 buffers: words, character classes, hashes of words and windows, ragged arrays.

All hashes are 64-bit polynomials in an odd base with wrap-around, read off prefix sums, and mixed at the end, so a
window's hash costs two look-ups whatever its length.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that separate words: white space, and everything in ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit of x over all bits; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95))


@functools.lru_cache(1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 .. n, at least."""
    return _powers(max(1 << 18, 1 << int(n + 1).bit_length()))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base ** i, starting with 0."""
    up, _ = powers(len(values))
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], by the prefix sums."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0x9E6C63D0876A9A47))


def windows_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every values[i:i + size]."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, np.uint64)
    _, down = powers(len(sums))
    return mix((sums[size:] - sums[:n]) * down[:n] + U(size * 0x9E6C63D0876A9A47 & (1 << 64) - 1))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 word offsets of the texts. No word crosses texts."""
    inside = np.empty(len(data) + 1, bool)
    np.logical_not(separators[data], out=inside[:-1])
    inside[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= edge[1:] | ~inside[:-1]
    after = np.zeros(len(data) + 1, bool)
    after[1:] = inside[:-1] & (edge[1:] | ~inside[1:])
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(after), np.searchsorted(starts, offsets)


def words_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return spans_hash(prefix(_BYTE_VALUES[LOWER[data] if lower else data]), starts, ends)


def bytes_prefix(data: np.ndarray) -> np.ndarray:
    return prefix(_BYTE_VALUES[data])


def sliding(op: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """op over each ``width`` consecutive values, by doubling."""
    out, size = values, 1
    while size * 2 <= width:
        out = op(out[:-size], out[size:])
        size *= 2
    return op(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def anchors(hashes: np.ndarray, item_offsets: np.ndarray, window: int, size: int) -> np.ndarray:
    """Positions i whose hash (of ``size`` items from i) is the least in some window of ``window`` items of one text.

    Equal windows hold the same least hash at the same place, so every window that recurs contains an anchor that
    recurs; ties are all kept. hashes: of every ``size`` consecutive items, over the concatenated texts.
    """
    width = window - size + 1
    n = int(item_offsets[-1])
    if n < window:
        return np.empty(0, np.int64)
    least = sliding(np.minimum, hashes, width)
    starts = n - window + 1
    least = least[:starts]
    allowed = np.zeros(starts + 1, np.int32)  # a window may start from the text's start to its end - window
    lo, hi = item_offsets[:-1], item_offsets[1:] - window + 1
    some = hi > lo
    np.add.at(allowed, lo[some], 1)
    np.add.at(allowed, hi[some], -1)
    least = np.where(np.cumsum(allowed[:-1]) > 0, least, U(0))
    padded = np.zeros(starts + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + starts] = least
    most = sliding(np.maximum, padded, width)
    found = hashes[: len(most)] == most[: len(hashes)]
    return np.flatnonzero(found & (most[: len(found)] > 0))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. start + length - 1 of each pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    heads = np.cumsum(lengths) - lengths
    out[0] = starts[0]
    out[heads[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as sorted disjoint ones; touching ones are joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(starts) - 1]])
    return starts[new], ends[last]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of valid UTF-8: the code point of each character and the byte it starts at."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    if len(at) == len(data):
        return lead, at
    padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
    out = lead.copy()
    for most, least, bits, n in ((0xE0, 0xC0, 0x1F, 2), (0xF0, 0xE0, 0x0F, 3), (0x100, 0xF0, 0x07, 4)):
        here = np.flatnonzero((lead >= least) & (lead < most))
        if len(here):
            value = lead[here] & bits
            for k in range(1, n):
                value = (value << 6) | (padded[at[here] + k] & 0x3F)
            out[here] = value
    return out, at


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@functools.lru_cache(1)
def classes() -> np.ndarray:
    r"""Of every code point: \p{L}, \p{N}, \s or none of them."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            first, last = ord(m[0][0]), ord(m[0][-1])
            out[first : last + 1] = value if first >= 0xE000 or last < 0xD800 else out[first : last + 1]
            if first < 0xD800 and last >= 0xE000:
                out[first:0xD800] = value
                out[0xE000 : last + 1] = value
    return out
