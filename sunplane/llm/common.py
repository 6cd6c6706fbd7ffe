"""Shared pieces of the text operators: byte-level word hashing in numpy, and marks of rows.

A *word* of the shingle operators is a maximal run of ASCII letters, ASCII digits and code points from
U+0080 up, lower-cased; ASCII punctuation and white space separate words. A text with at least one word but
fewer words than a shingle has one shingle, made of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that the numpy kernels take at once; their scratch memory is about 60 times this.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch that are copied at once.
SLICE_ROWS = 1024

_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Separator bytes of the two word definitions.
WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def in_batches(df: DataFrame) -> DataFrame:
    """df, after its session's Arrow batches are set to 8 MB if they are at Spark's default of 64 MB: long texts then
    take little memory outside the heap and in the Python workers."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "64m").lower() in ("64m", "64mb", "67108864", "67108864b"):
        conf.set(key, "8m")
    return df


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of each uint64."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


#: The bits of a block of which only so many bytes count.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte ranges in blocks of eight bytes, zeros after a range's end: the blocks of all ranges one after the other,
    the place of each in its range, and the first block of each range (one more entry than there are ranges)."""
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(-(-sizes // 8))])
    place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    at = np.repeat(starts, np.diff(first)) + 8 * place
    words = np.frombuffer(data.tobytes() + bytes(16 - len(data) % 8), "<u8")
    k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
    blocks = (words[k] >> shift) | ((words[k + 1] << (np.uint64(63) - shift)) << np.uint64(1))
    blocks &= _LOW[np.minimum(np.repeat(sizes, np.diff(first)) - 8 * place, 8)]
    return blocks, place, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each group of values, modulo 2^64; first: the first value of each group, and the end."""
    out, full = np.zeros(len(first) - 1, np.uint64), np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full])
    return out


def list_hashes(values: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each group of uint64 values in order. Every value is mixed with its place before the values are
    added, so no structure of the values makes sums meet, as it does for polynomials modulo a power of two."""
    mixed = mix(mix(values + _M1) ^ mix((place.astype(np.uint64) + np.uint64(1)) * _STEP))
    return mix(_sums(mixed, first) ^ (np.diff(first).astype(np.uint64) * _M2))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range [start, end) of data, equal for equal ranges wherever they lie."""
    h = list_hashes(*_blocks(data, starts, ends))
    return mix(h ^ ((ends - starts).astype(np.uint64) * _STEP))


def same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the byte ranges numbered left[k] and right[k] hold the same bytes."""
    out = (ends - starts)[left] == (ends - starts)[right]
    pairs = np.flatnonzero(out)
    a, _, first = _blocks(data, starts[left[pairs]], ends[left[pairs]])
    b, _, _ = _blocks(data, starts[right[pairs]], ends[right[pairs]])
    out[pairs[_sums((a != b).astype(np.uint64), first) > 0]] = False
    return out


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in the class `inside`, none across the text bounds: starts, ends, and for each
    text the index of its first run (one more entry than there are texts)."""
    m = inside[data]
    before = np.empty_like(m)
    before[:1], before[1:] = False, m[:-1]
    after = np.empty_like(m)
    after[-1:], after[:-1] = False, m[1:]
    cuts = bounds[:-1][bounds[:-1] < len(data)]
    before[cuts] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def text_chunks(texts: pa.Array, lower: bool = False, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a string column of about `size` bytes: first row, end row, their bytes, and row bounds in them.
    Nulls count as empty. A single longer text forms a slice of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for first in range(0, len(texts), SLICE_ROWS):  # so that copies stay small
        part = pc.fill_null(texts.slice(first, SLICE_ROWS).cast(pa.large_string()), "")
        if lower:
            part = pc.utf8_lower(part)
        _, offsets, data = part.buffers()
        offsets = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
            end = min(end, len(part))
            yield first + row, first + end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


_SHIFT = mix(np.arange(1, 65, dtype=np.uint64) * _STEP) | np.uint64(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * _SHIFT[j]
    return mix(total)


def doc_shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row and its shingle hashes in text order, repeats included; none for a text without words."""
    for row, end, data, bounds in text_chunks(texts, lower=True):
        starts, ends, first = runs(data, bounds, ALNUM)
        words = run_hashes(data, starts, ends)
        every = windows(words, width)
        for i in range(end - row):
            a, b = first[i], first[i + 1]
            yield row + i, every[a : b - width + 1] if b - a >= width else windows(words[a:b], b - a) if b > a else every[:0]


def set_similar(common, left, right, threshold: tuple[int, int]):
    """Whether sets of `left` and `right` members with `common` shared have a Jaccard similarity of at least
    threshold[0] / threshold[1], in whole numbers."""
    return common * threshold[1] >= threshold[0] * (left + right - common)
