"""Whole texts as arrays of word hashes, by Arrow and numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text handled at once, or by what needs a multiple of it; a longer text is a slice of its own.
SLICE_BYTES, SMALL_SLICE_BYTES = 8_000_000, 3_000_000


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (n + 1) and the words ``[^\\x20\\x09-\\x0D]+`` of each text; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words = lists.flatten()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():  # the one empty word of a text without words
        at = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        ends = np.cumsum(counts)
        counts = at[ends] - at[ends - counts]
        words = words.filter(full)
    return np.concatenate([[0], np.cumsum(counts)]), words


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    of = xxhash.xxh3_64_intdigest
    distinct = np.fromiter((of(x) for x in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return distinct[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded size: ``most`` bytes of text, or one longer text."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
        yield at, to
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of codes[i:i+k] for each i up to len - k, order-sensitive."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n] + np.uint64(j + 1))
    return out
