"""Encoding of whole texts by their distinct chunks, for use inside tasks."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evistrata.llm._tasks import concat_ranges

#: Characters of the longest chunk whose ids are kept.
MEMO_CHARS = 40


class ChunkCodes:
    """Ids of texts as those of their chunks in a row, each distinct chunk of a slice encoded once.

    Plain texts are rewritten so that chunks stand between single spaces, odd ones are cut in
    Python. The ids of the chunks met first are kept, as those are mostly the frequent ones;
    ``entries`` bounds how many.
    """

    dtype = np.dtype("<u2")
    entries = 0

    def __init__(self) -> None:
        self.memo: dict[str, bytes] = {}

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Texts that ``plain`` cannot rewrite."""
        raise NotImplementedError

    def plain(self, texts: pa.Array) -> pa.Array:
        """Texts with their chunks between single spaces."""
        raise NotImplementedError

    def keys(self, text: str) -> list[str]:
        """The chunks of an odd text."""
        raise NotImplementedError

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        raise NotImplementedError

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Of each text the first and the number of its chunks, and all chunks."""
        odd = self.odd(texts)
        split = pc.split_pattern(self.plain(texts.filter(pa.array(~odd))), " ")
        keys = [self.keys(x) for x in texts.filter(pa.array(odd)).to_pylist()]
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = split.value_lengths().to_numpy(zero_copy_only=False)
        counts[odd] = np.fromiter(map(len, keys), np.int64, len(keys))
        order = np.argsort(odd, kind="stable")
        starts = np.zeros(len(texts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return starts, counts, pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(keys)), pa.string())])

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids in a row."""
        starts, counts, chunks = self._split(texts)
        coded = pc.dictionary_encode(chunks)
        keys = coded.dictionary.to_pylist()
        found = list(map(self.memo.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self.encode_chunks([keys[i] for i in new])):
            found[i] = x
        for i in new[: max(0, self.entries - len(self.memo))]:
            if len(keys[i]) <= MEMO_CHARS:
                self.memo[keys[i]] = found[i]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(found), self.dtype)
        codes = coded.indices.to_numpy(zero_copy_only=False)[concat_ranges(starts, counts)]
        own = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(counts)])]
        return np.diff(ends), flat[concat_ranges((np.cumsum(sizes) - sizes)[codes], own)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        counts, ids = self.encode_array(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip(ends - counts, ends)]
