"""Token-id output: flat unsigned integer files with 64-bit document offsets.

A shard covers a contiguous range of document ids and has three files: ``.bin`` holds the token
ids one after another (little-endian unsigned 16- or 32-bit), ``.off`` holds n + 1 unsigned 64-bit
offsets in tokens from the shard's start, ``.ids`` the document ids (signed 64-bit). A manifest
names the shards that committed tasks wrote; a shard's base, its first token's place in the whole
corpus, is the prefix sum of the token counts of the shards before it. Readers map the files into
memory, so a document is a slice without parsing.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evistrata.llm._chunks import ChunkCodes
from evistrata.llm._shared import materialise, new_folder, text_or_empty
from evistrata.llm._words import slices

#: Chunks kept by a worker, which bounds its memory (about 170 MB), and new chunks encoded at once.
MEMO_ENTRIES, BATCH_CHUNKS = 800_000, 20_000

MANIFEST = "shard int, path string, n_docs long, n_null_ids long, n_tokens long"

_chunk = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_other_space = re.compile(r"[^\S \t-\r]")  # white space outside ASCII
#: Texts where more than single spaces and newlines parts the words.
ODD = "[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_encoders: dict[tuple, ChunkEncoder] = {}


class ChunkEncoder(ChunkCodes):
    """Encodes whole texts with a ``tokenizers`` file.

    A byte-level BPE without normaliser never joins a non-space character with white space behind
    it, so a text's ids are those of its chunks (white space, then non-space) in a row. Texts with
    white space outside ASCII, and tokenizers of another kind, are encoded whole. A chunk stands
    behind a space, but for one that begins with a line break or that a carriage return marks.
    """

    entries = MEMO_ENTRIES

    def __init__(self, path: str, dtype: str) -> None:
        import json

        import tokenizers

        super().__init__()
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        stripping = any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens", []))
        self.by_chunk = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not stripping

    def odd(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_chunk else np.ones(len(texts), bool)

    def plain(self, texts: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), "")

    def keys(self, text: str) -> list[str]:
        if self.by_chunk and not _other_space.search(text):
            return ["\r" + x for x in _chunk.findall(text)]
        return ["\r" + text]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(chunks), BATCH_CHUNKS):
            own = [x if x[:1] == "\n" else x[1:] if x[:1] == "\r" else " " + x for x in chunks[at : at + BATCH_CHUNKS]]
            found = [x.ids for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * self.dtype.itemsize
            data = np.fromiter(chain.from_iterable(found), self.dtype).tobytes()  # an id beyond the type raises OverflowError
            out += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return out


def _encoder(path: str, dtype: str) -> ChunkEncoder:
    if (path, dtype) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path, dtype] = ChunkEncoder(path, dtype)
    return _encoders[path, dtype]


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where the store is a file system, else read."""
    fs, path = _store(uri)
    source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
    size = source.size()
    return np.frombuffer(source.read_buffer(size) if size else b"", dtype=dtype)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None, dtype: str = "uint16", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write shards under ``folder``; returns the manifest.

    Documents go in ascending id order, null ids first, repeated ids in order of a hash of their texts. A
    null text counts as empty and has only the end id. ``dtype`` is the file's unsigned type and
    must hold the largest id; a larger id raises OverflowError. Other columns are ignored. An
    attempt that fails leaves files that no manifest row names.
    """
    little = np.dtype(dtype).newbyteorder("<").str
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stem, sizes, ids, nulls, out = None, [], [], 0, None
        encoder = _encoder(tokenizer_path, little)
        store, top = _store(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                stem = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
                out = store.open_output_stream(f"{top}/{stem}.bin")
            for a, b in slices(batch.column(1)):
                counts, tokens = encoder.encode_array(batch.column(1).slice(a, b - a))
                if end_id is not None:
                    counts = counts + 1
                    last = np.zeros(len(tokens) + len(counts), bool)
                    last[np.cumsum(counts) - 1] = True
                    ended = np.full(len(last), end_id, little)
                    ended[~last] = tokens
                    tokens = ended
                out.write(tokens.tobytes())
                sizes.append(counts)
            nulls += batch.column(0).null_count
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        ends = np.cumsum(np.concatenate(sizes))
        for kind, data in (("off", np.concatenate([[0], ends]).astype("<u8")), ("ids", np.concatenate(ids))):
            with store.open_output_stream(f"{top}/{stem}.{kind}") as side:
                side.write(data.tobytes())
        row = ([TaskContext.get().partitionId()], [f"{folder}/{stem}"], [len(ends)], [nulls], [int(ends[-1])])
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["shard", "path", "n_docs", "n_null_ids", "n_tokens"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # The hash lets many texts under one id, or without one, be several shards.
    ordered = texts.withColumn("place", F.xxhash64("text")).repartitionByRange("doc_id", "place").sortWithinPartitions("doc_id", "place", "text").drop("place")
    return materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_bases(manifest: DataFrame) -> DataFrame:
    """Each shard's ``base``: the tokens of all shards before it. One row a shard, so one window is small."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, dtype: str = "uint16", with_tokens: bool = False) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens, ids_crc32 (and tokens).

    ``start`` counts the ids of all documents before it; the checksum is over little-endian
    unsigned 32-bit ids whatever type the file has. An empty manifest gives no rows.
    """
    little = np.dtype(dtype).newbyteorder("<").str
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<long>" * with_tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, offsets, ids = (_mapped(f"{row['path']}.{kind}", t) for kind, t in (("bin", little), ("off", "<u8"), ("ids", "<i8")))
                offsets = offsets.astype(np.int64)
                for at in range(0, len(ids), 2000):
                    cut = offsets[at : at + 2001]
                    own = ids[at : at + 2000]
                    null = np.arange(at, at + len(own)) < row["n_null_ids"]
                    docs = [tokens[a:b] for a, b in zip(cut[:-1], cut[1:])]
                    cols = [pa.array(own, mask=null), pa.array(cut[:-1] + row["base"]), pa.array(np.diff(cut)), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in docs], pa.int64())]
                    if with_tokens:
                        cols.append(pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "tokens"][: len(cols)])

    shards = max(1, manifest.count())
    return with_bases(manifest).repartitionByRange(shards, "shard").mapInArrow(read, schema)


def token_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, dtype: str = "uint16", with_tokens: bool = False) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    spark: SparkSession = docs.sparkSession
    manifest = write_token_files(docs, new_folder(spark, "tokens"), tokenizer_path, end_id, dtype)
    return read_token_files(manifest, dtype, with_tokens)
