"""SentencePiece encoding by suffix-array matching, and decoding.

The distinct chunks of a batch (a run of spaces and what follows up to the next space) are
concatenated and their suffixes sorted by as many characters as the longest piece has. Binary
search gives every piece its range of occurrences; all occurrences, sorted by where they end, are
the edges of a lattice, and relaxing them from left to right yields the segmentation.

The model merges pieces in pairs, best first, so an edge relaxes by the model's own rule and not
by a sum of scores: it extends the segmentation up to its start if the last piece there and its
own piece stay apart when merged anew. That holds for exactly one edge into each position, and
chosen so the result equals the merging of the whole chunk. Verdicts on pairs of pieces are kept.
No piece has a space behind another character, so chunks never share a piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm._chunks import ChunkCodes
from evistrata.llm._shared import text_or_empty
from evistrata.llm._tasks import concat_ranges, record, tidy
from evistrata.llm._words import SMALL_SLICE_BYTES, slices

SPACE = "▁"
#: Chunks and pair verdicts kept by a worker, and characters in one suffix array; all bound its memory.
MEMO_ENTRIES, PAIR_ENTRIES, BATCH_CHARS = 150_000, 250_000, 150_000

_chunk = re.compile(" *[^ ]+| +")
_codecs: dict[str, Codec] = {}


class Codec(ChunkCodes):
    """One model's pieces, with the lattice and the decoder on them.

    A chunk stands behind a space, but for one that a carriage return marks. A line break is a
    chunk where it is in no piece, as nothing is merged across it.
    """

    entries = MEMO_ENTRIES

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("  Å ﬁ  x ") != "▁▁▁Å▁ﬁ▁▁x▁":
            raise ValueError("only models that keep texts as they are, with a space before, are read here")
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(len(self.pieces))]
        self.rank = {p: (-model.get_score(i), i) for i, p in enumerate(self.pieces) if not special[i]}
        self.id = {p: i for p, (_, i) in self.rank.items()}
        if len(self.pieces) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits; the model has more pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space behind another character")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.data = pa.array([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.encode() for i, p in enumerate(self.pieces)], pa.binary())
        letters = sorted({c for p in self.id for c in p})
        if len(letters) >= (1 << 16) - 1:
            raise ValueError("letters are kept in 16 bits; the model has more")
        self.by_line = "\n" not in letters
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.longest = max(map(len, self.id))
        order = sorted(self.id)
        self.piece_ids = np.array([self.id[p] for p in order], np.int64)
        self.piece_sizes = np.array([len(p) for p in order], np.int64)
        rows = np.zeros((len(order), -(-self.longest // 4) * 4), np.uint16)
        for row, piece in zip(rows, order):
            row[: len(piece)] = np.searchsorted(self.letters, [ord(c) for c in piece]) + 1
        self.low = self._keys(rows)
        high = rows.copy()
        high[np.arange(rows.shape[1])[None, :] >= self.piece_sizes[:, None]] = 0xFFFF
        self.high = self._keys(high)
        self.verdicts: dict[int, bool] = {}
        self.size = len(self.pieces) + 1

    @staticmethod
    def _keys(rows: np.ndarray) -> np.ndarray:
        """Rows of 16-bit letters as fixed-size byte strings in the same order."""
        data = np.ascontiguousarray(rows.astype(">u2"))
        return data.view(f"S{data.shape[1] * 2}").ravel()

    def _merge(self, text: str) -> list[str]:
        """The model's own merging of a short text: the best pair first, the leftmost of equals."""
        parts = list(text)
        worst = (float("inf"), 0)
        costs = [self.rank.get(a + b, worst)[0] for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) < worst[0]:
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            for j in (i - 1, i):
                if 0 <= j < len(costs):
                    costs[j] = self.rank.get(parts[j] + parts[j + 1], worst)[0]
        return parts

    def _apart(self, keys: np.ndarray) -> np.ndarray:
        """For pairs left * size + right: whether they stay apart; left ``size - 1`` asks for the right alone."""
        distinct, back = np.unique(keys, return_inverse=True)
        names = distinct.tolist()
        known = list(map(self.verdicts.get, names))
        if len(self.verdicts) >= PAIR_ENTRIES:
            self.verdicts.clear()
        for k in [k for k, x in enumerate(known) if x is None]:
            left, right = divmod(names[k], self.size)
            own = [self.pieces[right]] if left == self.size - 1 else [self.pieces[left], self.pieces[right]]
            known[k] = self.verdicts[names[k]] = self._merge("".join(own)) == own
        return np.array(known, bool)[back]

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every occurrence of every piece in the letters ``text`` (0: in no piece)."""
        width = -(-self.longest // 4) * 4
        long = np.concatenate([text, np.zeros(width, np.uint16)])
        windows = np.lib.stride_tricks.sliding_window_view(long, width)[: len(text)]
        packed = [np.zeros(len(text), np.uint64) for _ in range(width // 4)]
        for j in range(width):
            packed[j // 4] |= windows[:, j].astype(np.uint64) << np.uint64(16 * (3 - j % 4))
        suffixes = np.lexsort(packed[::-1])
        keys = np.ascontiguousarray(np.stack([p[suffixes] for p in packed], axis=1).astype(">u8")).view(f"S{width * 2}").ravel()
        first, last = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        count = last - first
        at = suffixes[concat_ranges(first, count)]
        return at, np.repeat(self.piece_sizes, count), np.repeat(self.piece_ids, count)

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, their spaces as ``SPACE``."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        text = np.where(self.letters[place] == points, place + 1, 0).astype(np.uint16)
        start, length, piece = self._edges(text)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        of = np.repeat(np.arange(len(chunks)), sizes)
        inside = start + length <= ends[of[start]]
        start, length, piece = start[inside], length[inside], piece[inside]
        alien = np.flatnonzero(text == 0)  # characters without a piece: bytes, and a bar to merging
        none = self.size - 1
        start = np.concatenate([start, alien])
        length = np.concatenate([length, np.ones(len(alien), np.int64)])
        piece = np.concatenate([piece, np.full(len(alien), none)])
        level = start + length - begins[of[start]]
        order = np.argsort(level, kind="stable")
        start, length, piece, level = start[order], length[order], piece[order], level[order]
        cuts = np.searchsorted(level, np.arange(1, sizes.max(initial=0) + 2))
        last = np.full(len(points) + 1, -1, np.int64)  # the last piece of the segmentation up to and with a character
        before = np.zeros(len(points) + 1, np.int64)
        first_in = np.zeros(len(points) + 1, bool)
        first_in[begins] = True
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, n, p = start[a:b], length[a:b], piece[a:b]
            head = first_in[s]
            left = np.where(head, none, last[s - 1])
            open_ = left >= 0
            keep = open_ & (p == none)
            test = np.flatnonzero(open_ & (p != none))
            keep[test] = self._apart(left[test] * self.size + p[test])
            s, n, p = s[keep], n[keep], p[keep]
            last[s + n - 1] = p
            before[s + n - 1] = s
        pieces: list[list[np.ndarray]] = []
        who = np.flatnonzero(sizes)
        at = ends[who] - 1
        while len(at):
            pieces.append([who, last[at], before[at]])
            at = before[at] - 1
            more = at >= begins[who]
            at, who = at[more], who[more]
        owner, found, where = (np.concatenate(x) for x in zip(*pieces)) if pieces else (np.zeros(0, np.int64),) * 3
        order = np.lexsort((where, owner))
        owner, found, where = owner[order], found[order], where[order]
        bounds = np.searchsorted(owner, np.arange(len(chunks) + 1))
        strange = np.zeros(len(chunks), bool)
        strange[owner[found == none]] = True
        ids = found.astype("<u2").tobytes()
        out = [ids[2 * a : 2 * b] for a, b in zip(bounds[:-1], bounds[1:])]
        for k in np.flatnonzero(strange):
            own = []
            for p, w in zip(found[bounds[k] : bounds[k + 1]], where[bounds[k] : bounds[k + 1]]):
                own += [int(p)] if p != none else [self.bytes[b] for b in chr(points[w]).encode("utf-8", "surrogatepass")]
            out[k] = np.array(own, "<u2").tobytes()
        return out

    def odd(self, texts: pa.Array) -> np.ndarray:
        return pc.match_substring_regex(texts, "^$|^ |  |\r").to_numpy(zero_copy_only=False)

    def plain(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring(texts, "\n", " \r\n \r") if self.by_line else texts

    def keys(self, text: str) -> list[str]:
        return ["\r" + x for x in _chunk.findall(" " + text)] if text else []

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        own: list[str] = []
        size = 0
        for x in chunks:
            own.append(x[1:].replace(" ", SPACE) if x[:1] == "\r" else SPACE + x)
            size += len(x) + 1
            if size >= BATCH_CHARS:
                out += self._encode_chunks(own)
                own, size = [], 0
        return out + self._encode_chunks(own)

    def decode_array(self, counts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The text of each row of ids: pieces joined, bytes as UTF-8 (broken ones as U+FFFD), the first space off."""
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        data = pc.replace_substring(pc.binary_join(pa.ListArray.from_arrays(offsets, self.data.take(pa.array(ids))), b""), SPACE.encode(), b" ")
        try:
            text = data.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([x.decode("utf-8", "replace").replace(SPACE, " ") for x in data.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(text, " "), pc.utf8_slice_codeunits(text, 1), text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of one row of ids."""
        return self.decode_array(np.array([len(ids)]), ids)[0].as_py()


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_pieces, ids, columns of ``keep``) of every whole text.

    A null text counts as empty and has no ids. Texts that hold the space sign U+2581 itself are
    encoded as the model does, which takes it for a space. Repeated rows give equal results.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for a, b in slices(batch.column(1), SMALL_SLICE_BYTES):
                part = batch.slice(a, b - a)
                counts, ids = own.encode_array(pc.replace_substring(part.column(1), SPACE, " "))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield record(id=part.column(0), n_pieces=counts, ids=lists, **{c: part.column(c) for c in keep})

    kinds = dict(docs.dtypes)
    schema = "id long, n_pieces long, ids array<int>" + "".join(f", {c} {kinds[c]}" for c in keep)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *keep)
    return texts.mapInArrow(tidy(rows), schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ids; null and empty ids give an empty text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            ids = batch.column(1)
            counts = pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False)
            yield record(id=batch.column(0), text=own.decode_array(counts, ids.flatten().to_numpy(zero_copy_only=False)))

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(rows), "id long, text string").withColumnRenamed("id", id_col)


def codec_report(docs: DataFrame, model_path: str) -> DataFrame:
    """One row a document: doc_id, n_pieces, ids_crc32, text_sha256 of the decoded text, round_trip.

    The checksum is over the ids as little-endian unsigned 32-bit integers. ``round_trip`` tells
    whether decoding gave the text back (with U+2581 as a space); null texts count as empty, and
    repeated rows have equal results.
    """
    import hashlib

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for a, b in slices(batch.column(1), SMALL_SLICE_BYTES):
                texts = pc.replace_substring(batch.column(1).slice(a, b - a), SPACE, " ")
                counts, ids = own.encode_array(texts)
                back = own.decode_array(counts, ids)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                yield record(
                    doc_id=batch.column(0).slice(a, b - a),
                    n_pieces=counts,
                    ids_crc32=pa.array([zlib.crc32(wide[x:y].tobytes()) for x, y in zip(ends - counts, ends)], pa.int64()),
                    text_sha256=pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in pc.cast(back, pa.binary())], pa.string()),
                    round_trip=pc.equal(texts, back),
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return texts.mapInArrow(tidy(rows), "doc_id long, n_pieces long, ids_crc32 long, text_sha256 string, round_trip boolean")
