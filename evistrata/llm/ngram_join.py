"""N-gram Jaccard join by groups of equal prefixes, and the components of its links.

A document is its set of word shingles. Two sets with ``percent`` of Jaccard similarity share one
of their first n - ceil(percent * n / 100) + 1 shingles in any common order. The order here puts shingles
of one document first, then those of a few, then those of many, and within each kind goes by hash;
so a shared passage brings candidates only where hardly anything else is in a text.

- Equal sets are one class. Classes with equal prefixes and sizes are one group, and only groups
  are listed by shingle, paired and filtered by size and by the places of the shared shingle.
- A parity sketch has a bit for each of 512 buckets: whether an odd number of a set's shingles falls
  into it. Two sketches differ in at most as many bits as the sets have different shingles, so a
  pair whose sketches differ in too many bits cannot link, and no other pair is dropped by it. A
  group is compared in the bits that all its classes have in common.
- A first pass over the hashes alone finds the shingles that stand in two prefixes or more; only
  their places, with sketches, are shuffled to lists.
- First every list is a star: the group nearest to the majority of the list's sketches, as an
  original is among its edited copies, against the others. Pairs are expanded to class
  representatives, filtered by sketches and verified on the texts; the links give components.
- Then the pairs of a list are formed between different components only, expanded to all member
  classes in blocks inside a task, filtered by the classes' own sketches, and verified too. Pairs
  inside a component can no longer change the result. So a group of near copies costs a star, not
  its square, and no link between different texts is lost.

Classes are known by 128-bit keys. Groups have 64-bit keys, under which two groups would only be
compared together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import clean, discard, materialise, text_or_empty
from evistrata.llm._tasks import column, concat_ranges, key_chunks, record, tidy
from evistrata.llm._words import SMALL_SLICE_BYTES, gram_hashes, hashed, mixed, slices, split_words
from evistrata.operators.graph import connected_components

#: Hashes in a bitmap have MARK_LOAD bits each, between these powers of two in all (128 MB at most, sent to every executor). A full one only costs time.
MARK_LOAD, MARK_BITS = 16, (16, 30)
#: A shingle in so many documents is common and comes last in the order.
COMMON_DOCS = 50
#: At most so many common shingles are told apart (8 bytes each, sent to every executor); the rest only cost time.
COMMON_MAX = 1_000_000
#: Postings that a task holds at once, but for a longer list.
LIST_ROWS = 50_000
#: Member classes of a group that are compared at once.
BLOCK = 128
#: Bits of a parity sketch.
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and the ascending distinct shingle hashes of each text.

    A-Z count as a-z. A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    offsets, found = split_words(pc.ascii_lower(texts))
    codes = hashed(found)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(codes, words)
    inside = doc[: len(grams)] == doc[words - 1 :] if len(grams) else np.zeros(0, bool)
    of, hashes = [doc[: len(grams)][inside]], [grams[inside]]
    for length in range(1, words):
        short = np.flatnonzero(n == length)
        acc = np.zeros(len(short), np.uint64)
        for j in range(length):
            acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + codes[offsets[short] + j] + np.uint64(j + 1))
        of.append(short)
        hashes.append(mixed(acc + np.uint64(length)))
    of, hashes = np.concatenate(of), np.concatenate(hashes)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])) if len(of) else np.zeros(0, bool)
    of, hashes = of[new], hashes[new]
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(n)))]).astype(np.int64), hashes


def set_keys(offsets: np.ndarray, hashes: np.ndarray) -> pa.Array:
    """A 128-bit key of each set."""
    of = xxhash.xxh3_128_digest
    return pa.array([of(hashes[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def _firsts(keys: pa.Array) -> np.ndarray:
    """The place of each distinct key's first row."""
    return np.unique(pc.dictionary_encode(keys).indices.to_numpy(zero_copy_only=False), return_index=True)[1]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _document_frequencies(words: int, percent: int):
    """Shingles and their document counts, over twice the prefix in hash order, where common ones matter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), SMALL_SLICE_BYTES):
                offsets, hashes = shingle_sets(batch.column("text").slice(a, b - a), words)
                first = _firsts(set_keys(offsets, hashes))
                n = np.diff(offsets)[first]
                shingle, count = np.unique(hashes[concat_ranges(offsets[first], np.minimum(n, 2 * prefix_length(n, percent)))], return_counts=True)
                yield record(shingle=shingle.view(np.int64), n=count)

    return rows


def _bitmap(df: DataFrame, name: str) -> np.ndarray:
    """A bit for each hash in a column of a written table."""
    size = min(max(MARK_BITS[0], int(MARK_LOAD * df.count()).bit_length()), MARK_BITS[1])
    word = F.shiftright(F.col(name).bitwiseAND((1 << size) - 1), 6)
    bits = df.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({name} & 63 AS int))")).alias("bits")).toArrow()  # at most 2 ** (size - 6) rows of 16 bytes
    out = np.zeros(1 << (size - 6), np.uint64)
    out[column(bits, "word")] = column(bits, "bits").view(np.uint64)
    return out


def _marked(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hash_filter(keys: DataFrame, name: str):
    """A function on a column of hashes: true for all that the written table ``keys`` has in column ``name``, and for a few others."""
    marks = keys.sparkSession.sparkContext.broadcast(_bitmap(keys, name))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(_marked(hashes.to_numpy().view(np.uint64), marks.value))

    return maybe


def _maybe_wanted(marks):
    """Rows whose text's hash is marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(batch.column("text_key").to_numpy().view(np.uint64), marks.value)))

    return rows


def _levels(hashes: np.ndarray, shared: np.ndarray, common: np.ndarray) -> np.ndarray:
    """0 for shingles of one document as far as counted, 1 for those of a few, 2 for common ones."""
    level = _marked(hashes, shared).astype(np.int8)
    if len(common):
        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        level += common[place] == hashes
    return level


def _prefixes(words: int, percent: int, marks):
    """A row for each document: size and class key; for a class's first row in a slice, prefix and parity sketch too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, common = marks.value
        for batch in batches:
            for a, b in slices(batch.column("text"), SMALL_SLICE_BYTES):
                offsets, hashes = shingle_sets(batch.column("text").slice(a, b - a), words)
                n, keys = np.diff(offsets), set_keys(offsets, hashes)
                doc = np.repeat(np.arange(len(n)), n)
                level = _levels(hashes, shared, common)
                order = np.lexsort((level, doc))  # stable: by hash within a kind
                ordered = hashes[order]
                first = np.zeros(len(n), bool)
                first[_firsts(keys)] = True
                first &= n > 0
                sizes = np.where(first, prefix_length(n, percent), 0)
                flat = ordered[concat_ranges(offsets[:-1], sizes)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                places = np.bincount(doc * SKETCH_BITS + (hashes >> np.uint64(64 - 9)).astype(np.int64), minlength=len(n) * SKETCH_BITS)
                parity = np.packbits((places & 1).astype(np.uint8)).view(np.int64).reshape(len(n), SKETCH_WORDS)[first]
                ends = np.concatenate([[0], np.cumsum(first) * SKETCH_WORDS]).astype(np.int32)
                sketch = pa.ListArray.from_arrays(pa.array(ends), pa.array(parity.ravel()))
                yield record(doc_id=batch.column("doc_id").slice(a, b - a), text_key=batch.column("text_key").slice(a, b - a), n=n, class_key=keys, is_first=first, prefix=lists, sketch=sketch)

    return rows


def _may_link(n1: np.ndarray, i: np.ndarray, n2: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Sizes near enough, and enough left behind the shared shingle's places."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    most = np.minimum(n1 - i, n2 - j)
    return (100 * small >= percent * large) & ((100 + percent) * most >= percent * (n1 + n2))


def _sketches(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Sketches as rows of 64-bit integers."""
    flat = pc.list_flatten(col).to_numpy() if isinstance(col, pa.ChunkedArray) else col.flatten().to_numpy(zero_copy_only=False)
    return flat.view(np.uint64).reshape(len(col), -1)


def _alike(one: np.ndarray, two: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches leave room for a link of two sets with ``total`` shingles together; behind a group's bits are those that all its classes share."""
    differ = one[:, :SKETCH_WORDS] ^ two[:, :SKETCH_WORDS]
    if one.shape[1] > SKETCH_WORDS:
        differ &= one[:, SKETCH_WORDS:] & two[:, SKETCH_WORDS:]
    return (100 + percent) * np.bitwise_count(differ).sum(axis=1, dtype=np.int64) <= (100 - percent) * total


def _from_majority(sketches: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits in which each sketch differs from the majority of its list's."""
    away = np.zeros(len(sketches), np.int64)
    data = np.ascontiguousarray(sketches[:, :SKETCH_WORDS]).view(np.uint8)
    for at in range(data.shape[1]):
        bits = np.unpackbits(data[:, at : at + 1], axis=1)
        most = 2 * np.add.reduceat(bits, begin, axis=0, dtype=np.int64) > sizes[:, None]
        away += (bits != np.repeat(most, sizes, axis=0)).sum(axis=1)
    return away


def _postings(marks):
    """Of groups: a row for each place of a prefix whose shingle's hash is marked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            shingle = prefix.flatten().to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(_marked(shingle.view(np.uint64), marks.value))
            of, pos = np.repeat(np.arange(len(sizes)), sizes)[keep], concat_ranges(np.zeros(len(sizes), np.int64), sizes)[keep]
            for at in range(0, len(keep), LIST_ROWS):
                row = pa.array(of[at : at + LIST_ROWS])
                taken = {name: batch.column(name).take(row) for name in ("group_key", "n", "sketch")}
                yield record(shingle=shingle[keep[at : at + LIST_ROWS]], group_key=taken["group_key"], n=taken["n"], pos=pos[at : at + LIST_ROWS], sketch=taken["sketch"])

    return rows


def _lists(percent: int):
    """Of postings sorted by shingle: the entries of lists with two or more, and star pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_chunks(batches, LIST_ROWS):
            begin = np.append(True, column(table, "shingle")[1:] != column(table, "shingle")[:-1])
            sizes = np.diff(np.append(np.flatnonzero(begin), table.num_rows))
            many = table.filter(pa.array(np.repeat(sizes > 1, sizes)))
            if not many.num_rows:
                continue
            shingle, group, n, pos = (column(many, c) for c in ("shingle", "group_key", "n", "pos"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            sketches = _sketches(many["sketch"])
            yield record(shingle=shingle, a=group, b=group, n=n, pos=pos, is_pair=np.zeros(len(shingle), bool))
            sizes = sizes[sizes > 1]
            away = _from_majority(sketches, np.cumsum(sizes) - sizes, sizes)
            rest = np.lexsort((away, shingle))
            pairs = []
            while len(rest):  # each turn: the first entry left of every list is a centre
                head = np.append(True, shingle[rest][1:] != shingle[rest][:-1])
                at = rest[np.flatnonzero(head)][np.cumsum(head) - 1]
                near = 100 * np.minimum(n[at], n[rest]) >= percent * np.maximum(n[at], n[rest])
                good = near & (at != rest) & _may_link(n[at], pos[at], n[rest], pos[rest], percent)
                x, y = at[good], rest[good]
                fits = _alike(sketches[x], sketches[y], n[x] + n[y], percent)
                pairs.append(np.stack([group[x[fits]], group[y[fits]]], axis=1))
                rest = rest[~near]
            yield _pair_rows(pairs)

    return rows


def _pair_rows(pairs: list[np.ndarray]) -> pa.RecordBatch:
    found = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    found = found[found[:, 0] != found[:, 1]]
    found = np.unique(np.sort(found, axis=1), axis=0)
    zero = np.zeros(len(found), np.int64)
    return record(shingle=zero, a=found[:, 0].copy(), b=found[:, 1].copy(), n=zero, pos=zero, is_pair=np.ones(len(found), bool))


def _open_pairs(percent: int):
    """Of list entries with their groups' components: pairs that may link different components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_chunks(batches, LIST_ROWS):
            shingle, group, n, pos, label = (column(table, c) for c in ("shingle", "a", "n", "pos", "label"))
            mixed_group = table["mixed"].to_numpy().astype(bool)
            sketches = _sketches(table["sketch"])
            begin = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
            differs = np.append(False, (label[1:] != label[:-1]) & (shingle[1:] == shingle[:-1])) | mixed_group
            open_list = np.logical_or.reduceat(differs, begin)
            out: list[np.ndarray] = []
            for a, b in zip(begin[open_list], np.append(begin[1:], len(shingle))[open_list]):
                names, back, counts = np.unique(label[a:b], return_inverse=True, return_counts=True)
                major = (back == counts.argmax()) & ~mixed_group[a:b]
                others, main = a + np.flatnonzero(~major), a + np.flatnonzero(major)
                for at in range(0, len(others), 256):
                    own = others[at : at + 256]
                    for other in (others, main):
                        for to in range(0, len(other), 4_000):
                            far = other[to : to + 4_000]
                            x, y = np.repeat(own, len(far)), np.tile(far, len(own))
                            good = (x != y) & ((label[x] != label[y]) | mixed_group[x] | mixed_group[y])
                            x, y = x[good], y[good]
                            good = _may_link(n[x], pos[x], n[y], pos[y], percent)
                            x, y = x[good], y[good]
                            good = _alike(sketches[x], sketches[y], n[x] + n[y], percent)
                            if good.any():
                                out.append(np.stack([group[x[good]], group[y[good]]], axis=1))
                if sum(map(len, out)) > 1_000_000:
                    yield _pair_rows(out)
                    out = []
            yield _pair_rows(out)

    return rows


def _expanded(percent: int):
    """Of blocks of two groups' members: class pairs of different components whose sizes and sketches leave room for a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            classes = [batch.column(f"classes_{x}") for x in "ab"]
            sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in classes]
            begins = [np.cumsum(x) - x for x in sizes]
            flat = [x.flatten() for x in classes]
            labels = [batch.column(f"labels_{x}").flatten() for x in "ab"]
            coded = pc.dictionary_encode(pa.concat_arrays(labels)).indices.to_numpy(zero_copy_only=False)
            label = coded[: len(labels[0])], coded[len(labels[0]) :]
            sketches = [batch.column(f"sketches_{x}").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_WORDS) for x in "ab"]
            n = [batch.column(f"n_{x}").to_numpy() for x in "ab"]
            count = np.where(100 * np.minimum(*n) >= percent * np.maximum(*n), sizes[0] * sizes[1], 0)
            ends = np.cumsum(count)
            at = 0
            while at < len(count):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + 500_000, "right")))
                row = np.repeat(np.arange(at, to), count[at:to])
                k = concat_ranges(np.zeros(to - at, np.int64), count[at:to])
                i, j = begins[0][row] + k // sizes[1][row], begins[1][row] + k % sizes[1][row]
                good = label[0][i] != label[1][j]
                i, j, row = i[good], j[good], row[good]
                good = _alike(sketches[0][i], sketches[1][j], n[0][row] + n[1][row], percent)
                yield record(class_a=flat[0].take(pa.array(i[good])), class_b=flat[1].take(pa.array(j[good])))
                at = to

    return rows


def _sketch_filter(percent: int):
    """Class pairs whose sketches leave room for a link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = _alike(_sketches(batch.column("sketch_a")), _sketches(batch.column("sketch_b")), total, percent)
            yield batch.select(["class_a", "class_b"]).filter(pa.array(keep))

    return rows


def _verified(words: int, percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = pc.add(pc.binary_length(batch.column("text_a")), pc.binary_length(batch.column("text_b"))).to_numpy()
            step = max(1, int(6_000_000 // max(1, weight.max(initial=1))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sets = [shingle_sets(part.column(c), words) for c in ("text_a", "text_b")]
                keep = np.zeros(part.num_rows, bool)
                for k in range(part.num_rows):
                    one, two = (h[o[k] : o[k + 1]] for o, h in sets)
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    keep[k] = 100 * shared >= percent * (len(one) + len(two) - shared)
                yield part.select(["class_a", "class_b"]).filter(pa.array(keep))

    return rows


POSTING = "shingle long, group_key long, n long, pos long, sketch array<long>"
LIST = "shingle long, a long, b long, n long, pos long, is_pair boolean"
LINK = "class_a binary, class_b binary"


class _Join:
    """The tables of one join over (doc_id, text)."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        self.words, self.percent = words, percent
        self.docs = docs.withColumn("text_key", F.xxhash64("text"))
        spark = docs.sparkSession
        counted = docs.select("text").mapInArrow(tidy(_document_frequencies(words, percent)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter("n > 1")
        counted = materialise(counted, "shingles-shared")
        clean(spark)
        shared = _bitmap(counted, "shingle")
        frequent = counted.filter(F.col("n") >= COMMON_DOCS).orderBy(F.desc("n"), "shingle").limit(COMMON_MAX).select("shingle").toArrow()
        common = np.sort(column(frequent, "shingle").view(np.uint64))
        marks = spark.sparkContext.broadcast((shared, common))
        sets = materialise(self.docs.mapInArrow(tidy(_prefixes(words, percent, marks)), "doc_id long, text_key long, n long, class_key binary, is_first boolean, prefix array<long>, sketch array<long>"), "shingle-sets")
        marks.unpersist()
        self.facts = materialise(sets.select("doc_id", "text_key", "n", "class_key"), "shingle-facts")
        classes = sets.filter("is_first").groupBy("class_key", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("text_of"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"))
        classes = materialise(classes.withColumn("group_key", F.xxhash64("prefix", "n")), "shingle-classes")
        discard(sets)
        clean(spark)
        self.members = materialise(classes.drop("prefix"), "shingle-members")
        bits = [F.bit_and(F.col("sketch")[i]) for i in range(SKETCH_WORDS)]
        same = [F.bitwise_not(F.bit_and(F.col("sketch")[i]).bitwiseXOR(F.bit_or(F.col("sketch")[i]))) for i in range(SKETCH_WORDS)]
        groups = classes.groupBy("group_key", "prefix", "n").agg(F.array(*bits, *same).alias("sketch"), F.min("class_key").alias("lead"), F.count("*").alias("size"))
        groups = materialise(groups, "shingle-groups")
        discard(classes)  # of all copies of the prefixes the groups' own stays, until their postings are written
        clean(spark)
        # Most shingles of a prefix stand in no other one: only hashes are shuffled to find those that do, and only their postings carry sketches.
        listed = materialise(groups.select(F.explode("prefix").alias("shingle")).groupBy("shingle").count().filter("count > 1").select("shingle"), "shingles-listed")
        clean(spark)
        marks = spark.sparkContext.broadcast(_bitmap(listed, "shingle"))
        postings = groups.select("group_key", "n", "prefix", "sketch").mapInArrow(tidy(_postings(marks)), POSTING)
        self.lists = materialise(postings.repartition("shingle").sortWithinPartitions("shingle", "n", "group_key").mapInArrow(tidy(_lists(percent)), LIST), "shingle-lists")
        marks.unpersist()
        self.groups = materialise(groups.select("group_key", "lead", "size", "sketch"), "shingle-leads")
        discard(groups, listed)
        clean(spark)

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Of class pairs (class_a, class_b) those that verify on the texts.

        Both sides of these joins grow with the corpus, so they are merge joins at every size.
        """
        side = lambda x: self.members.select(*[F.col(c).alias(f"{d}_{x}") for c, d in (("class_key", "class"), ("n", "n"), ("sketch", "sketch"))]).hint("merge")
        full = pairs.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b")).distinct().join(side("a"), "class_a").join(side("b"), "class_b")
        kept = materialise(full.mapInArrow(tidy(_sketch_filter(self.percent)), LINK), "pairs-filtered")
        used = kept.select(F.col("class_a").alias("class_key")).unionByName(kept.select(F.col("class_b").alias("class_key"))).distinct()
        wanted = self.members.join(used, "class_key", "left_semi").select("class_key", F.col("text_of.doc_id").alias("w_doc"), F.col("text_of.text_key").alias("w_key"))
        wanted = materialise(wanted, "pairs-classes")
        marks = self.docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "w_key"))
        near = self.docs.select("doc_id", "text", "text_key").mapInArrow(tidy(_maybe_wanted(marks)), "doc_id long, text string, text_key long")
        # Repeated rows have one text.
        texts = near.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("w_doc")) & (F.col("text_key") == F.col("w_key"))).groupBy("class_key").agg(F.first("text").alias("text"))
        texts = materialise(texts, "pairs-texts")
        clean(self.docs.sparkSession)
        of = lambda x: texts.select(F.col("class_key").alias(f"class_{x}"), F.col("text").alias(f"text_{x}")).hint("merge")
        both = kept.join(of("a"), "class_a").join(of("b"), "class_b")
        return materialise(both.mapInArrow(tidy(_verified(self.words, self.percent)), LINK), "links")

    def components(self) -> DataFrame:
        """(class_key, label): equal labels where links reach."""
        lead = lambda x: self.groups.select(F.col("group_key").alias(x), F.col("lead").alias(f"class_{x}")).hint("merge")
        stars = self.lists.filter("is_pair").select("a", "b").distinct().join(lead("a"), "a").join(lead("b"), "b").select("class_a", "class_b")
        within = self.members.join(self.groups.filter("size > 1").select("group_key", F.col("lead").alias("class_a")), "group_key").filter("class_key <> class_a").select("class_a", F.col("class_key").alias("class_b"))
        found = connected_components(self._links(stars.unionByName(within)), "class_a", "class_b")
        labels = self.members.join(found, F.col("class_key") == F.col("node"), "left").select("group_key", "class_key", "n", "sketch", F.coalesce("component", "class_key").alias("label"))
        labels = materialise(labels, "labels")
        of_group = materialise(labels.groupBy("group_key").agg(F.min("label").alias("label"), (F.min("label") < F.max("label")).alias("mixed"), F.count("*").alias("size")), "group-labels")
        named = of_group.select("group_key", F.xxhash64("label").alias("label"), "mixed").hint("merge")
        entries = self.lists.filter("NOT is_pair").select("shingle", F.col("a").alias("group_key"), "n", "pos").join(named, "group_key")
        entries = materialise(entries.select("shingle", F.col("group_key").alias("a"), "n", "pos", "label", "mixed"), "list-entries")
        # Lists within one component have nothing left to find; only the others' entries carry sketches.
        left = entries.groupBy("shingle").agg((F.min("label") < F.max("label")).alias("differs"), F.max("mixed").alias("mixed")).filter("differs OR mixed").select("shingle")
        sketches = self.groups.select(F.col("group_key").alias("a"), "sketch").hint("merge")
        entries = entries.join(left, "shingle", "left_semi").join(sketches, "a").select("shingle", "a", "n", "pos", "sketch", "label", "mixed")
        across = entries.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(tidy(_open_pairs(self.percent)), LIST).select("a", "b").distinct()
        inside = of_group.filter("mixed").select(F.col("group_key").alias("a"), F.col("group_key").alias("b"))
        pairs = materialise(across.unionByName(inside), "open-groups")
        clean(self.docs.sparkSession)
        open_groups = pairs.select(F.col("a").alias("group_key")).unionByName(pairs.select(F.col("b").alias("group_key"))).distinct().join(of_group.select("group_key", "size"), "group_key")
        block = F.pmod(F.xxhash64("class_key"), F.ceil(F.col("size") / BLOCK))
        blocks = labels.join(open_groups, "group_key").groupBy("group_key", "n", block.alias("block")).agg(F.collect_list(F.struct("class_key", "label", "sketch")).alias("m"))
        blocks = materialise(blocks.select("group_key", "n", F.col("m.class_key").alias("classes"), F.col("m.label").alias("labels"), F.flatten("m.sketch").alias("sketches")), "open-members")
        side = lambda x: blocks.select(F.col("group_key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "classes", "labels", "sketches")])
        more = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(_expanded(self.percent)), LINK)
        of = lambda x: labels.select(F.col("class_key").alias(f"class_{x}"), F.col("label").alias(f"label_{x}"))
        joined = self._links(more).join(of("a"), "class_a").join(of("b"), "class_b").select("label_a", "label_b").distinct()
        merged = connected_components(materialise(joined, "label-links"), "label_a", "label_b")
        return labels.join(merged, F.col("label") == F.col("node"), "left").select("class_key", F.coalesce("component", "label").alias("label"))


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, and text_key and component_key.

    Documents link when 100 * shared shingles >= percent * all shingles of both. ``component_id``
    is the smallest id that links reach, the document's own included; null where none of the
    component has an id. ``text_key`` is the xxhash64 of the text, which tells rows under one id
    apart; ``component_key`` is equal within a component and null without shingles. Null and empty
    texts have no shingles and are alone. Rows repeated with an id keep their own results. Other
    columns are ignored.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    join = _Join(whole, words, percent)
    classes = materialise(join.components(), "class-components")
    smallest = join.facts.filter("n > 0").groupBy("class_key").agg(F.min("doc_id").alias("low")).join(classes, "class_key").groupBy("label").agg(F.min("low").alias("component_id"))
    per_class = materialise(classes.join(smallest, "label").select(F.col("class_key").alias("c_key"), "component_id", F.col("label").alias("component_key")), "components")
    joined = join.facts.select("doc_id", "text_key", "n", "class_key").join(per_class, (F.col("class_key") == F.col("c_key")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key", "component_key")
