"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix is the word sequence from one word to its document's end; a repeat of ``window`` words is
a node of the suffix tree at least that deep with two leaves or more. Only suffixes that can lie
under such a node are placed in a tree, and no tree holds all of them:

1. Of each window's k-word grams the one with the smallest hash is its anchor. Equal windows have
   equal anchors, so a window whose anchor occurs once in the corpus repeats nowhere. Consecutive
   windows with one anchor make a run, and only anchors of runs are counted.
2. Runs with a repeated anchor are cut out of the texts and dealt out by the anchor. In a group
   each run's suffixes share the anchor; suffixes are split by their first words, two words a
   level, into ever longer prefixes. A prefix with one suffix is a leaf and leaves the tree; what
   is left at the window's depth are the deep internal nodes. The suffixes of an anchor with too
   many runs for one task are dealt out by a prefix as long as the window, each on its own.
3. Of a node's leaves the earliest stays, and the words of every other leaf's window are removed.

Runs of equal content within a slice of input are combined before the shuffle, which keeps a
passage that many documents share from filling one task: a group has at most one run of each
content from a slice. Words are compared by 48-bit codes within groups of equal 64-bit anchors; a
wrong match needs windows of one group that differ and agree in the codes of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import materialise, text_or_empty
from evistrata.llm._tasks import column, concat_ranges, key_chunks, record
from evistrata.llm._words import gram_hashes, hashed, mixed, slices, split_words

GRAM = 5
#: Rows of a shuffle partition that a task holds at once, but for a larger group.
GROUP_ROWS = 50_000
#: An anchor with more runs is split by longer prefixes. Such anchors, 8 bytes each, are sent to every task; N runs have at most N / HOT_RUNS of them.
HOT_RUNS = 200_000
#: Bytes of a word's code in a run.
CODE_BYTES = 6
#: A document is known by its id and, where an id has several rows, a 128-bit hash of the text; else the tags are 0.
DOC = ("doc", "tag1", "tag2")
ALONE, KNOWN, WITNESS, HOT = 0, 1, 2, 3


def _runs(offsets: np.ndarray, codes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Document, first window, number of windows and anchor hash of every run."""
    span = window - GRAM + 1
    last = len(codes) - window + 1
    if last <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = gram_hashes(codes, GRAM)
    low = np.uint64((1 << 24) - 1)
    packed = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    smallest, width = packed, 1
    while width < span:
        step = min(width, span - width)
        smallest = np.minimum(smallest[:-step], smallest[step:])
        width += step
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:last] == doc[window - 1 :]
    begins = np.ones(last, bool)
    begins[1:] = (smallest[1:] != smallest[:-1]) | (doc[1:last] != doc[: last - 1])
    begin = np.flatnonzero(begins)
    sizes = np.diff(np.append(begin, last))
    keep = inside[begin]
    # A document's last run stops at its last whole window.
    until = offsets[doc[begin] + 1] - window + 1
    sizes = np.minimum(sizes, until - begin)
    begin, sizes = begin[keep], sizes[keep]
    at = begin + ((smallest[begin] & low).astype(np.int64) - begin) % (1 << 24)
    return doc[begin], begin, sizes, grams[at]


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, slice]]:
    """Document keys, word offsets and word codes of slices of texts."""
    texts = batch.column("text")
    for a, b in slices(texts):
        offsets, words = split_words(texts.slice(a, b - a))
        yield [batch.column(c).to_numpy()[a:b] for c in DOC], offsets, hashed(words), slice(a, b)


def _spread(docs: list[np.ndarray], of: np.ndarray, extra: np.ndarray) -> np.ndarray:
    return mixed(sum(x[of].view(np.uint64) for x in docs) + extra.astype(np.uint64))


def _of(docs: list[np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    return {c: x[at] for c, x in zip(DOC, docs)}


def _anchor_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, offsets, codes, _ in _sliced(batch):
                of, start, _, anchor = _runs(offsets, codes, window)
                _, first, back, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                known = count[back] > 1
                pos = start - offsets[of]
                key = np.where(known, _spread(docs, of, pos), anchor).view(np.int64)
                yield record(key=key, **_of(docs, of), pos=pos, kind=np.where(known, KNOWN, ALONE).astype(np.int8))
                seen = anchor[first[count > 1]].view(np.int64)
                zero = np.zeros_like(seen)
                yield record(key=seen, doc=zero, tag1=zero, tag2=zero, pos=count[count > 1], kind=np.full(len(seen), WITNESS, np.int8))

    return rows


def _repeated_rows(hot_runs: int):
    """The runs whose anchor has another run or a witness, and a row for each anchor with too many."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_chunks(batches, 500_000):
            key, kind, pos = (column(table, c) for c in ("key", "kind", "pos"))
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            seen = np.add.reduceat((kind == WITNESS).astype(np.int64), begin)
            runs = np.add.reduceat(np.where(kind == WITNESS, pos, kind == ALONE), begin)
            many = np.repeat((runs > 1) | (seen > 0), np.diff(np.append(begin, len(key))))
            keep = ((kind == ALONE) & many) | (kind == KNOWN)
            yield record(**{c: column(table, c)[keep] for c in DOC}, pos=pos[keep], kind=np.zeros(int(keep.sum()), np.int8))
            hot = key[begin[runs > hot_runs]]
            zero = np.zeros_like(hot)
            yield record(doc=hot, tag1=zero, tag2=zero, pos=zero, kind=np.full(len(hot), HOT, np.int8))

    return rows


def _run_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of codes[begin:end] for each pair."""
    n = len(codes)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power, back = np.full(n + 1, base, np.uint64), np.full(n + 1, inverse, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes) * power[:n], dtype=np.uint64)])
    return mixed((sums[end] - sums[begin]) * back[begin])


def _suffix_rows(window: int, shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for batch in batches:
            chosen = batch.column("places")
            for docs, offsets, codes, part in _sliced(batch):
                of, start, size, anchor = _runs(offsets, codes, window)
                own = chosen.slice(part.start, part.stop - part.start)
                at = np.repeat(offsets[:-1], own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + own.flatten().to_numpy()
                take = np.zeros(len(codes) + 1, bool)
                take[at] = True
                keep = take[start]
                of, start, size, anchor = of[keep], start[keep], size[keep], anchor[keep]
                if len(hot):  # one suffix a row, dealt out by its whole window
                    split = np.isin(anchor, hot)
                    row = np.repeat(np.arange(len(of)), np.where(split, size, 1))
                    shift = concat_ranges(np.zeros(len(of), np.int64), np.where(split, size, 1))
                    of, start, size, anchor, split = of[row], start[row] + shift, np.where(split, 1, size)[row], anchor[row], split[row]
                    whole = _run_hashes(codes, start[split], start[split] + window)
                    anchor[split] = mixed(anchor[split] ^ whole)
                end = start + size + window - 1
                # The rank of a run among equal ones: by document and position.
                pos = start - offsets[of]
                content = _run_hashes(codes, start, end)
                order = np.lexsort((pos, *[x[of] for x in reversed(docs)], content, anchor))
                same = np.zeros(len(order), bool)
                same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1]) & (size[order][1:] == size[order][:-1])
                later, first = order[same], order[~same]
                nothing = pa.nulls(len(later), pa.binary())
                yield record(key=_spread(docs, of[later], pos[later]).view(np.int64), **_of(docs, of[later]), pos=pos[later], size=size[later].astype(np.int32), words=nothing)
                ranges = concat_ranges(start[first], end[first] - start[first])
                data = np.ascontiguousarray(codes[ranges].view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES])
                cuts = np.concatenate([[0], np.cumsum((end - start)[first])]).astype(np.int32) * CODE_BYTES
                words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
                yield record(key=anchor[first].view(np.int64), **_of(docs, of[first]), pos=pos[first], size=size[first].astype(np.int32), words=words)

    return rows


def _deep_nodes(key: np.ndarray, words: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes under nodes of depth ``window`` with two leaves or more, and their nodes.

    The tree grows from the top: a node holds the suffixes with one prefix, and the next two words
    split it. Nodes with one suffix are dropped as soon as they arise.
    """
    alive = np.arange(len(begin))
    node = np.unique(key, return_inverse=True)[1].astype(np.int64)
    for depth in range(0, window, 2):
        labels = [words[begin[alive] + depth]]
        if depth + 1 < window:
            labels.append(words[begin[alive] + depth + 1])
        order = np.lexsort((*labels, node))
        split = np.zeros(len(order), bool)
        split[:1] = True
        for x in (node, *labels):
            split[1:] |= x[order][1:] != x[order][:-1]
        number = np.cumsum(split) - 1
        inner = np.bincount(number, minlength=1)[number] > 1 if len(order) else split
        alive, node = alive[order[inner]], number[inner]
    return alive, node


def _subtrees(window: int):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_chunks(batches, GROUP_ROWS):
            table = table.combine_chunks()
            docs, pos, size = [column(table, c) for c in DOC], column(table, "pos"), column(table, "size").astype(np.int64)
            texts = table["words"].combine_chunks()
            in_tree = texts.is_valid().to_numpy(zero_copy_only=False)
            yield record(**_of(docs, ~in_tree), pos=pos[~in_tree], length=size[~in_tree] + window - 1)
            if not in_tree.any():
                continue
            key, docs, pos, size = column(table, "key")[in_tree], [x[in_tree] for x in docs], pos[in_tree], size[in_tree]
            packed = np.frombuffer(b"".join(texts.drop_null().to_pylist()), np.uint8).reshape(-1, CODE_BYTES)
            words = np.zeros((len(packed), 8), np.uint8)
            words[:, :CODE_BYTES] = packed
            words = words.view(np.uint64).ravel()
            length = size + window - 1
            base = np.cumsum(length) - length
            row = np.repeat(np.arange(len(size)), size)
            shift = concat_ranges(np.zeros(len(size), np.int64), size)
            alive, node = _deep_nodes(key[row], words, base[row] + shift, window)
            of = row[alive]
            order = np.lexsort((pos[of] + shift[alive], *[x[of] for x in reversed(docs)], node))
            later = np.zeros(len(order), bool)
            later[1:] = node[order][1:] == node[order][:-1]
            # Windows that follow one another in a run are one range.
            gone = np.sort(alive[order[later]])
            first = np.append(True, (np.diff(gone) != 1) | (np.diff(row[gone]) != 0)) if len(gone) else np.zeros(0, bool)
            heads = np.flatnonzero(first)
            counts = np.diff(np.append(heads, len(gone)))
            head = gone[heads]
            yield record(**_of(docs, row[head]), pos=pos[row[head]] + shift[head], length=counts + window - 1)

    return ranges


def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        for doc, _, offsets, _, part in _sliced_words(batch):
            cuts = batch.column("ranges").slice(part.start, part.stop - part.start)
            flat = cuts.flatten().to_numpy()
            begin = np.repeat(offsets[:-1], cuts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + (flat >> 32)
            edge = np.zeros(offsets[-1] + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + (flat & 0xFFFFFFFF), -1)
            kept = np.cumsum(edge)[:-1] == 0
            total = np.concatenate([[0], np.cumsum(kept)])
            n_kept = total[offsets[1:]] - total[offsets[:-1]]
            words = doc.filter(pa.array(kept)).to_pylist()
            ends = np.cumsum(n_kept)
            digests = [hashlib.sha256(" ".join(words[b - n : b]).encode()).hexdigest() for b, n in zip(ends, n_kept)]
            n_words = np.diff(offsets)
            yield record(doc_id=batch.column("doc_id").slice(part.start, part.stop - part.start), n_words=n_words, n_removed=n_words - n_kept, kept_sha256=pa.array(digests, pa.string()), copies=batch.column("copies").slice(part.start, part.stop - part.start))


def _sliced_words(batch: pa.RecordBatch) -> Iterator[tuple]:
    texts = batch.column("text")
    for a, b in slices(texts):
        offsets, words = split_words(texts.slice(a, b - a))
        yield words, None, offsets, None, slice(a, b)


def repeated_ranges(texts: DataFrame, window: int = 20, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc, tag1, tag2, text, and more), one row a document, to the ranges to remove: its key and ranges (first word << 32 | words)."""
    keys = "doc long, tag1 long, tag2 long, pos long"
    anchors = texts.select(*DOC, "text").mapInArrow(_anchor_rows(window), f"key long, {keys}, kind byte")
    repeated = materialise(anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated_rows(hot_runs), f"{keys}, kind byte"), "anchors-repeated")
    hot = repeated.filter(F.col("kind") == HOT).select("doc").toArrow()  # see HOT_RUNS for the bound
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(column(hot, "doc").view(np.uint64)))
    chosen = repeated.filter(F.col("kind") != HOT).groupBy(*DOC).agg(F.collect_list("pos").alias("places"))
    runs = texts.join(chosen, [*DOC]).mapInArrow(_suffix_rows(window, shared), f"key long, {keys}, size int, words binary")
    found = runs.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window), f"{keys}, length long")
    return found.groupBy(*DOC).agg(F.collect_list(F.shiftleft("pos", 32) + F.col("length")).alias("ranges"))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256.

    Every word covered by a window whose words also start earlier is removed: in a document with a
    smaller id, or earlier in the same one. Null ids come last, after the largest id. Windows are judged on the input.
    Null and empty texts have no words, and texts shorter than the window lose nothing. Rows
    repeated with id and text are one document and get one result each; different texts under one
    id, or without one, are told apart and ordered by a hash. Other columns are ignored.
    """
    last = F.lit((1 << 63) - 1)
    own = F.col(id_col).cast("long")
    whole = docs.select(F.coalesce(own, last).alias("doc"), own.isNull().alias("none"), text_or_empty(text_col).alias("text"))
    several = materialise(whole.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc", F.lit(True).alias("several")), "ids-repeated")
    tag = lambda *cols: F.when(F.col("several"), F.xxhash64(*cols)).otherwise(F.lit(0).cast("long"))
    # Null ids share a number with the largest id, whose own documents have tags below zero there.
    half, middle = F.shiftright(tag("text"), 1), F.lit(1 << 62)
    first = F.when(F.col("doc") != last, tag("text")).when(F.col("none"), half + middle).otherwise(half - middle)
    keyed = whole.join(several, "doc", "left").select("doc", first.alias("tag1"), tag(F.lit(1), "text").alias("tag2"), "text", F.coalesce("several", F.lit(False)).alias("several"))
    twins = materialise(keyed.filter("several").groupBy(*DOC).agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts-repeated")
    once = keyed.filter("NOT several").select(*DOC, "text", F.lit(1).cast("long").alias("copies")).unionByName(twins)
    # Both joins with the texts take the same columns, so their shuffle is made once.
    joined = once.join(repeated_ranges(once, window, hot_runs), [*DOC], "left").select(F.when((F.col("doc") != last) | (F.col("tag1") < 0), F.col("doc")).alias("doc_id"), "text", "copies", "ranges")
    found = joined.mapInArrow(_kept_rows, "doc_id long, n_words long, n_removed long, kept_sha256 string, copies long")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
