"""Interleaved documents with media columns: parse, store, and resolve by digest.

A page becomes an ordered sequence of structs, text pieces and media references in reading order,
each with its position; a reference carries the caption that stands with it. Media are stored by
content: the stored form's SHA-256 is its digest and a page refers to it as ``sha256:<digest>``.
Resolving joins references with the store by digest; positions and captions stay with the
reference, so a missing medium leaves a null beside them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistrata.llm._shared import materialise, text_or_empty
from evistrata.llm._tasks import record
from evistrata.llm._words import slices

#: Samples in a row of the stored image.
WIDTH = 192
SEQUENCE = "array<struct<position:int,kind:string,text:string,ref:string,caption:string,n_bytes:long>>"
MEDIA_TAGS = {"img", "video", "audio", "source", "embed", "image"}
SKIPPED = {"script", "style", "template", "noscript"}
#: Words on both sides of where such an element begins or ends are apart.
BLOCKS = set(
    "address article aside blockquote br body caption dd details div dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
#: More digits than any medium's size has.
SIZE_DIGITS = 18
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    """Collects text pieces and media references in reading order.

    A figure's caption may stand before or after its media, and goes to all of them; it ends with its
    element, with the figure, where another one begins, or with the page. The words of a caption
    whose figure has no media are text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.captions: list[str] = []
        self.in_caption = False
        self.figure = 0
        self.hidden = 0

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if not words:
            return
        if self.in_caption:
            self.captions.append(words)
        else:
            self.items.append({"kind": "text", "text": words, "ref": None, "caption": None, "n_bytes": None})

    def end_caption(self) -> None:
        if self.in_caption:
            self.flush()
            self.in_caption = False

    def end_figure(self) -> None:
        self.end_caption()
        self.flush()
        media = [item for item in self.items[self.figure :] if item["kind"] == "media"]
        words = " ".join(self.captions)
        self.captions = []
        if words and media:
            for item in media:
                item["caption"] = words
        elif words:
            self.items.append({"kind": "text", "text": words, "ref": None, "caption": None, "n_bytes": None})
        self.figure = len(self.items)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.text.append(" ")
        if tag in SKIPPED:
            self.hidden += 1
        elif tag == "figure":
            self.end_figure()
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.in_caption = True
        elif tag in MEDIA_TAGS and not self.hidden:
            self.medium(tag, dict(attrs))

    def medium(self, tag: str, named: dict[str, str | None]) -> None:
        ref = named.get("src") or named.get("data-src") or ((named.get("href") or named.get("xlink:href")) if tag == "image" else None)
        if not ref and tag == "img":
            ref = (named.get("srcset") or "").strip().split(" ")[0].rstrip(",")
        if not ref:
            return
        self.flush()
        size = named.get("data-bytes") or ""
        known = size.isascii() and size.isdecimal() and len(size) <= SIZE_DIGITS
        self.items.append({"kind": "media", "text": None, "ref": ref, "caption": named.get("alt") or None, "n_bytes": int(size) if known else None})

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.text.append(" ")
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![`` and what follows up to ``>`` is a comment, as browsers have it."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1

    def unknown_decl(self, data: str) -> None:
        pass


def sequence_of(html: str | None) -> list[dict]:
    """The items of one page; none for a null or empty page.

    Broken mark-up is read as far as browsers would: unclosed elements end with the page, and what an
    unclosed script, style, template or noscript hides stays hidden. A reference is ``src``, else
    ``data-src``, the first of ``srcset`` of an image, or the ``href`` of an image in a drawing;
    alternatives of a picture are not media of their own. Sizes that are no number of up to
    ``SIZE_DIGITS`` digits are null.
    """
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.end_figure()
    return [{"position": i, **item} for i, item in enumerate(parser.items)]


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, sequence): each page as ordered text and media structs. Null and empty pages have an empty sequence."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string()), ("n_bytes", pa.int64())]))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield record(id=part.column(0), sequence=pa.array([sequence_of(x) for x in part.column(1).to_pylist()], kind))

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(rows, f"id long, sequence {SEQUENCE}").select(F.col("id").alias(id_col), "sequence")


def references(sequences: DataFrame, id_col: str = "page_id") -> DataFrame:
    """A row for each media item: id, position, caption, ref, n_bytes."""
    items = sequences.select(F.col(id_col), F.explode("sequence").alias("item")).filter("item.kind = 'media'")
    return items.select(id_col, "item.position", "item.caption", "item.ref", "item.n_bytes")


def to_image(payload: bytes) -> bytes:
    """A lossless grey image (binary PGM, 8 bits a sample) of a payload of whole rows."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_image(media: bytes) -> bytes:
    """The samples of an image that ``to_image`` made."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image of whole rows")
    return samples


def padded(text: bytes) -> bytes:
    return text + b" " * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image, one row a document: doc_id, n_bytes, digest, media.

    The table lies in the shared folder. Its content decides the digest, so equal texts have equal
    rows but for the id.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            for a, b in slices(texts):
                own = texts.slice(a, b - a).to_pylist()
                media = [to_image(padded(x)) for x in own]
                yield record(doc_id=batch.column(0).slice(a, b - a), n_bytes=pa.array(map(len, own), pa.int64()), digest=pa.array([hashlib.sha256(x).hexdigest() for x in media], pa.string()), media=pa.array(media, pa.binary()))

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return materialise(texts.mapInArrow(rows, "doc_id long, n_bytes long, digest string, media binary"), "media")


def _feature(samples: bytes) -> str:
    """Mean in thousandths, share of sixteen grey bands in hexadecimal, and row-to-row change."""
    grey = np.frombuffer(samples, np.uint8)
    bands = np.bincount(grey >> 4, minlength=16) * 255 // len(grey)
    image = grey.reshape(-1, WIDTH).astype(np.int32)
    change = int(np.abs(np.diff(image, axis=0)).sum()) * 1000 // max(1, image[1:].size)
    return f"{int(grey.sum(dtype=np.int64)) * 1000 // len(grey)}-{bytes(bands.astype(np.uint8).tolist()).hex()}-{change}"


def media_features(store: DataFrame) -> DataFrame:
    """Read the stored bytes back: one row a digest with sizes, checksums and the feature."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, stored in zip(batch.column(0), batch.column(1)):
                media = stored.as_py()
                samples = from_image(media)
                out.append((digest.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), _feature(samples)))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    read = store.select("digest", "media").mapInArrow(rows, FEATURES)
    rest = [x.split()[0] for x in FEATURES.split(", ")][1:]
    one = read.groupBy("digest").agg(F.first(F.struct(*rest)).alias("f"))
    return materialise(one.select("digest", "f.*"), "media-features")


def resolve(refs: DataFrame, by_digest: DataFrame) -> DataFrame:
    """Join references ``sha256:<digest>`` with a table by digest; unknown and foreign ones get nulls.

    The table has one row a digest. A digest that very many pages share is a skewed key of a
    sort-merge join on the references' side, which adaptive execution splits.
    """
    digest = F.regexp_extract("ref", "^sha256:([0-9a-f]{64})$", 1)
    return refs.withColumn("ref_digest", F.when(digest != "", digest)).join(by_digest, F.col("ref_digest") == F.col("digest"), "left").drop("ref_digest")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a page with one figure: stored, referred to, parsed, and resolved by digest.

    One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, position, caption. Null text counts as empty and has one row of blanks;
    repeated rows give repeated results; a null id has an empty caption number. Other columns are
    ignored.
    """
    store = store_texts(docs, id_col, text_col)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    html = F.concat(F.lit('<figure><img src="sha256:'), "digest", F.lit('" data-bytes="'), F.col("n_bytes").cast("string"), F.lit('"><figcaption>document '), number, F.lit("</figcaption></figure>"))
    refs = references(interleave(store.select("doc_id", html.alias("html")), "doc_id"), "doc_id")
    return resolve(refs, media_features(store)).drop("ref", "digest")
