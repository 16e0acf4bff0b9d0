"""Delimited tables in block gzip, read in ranges of a file as a Spark data source.

Block gzip is a gzip file of many short members that each name their size, so a reader can start at
any of them. A task has a range of bytes: it looks for the first member that begins there, reads
the lines that begin within its members, and one member more for the end of the last line. Only the
columns that are asked for are parsed, found by the header's names, and filters apply before rows
leave the reader. A plain gzip or text file is one range.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Rows that decide a column's type, text a member holds at the most, bytes of a file a task takes, and text it parses at once.
SNIFFED, MEMBER, RANGE, CHUNK = 200, 65_280, 8_000_000, 16_000_000
HEAD = struct.Struct("<4BIBBH2BHH")  # magic, method, flags, time, extra flags, system, extra length, "BC", 2, member size - 1
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MISSING = ["", "NA", "NaN", "nan", "null", "None"]


def block_gzip(data: bytes, member: int = MEMBER) -> bytes:
    """``data`` as block gzip, with the empty member that ends such a file."""
    out = []
    for i in range(0, len(data), member):
        part = data[i : i + member]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out.append(HEAD.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + HEAD.size + 7) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join([*out, END])


def member_size(head: bytes) -> int | None:
    """The size of the member that ``head`` begins, if it begins one."""
    if len(head) < HEAD.size or head[:4] != b"\x1f\x8b\x08\x04" or head[10:16] != b"\x06\x00BC\x02\x00":
        return None
    return HEAD.unpack_from(head)[-1] + 1


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _first_member(file: pa.NativeFile, start: int, size: int) -> int | None:
    """The first member at or after ``start``: a head whose next member begins where it says, or the file ends there."""
    file.seek(start)
    window = file.read(min(size - start, 2 * 65_536 + HEAD.size))
    at = window.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        length = member_size(window[at : at + HEAD.size])
        if length is not None:
            behind = start + at + length
            file.seek(behind)
            if behind == size or member_size(file.read(HEAD.size)) is not None:
                return start + at
        at = window.find(b"\x1f\x8b\x08\x04", at + 1)
    return None


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int
    blocked: bool

    def __init__(self, path: str, begin: int, end: int, size: int, blocked: bool) -> None:
        self.path, self.begin, self.end, self.size, self.blocked = path, begin, end, size, blocked


def _members(part: Range, file: pa.NativeFile) -> Iterator[tuple[int, bytes]]:
    """Where each member begins, from the first in the range on, and its text."""
    at = 0 if part.begin == 0 else _first_member(file, part.begin, part.size)
    while at is not None and at < part.size:
        file.seek(at)
        head = file.read(HEAD.size)
        length = member_size(head)
        if length is None:
            raise ValueError(f"{part.path}: no member begins at byte {at}")
        yield at, zlib.decompress(file.read(length - HEAD.size - 8), -15)
        at += length


def _lines(part: Range) -> Iterator[bytes]:
    """Whole lines that begin in a range, in pieces of about ``CHUNK``; the first range has the header."""
    fs, path = _opened(part.path)
    if not part.blocked:
        with fs.open_input_stream(path, compression="gzip" if path.endswith((".gz", ".bgz")) else None) as stream:
            held = b""
            while piece := stream.read(CHUNK):
                cut = piece.rfind(b"\n") + 1
                if cut:
                    yield held + piece[:cut]
                    held = piece[cut:]
                else:
                    held += piece
            if held:
                yield held
        return
    with fs.open_input_file(path) as file:
        held, count, first = [], 0, part.begin > 0
        for at, text in _members(part, file):
            if at >= part.end:
                # A line that begins within the range ends at the first line feed beyond it, and one that begins there is not ours.
                cut = text.find(b"\n") + 1
                if first:  # no line has begun in the range
                    return
                held.append(text[:cut] if cut else text)
                if cut:
                    break
                continue
            if first:
                cut = text.find(b"\n") + 1
                if not cut:
                    continue
                text, first = text[cut:], False
            held.append(text)
            count += len(text)
            if count >= CHUNK:
                whole = b"".join(held)
                cut = whole.rfind(b"\n") + 1
                if cut:
                    yield whole[:cut]
                held, count = [whole[cut:]], len(whole) - cut
        if rest := b"".join(held):
            yield rest


def _typed(column: pa.ChunkedArray, kind: pa.DataType) -> pa.ChunkedArray:
    """Text as ``kind``; what is missing or is no number becomes null."""
    column = pc.if_else(pc.is_in(column, value_set=pa.array(MISSING)), pa.scalar(None, pa.string()), column)
    if pa.types.is_string(kind):
        return column
    pattern = r"^[+-]?[0-9]{1,18}$" if pa.types.is_integer(kind) else r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?inf$"
    number = pc.match_substring_regex(column, pattern)
    return pc.cast(pc.utf8_ltrim(pc.if_else(number, column, pa.scalar(None, pa.string())), "+"), kind)


def _keeps(column: pa.ChunkedArray, f: Filter) -> pa.ChunkedArray:
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array(list(f.value), column.type))
    if isinstance(f, StringStartsWith):
        return pc.starts_with(column, f.value)
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}[type(f)]
    return compare(column, pa.scalar(f.value, column.type))


PUSHED = (IsNull, IsNotNull, In, StringStartsWith, EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)


class BlockedReader(DataSourceReader):
    """``sep`` parts the fields; the schema's columns are found in each file's header by name, and one that is not there is null."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.sep, self.range = schema, options.get("sep", ","), int(options.get("rangebytes", RANGE))
        self.paths, self.filters = files_of(options["path"]), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, PUSHED) and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            fs, own = _opened(path)
            size = fs.get_file_info(own).size
            with fs.open_input_file(own) as file:
                blocked = member_size(file.read(HEAD.size)) is not None
            step = self.range if blocked else max(1, size)
            out += [Range(path, a, min(a + step, size), size, blocked) for a in range(0, size, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        header = header_of(part.path)
        names = next(pacsv.open_csv(io.BytesIO(header + b"\n" + header), parse_options=pacsv.ParseOptions(delimiter=self.sep))).schema.names
        wanted = [n for n in kinds.names if n in names]
        begin = part.begin == 0
        for lines in _lines(part):
            if begin:
                lines, begin = lines[lines.find(b"\n") + 1 or len(lines) :], False
            if not lines.strip():
                continue
            table = pacsv.read_csv(
                io.BytesIO(lines), pacsv.ReadOptions(column_names=names, block_size=len(lines) + 1), pacsv.ParseOptions(delimiter=self.sep),
                pacsv.ConvertOptions(include_columns=wanted or names[:1], column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
            )
            cols = {f.name: _typed(table[f.name], f.type) if f.name in wanted else pa.nulls(table.num_rows, f.type) for f in kinds}
            keep = None
            for f in self.filters:
                own = pc.fill_null(_keeps(cols[f.attribute[0]], f), False)
                keep = own if keep is None else pc.and_(keep, own)
            found = pa.table(cols, schema=kinds)
            yield from (found if keep is None else found.filter(keep)).combine_chunks().to_batches()


def header_of(path: str) -> bytes:
    return _head(path, 1)[0].rstrip(b"\r\n")


def _head(path: str, lines: int) -> list[bytes]:
    """The first lines of a file, of as many members as that takes."""
    fs, own = _opened(path)
    size = fs.get_file_info(own).size
    text = b""
    with fs.open_input_file(own) as file:
        blocked = member_size(file.read(HEAD.size)) is not None
    for piece in (x for _, x in _members(Range(path, 0, size, size, True), fs.open_input_file(own))) if blocked else _lines(Range(path, 0, size, size, False)):
        text += piece
        if text.count(b"\n") >= lines:
            break
    return text.splitlines(keepends=True)[:lines] or [b""]


def files_of(path: str) -> list[str]:
    """A file, or the files of a folder in order; names that begin with a dot or an underscore are left out."""
    fs, own = _opened(path)
    if fs.get_file_info(own).type == pafs.FileType.File:
        return [path]
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(own)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
    return [f"{path.rstrip('/')}/{f.rsplit('/', 1)[-1]}" for f in sorted(found)]


class BlockedTable(DataSource):
    """``spark.read.format("blocked_table")`` with a path and, if not a comma, ``sep``; without a schema the first 200 rows decide, of the first file that has any."""

    @classmethod
    def name(cls) -> str:
        return "blocked_table"

    def schema(self) -> StructType:
        heads = (_head(path, SNIFFED + 1) for path in files_of(self.options["path"]))
        lines: list[bytes] = []
        for head in heads:  # partitions without rows leave files with a header alone
            lines = head if len(head) > 1 else lines or head
            if len(head) > 1:
                break
        table = pacsv.read_csv(io.BytesIO(b"".join(lines)), parse_options=pacsv.ParseOptions(delimiter=self.options.get("sep", ",")), convert_options=pacsv.ConvertOptions(null_values=MISSING, strings_can_be_null=True))
        kind = lambda t: LongType() if pa.types.is_integer(t) else DoubleType() if pa.types.is_floating(t) else StringType()
        return StructType([StructField(f.name, kind(f.type)) for f in table.schema])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockedReader(schema, dict(self.options))


def write_blocked(df: DataFrame, path: str, sep: str = ",") -> None:
    """Each partition as a block gzip file with a header under ``path``, a folder that all executors share.

    A file is named by its partition, so a task that runs again writes the same file again.
    """
    from pyspark import TaskContext

    names = df.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, own = _opened(path)
        fs.create_dir(own, recursive=True)
        part, count = TaskContext.get().partitionId(), 0
        with fs.open_output_stream(f"{own}/part-{part:06}.csv.bgz") as out:
            out.write(block_gzip((sep.join(names) + "\n").encode())[: -len(END)])
            for batch in batches:
                text = io.BytesIO()
                pacsv.write_csv(batch, text, pacsv.WriteOptions(include_header=False, delimiter=sep, quoting_style="needed"))
                out.write(block_gzip(text.getvalue())[: -len(END)])
                count += batch.num_rows
            out.write(END)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "rows": pa.array([count], pa.int64())})

    df.mapInArrow(rows, "part int, rows long").agg(F.sum("rows")).collect()  # one number


def blocked_table(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", range_bytes: int = RANGE) -> DataFrame:
    """A delimited table with a header from block gzip, gzip or text: the columns of ``schema`` alone, or all with sniffed types.

    Lines end at line feeds, also within quotes. Empty fields, NA, NaN, null and None are null, and
    so is what is no number in a column of numbers, also beyond the rows that decided its type.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockedTable)
    reader = spark.read.format("blocked_table").option("sep", sep).option("rangebytes", str(range_bytes))
    return (reader.schema(schema) if schema else reader).load(path)
