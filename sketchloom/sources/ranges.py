"""FASTA by byte ranges: a Python data source whose tasks read parts of files, and whose rows are parts of sequences.

``spark.read.format("fasta_ranges").load(path)`` after ``register(spark)``. A file is cut into ranges of ``range_bytes``; a record
belongs to the range in which its header begins, and the task of that range reads on until the next line that starts with
``>``. Sequences come as rows (file, at, name, part, piece) of about ``piece_letters`` letters, so neither a task nor a row ever
holds a whole chromosome; ``overlap`` letters at the end of a piece are repeated in the next, which keeps windows
of up to ``overlap`` + 1 letters whole. ``sequences`` puts short ones together again; sketches need not.

A name is its whole header line, cut to 199 characters; records with an empty one are skipped. Carriage returns, line feeds
and blanks before the first header don't count. What stands before the first ``>`` of a file is a record too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME_LIMIT = 199
RANGE_BYTES, PIECE_LETTERS, STEP = 64 << 20, 1 << 20, 1 << 20
_BREAKS = re.compile(rb"[\r\n]")


class Range(InputPartition):
    """The records of a file whose headers begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def record_chunks(read, start: int, end: int, step: int = STEP) -> Iterator[tuple[int, bytes]]:
    """(offset of the record, bytes) in order; ``read(at, n)`` gives up to n bytes from ``at``. A record comes in several chunks."""
    at = max(0, start - 1)
    held = read(at, step)
    if start > 0:  # the first header line at or behind the start
        while (mark := held.find(b"\n>")) < 0:
            at += max(0, len(held) - 1)
            more = read(at + min(1, len(held)), step)
            if not more or at >= end:
                return
            held = held[-1:] + more
        at, held = at + mark + 1, held[mark + 1 :]
    record = at
    while record < end and held:
        mark = held.find(b"\n>")
        if mark >= 0:
            yield record, held[: mark + 1]
            at, held = at + mark + 1, held[mark + 1 :]
            record = at
            continue
        more = read(at + len(held), step)
        if not more:
            yield record, held
            return
        if len(held) > 1:  # the last byte may begin the next mark
            yield record, held[:-1]
            at, held = at + len(held) - 1, held[-1:]
        held += more


def records(read, start: int, end: int, piece: int, overlap: int, step: int = STEP) -> Iterator[tuple[int, str, int, str]]:
    """(offset, name, part, piece) of the records of a range; all pieces but an only one have ``piece`` letters or more."""
    now, head, name, part, letters = None, b"", None, 0, b""

    def rest():
        if now is not None:
            own = name if name is not None else _name(head)
            if own:
                yield now, own, part, letters.decode("utf-8", "replace")

    for record, data in record_chunks(read, start, end, step):
        if record != now:
            yield from rest()
            now, head, name, part, letters = record, b"", None, 0, b""
        if name is None:
            head += data
            stripped = head.lstrip()
            if b"\n" not in stripped:
                continue
            line, data = stripped.split(b"\n", 1)
            name, head = _name(line), b""
        letters += _BREAKS.sub(b"", data)
        while len(letters) >= 2 * piece:
            if name:
                yield now, name, part, letters[:piece].decode("utf-8", "replace")
            part, letters = part + 1, letters[piece - overlap :]
    yield from rest()


def _name(line: bytes) -> str:
    line = line.lstrip().removeprefix(b">").decode("utf-8", "replace").rstrip("\n")
    return line[:NAME_LIMIT].removesuffix("\r")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes, self.piece = int(options.get("range_bytes", RANGE_BYTES)), int(options.get("piece_letters", PIECE_LETTERS))
        self.overlap = int(options.get("overlap", 0))
        if self.range_bytes < 1 or not 0 <= self.overlap < self.piece:
            raise ValueError("range_bytes must be positive, and overlap less than piece_letters")

    def _files(self) -> list:
        fs, base = pyarrow.fs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(base)
        if info.type == pyarrow.fs.FileType.Directory:
            found = fs.get_file_info(pyarrow.fs.FileSelector(base))
            return sorted((f for f in found if f.type == pyarrow.fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)
        if info.type != pyarrow.fs.FileType.File:
            raise FileNotFoundError(self.path)
        return [info]

    def partitions(self) -> list[Range]:
        return [Range(f.path, a, min(a + self.range_bytes, f.size)) for f in self._files() for a in range(0, f.size, self.range_bytes)]

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as file:
            for at, name, part, piece in records(lambda a, n: file.read_at(n, a) if a < file.size() else b"", partition.start, partition.end, self.piece, self.overlap):
                yield partition.path, at, name, part, piece


class FastaRanges(DataSource):
    """The data source ``fasta_ranges``; options: path (a URI of a file or folder), range_bytes, piece_letters, overlap."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "file string, at long, name string, part int, piece string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaRanges)


def pieces(spark: SparkSession, path: str, **options) -> DataFrame:
    """(file, at, name, part, piece) of the records of ``path``; of records of one name the first counts."""
    register(spark)
    rows = spark.read.format("fasta_ranges").options(**options).load(path)
    first = rows.filter("part = 0").groupBy("name").agg(F.min(F.struct("file", "at")).alias("_f"))
    return rows.join(first.select("_f.file", "_f.at"), ["file", "at"], "left_semi")


def sequences(spark: SparkSession, path: str, drop_empty: bool = True, **options) -> DataFrame:
    """(name, sequence) as ``readers.fasta`` gives them, for sequences that fit into rows."""
    parts = pieces(spark, path, **options).groupBy("file", "at", "name").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p"))
    whole = parts.select("name", F.array_join("p.piece", "").alias("sequence"))
    return whole.filter("sequence <> ''") if drop_empty else whole
