"""Lines of text files as a data source that seeks: whole files in ranges of bytes, or a sample that reads its share of the bytes.

A file is cut into blocks of bytes, and a line belongs to the block in which it starts. All blocks of a range are read one
after another; for a sample each block is drawn by a hash of the seed, the file's place in their order and its number, and only drawn blocks are
sought and read, each on to the end of its last line. Every block has the same chance, so every line has, whatever its length;
lines of one block are drawn together. The first line of a file, and the one after it, always come, as the
one is a header as a rule and the other tells the types.

Columns: file, offset (bytes before the line), line (without its end), part (the range's number) and bytes (what the range's task has
read so far). Folders and files are URIs that pyarrow's file systems open (file, hdfs, s3, gcs).

Defined cases: an empty file has no lines; a last line without an end is a line; a carriage return before the end goes; bytes
that are not UTF-8 are replaced; a line longer than a block starts in one block and takes up others, which have no line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, offset long, line string, part int, bytes long"
RANGE, BLOCK = 32 << 20, 64 << 10
ROWS = 4096


@dataclass
class Range(InputPartition):
    number: int
    order: int
    file: str
    start: int
    end: int


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def drawn(seed: int, file: int, block: int, share: float) -> bool:
    digest = hashlib.blake2b(f"{seed}:{block}:{file}".encode(), digest_size=8).digest()
    return int.from_bytes(digest, "little") < share * 2.0**64


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.share = options["path"], float(options.get("share", "1"))
        self.seed, self.block = int(options.get("seed", "0")), int(options.get("block", str(BLOCK)))
        if not 0 <= self.share <= 1 or self.block < 1:
            raise ValueError("a share lies between 0 and 1, a block has a byte at least")

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, root = _fs(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        size = max(1, RANGE // self.block) * self.block
        cuts = [(k, p, at, min(n, at + size)) for k, (p, n) in enumerate(files) for at in range(0, n, size)]  # one for each 32 MB
        return [Range(i, *c) for i, c in enumerate(cuts)] or [Range(0, 0, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end <= part.start:
            return
        system, _ = _fs(self.path)
        read, rows = 0, []
        with system.open_input_file(part.file) as f:
            whole = f.size()
            for at in range(part.start, part.end, self.block):
                end = min(at + self.block, whole)
                mine = self.share >= 1 or drawn(self.seed, part.order, at // self.block, self.share)
                if not mine and at:
                    continue
                # a line starts here if the byte before is an end
                back = 1 if at else 0
                data = f.read_at(end - at + back, at - back)
                read += len(data)
                first = 0 if not at else data.find(b"\n") + 1
                if at and not first:
                    continue
                place = at - back + first
                if first >= len(data):
                    continue
                step = min(4096, max(64, self.block // 8))
                while not data.endswith(b"\n") and at - back + len(data) < whole:
                    more = f.read_at(min(step, whole - (at - back + len(data))), at - back + len(data))
                    read += len(more)
                    cut = more.find(b"\n")
                    data += more if cut < 0 else more[: cut + 1]
                lines = data[first:].split(b"\n")
                if lines[-1] == b"":
                    lines.pop()
                for k, line in enumerate(lines):
                    if place >= end:
                        break
                    if mine or k < 2:
                        rows.append((part.file, place, line.removesuffix(b"\r").decode("utf-8", "replace"), part.number, read))
                    place += len(line) + 1
                if len(rows) >= ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "offset", "line", "part", "bytes"])


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seekable_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(dict(self.options))


def read_lines(spark: SparkSession, path: str, share: float = 1.0, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """All lines of a file or folder, or a sample of about `share` of them that reads about that share of the bytes."""
    spark.dataSource.register(LineSource)
    return spark.read.format("seekable_lines").option("share", repr(float(share))).option("seed", str(seed)).option("block", str(block)).load(path)


def bytes_read(lines: DataFrame) -> int:
    """What the tasks read that gave these lines; ranges without any are not counted."""
    from pyspark.sql import functions as F

    got = lines.groupBy("part").agg(F.max("bytes").alias("b")).agg(F.sum("b")).first()[0]
    return int(got or 0)
