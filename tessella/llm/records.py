"""Token-id output: length-delimited binary records with a separate offset index.

File format (little-endian). Data file `part-NNNNN.rec`, a record for each document:

    uint64  length of the payload in bytes
    uint32  masked CRC-32 of the eight length bytes
    bytes   payload: int64 document id, uint8 width of an id in bytes (2 or 4), the ids
    uint32  masked CRC-32 of the payload

The mask is ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2**32, so that a checksum of data that holds
checksums is no fixed point. Index file `part-NNNNN.idx`: for each record int64 document id, uint64
byte offset, uint32 record length, uint32 number of ids. A reader that shuffles records needs only
the index files. Ids are two bytes wide while the vocabulary allows it.

Documents lie in ascending id order over the files in ascending file order. Each task writes its
pair of files under a name of its own attempt and then renames it, so a repeated task leaves one
whole pair. The folder is a URI that pyarrow's file systems open (file, hdfs, s3, gcs); it has to be
shared by all executors.

Defined cases: null texts give records of the end id alone; documents with equal ids all stay, next
to one another; a null id is the payload's id -2**63 and comes first, and is read back as null, so a
document with that very id is refused; columns other than id and text are not carried, so their names
cannot clash; an empty table gives a folder without records.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import broadcast_vocabulary, loaded
from .common import arrow_batch, arrow_schema, shared_dir, task_count

MASK = 0xA282EAD8
HEAD, HEAD_SIZE = "<QI", 12
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4")])
BUFFER = 4 << 20
NO_ID = -(1 << 63)
#: This operator does nothing dearer than coding, so its workers may remember more chunks and words.
TABLES = (1_000_000, 1_000_000)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray, width: int) -> bytes:
    payload = struct.pack("<qB", doc_id, width) + ids.astype("<u2" if width == 2 else "<u4").tobytes()
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked_crc(n)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[int, np.ndarray, int]:
    """(document id, ids, offset of the next record); ValueError where a checksum or a length is wrong."""
    if len(data) < at + HEAD_SIZE:
        raise ValueError(f"record at {at}: cut off in its length")
    n, crc = struct.unpack_from(HEAD, data, at)
    if masked_crc(data[at: at + 8]) != crc:
        raise ValueError(f"record at {at}: wrong checksum of its length")
    start = at + HEAD_SIZE
    payload = data[start: start + n]
    if len(data) < start + n + 4 or masked_crc(payload) != struct.unpack_from("<I", data, start + n)[0]:
        raise ValueError(f"record at {at}: wrong checksum")
    doc_id, width = struct.unpack_from("<qB", payload)
    return doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=9), start + n + 4


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(df: DataFrame, vocabulary_path: str, folder: str | None = None, end_id: int | None = 1,
                  id_col: str = "doc_id", text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """Encode each text, append `end_id` (None: nothing), write the files; returns a row for each file.

    Texts are dealt by ranges of the id and sorted inside a task, so ranges hold nearly as many
    documents each however the ids are spread. The result (file, number, first_id, n_docs, n_tokens, bytes)
    is written too: a lost executor does not make the files be written twice. Files are in the order of
their `number`; their names sort like it up to 100,000 files only.
    """
    spark = df.sparkSession
    folder = folder or shared_dir(spark, "records")
    spec = broadcast_vocabulary(spark, vocabulary_path)
    ready = (df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
             .withColumn("doc_id", F.when(F.col("doc_id") == NO_ID, F.raise_error(F.lit(f"the id {NO_ID} stands for no id"))).otherwise(F.coalesce("doc_id", F.lit(NO_ID)))))

    def run(batches):
        ctx = TaskContext.get()
        part, bpe = ctx.partitionId(), None
        fs, root = _fs(folder)
        name = f"{root}/part-{part:05d}"
        own = f"{name}.{ctx.taskAttemptId()}"
        out, index, offset, pending, tokens = None, [], 0, [], 0
        for b in batches:
            bpe = bpe or loaded(spec.value, TABLES)
            width = 2 if bpe.size <= 1 << 16 else 4
            if out is None and b.num_rows:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{own}.rec")
            ids_in, texts = b.column("doc_id").to_pylist(), b.column("text")
            for k in range(0, len(texts), 2048):
                for doc, ids in zip(ids_in[k: k + 2048], bpe.encode_arrow(texts.slice(k, 2048)), strict=True):
                    if end_id is not None:
                        ids = np.append(ids, end_id)
                    rec = frame(doc, ids, width)
                    index.append((doc, offset, len(rec), len(ids)))
                    offset += len(rec)
                    tokens += len(ids)
                    pending.append(rec)
                out.write(b"".join(pending))
                pending = []
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{own}.idx") as f:
                f.write(np.array(index, INDEX).tobytes())
            for ext in (".rec", ".idx"):
                fs.move(own + ext, name + ext)
            yield pa.RecordBatch.from_pylist([{"file": f"part-{part:05d}", "number": part, "first_id": index[0][0], "n_docs": len(index), "n_tokens": tokens, "bytes": offset}])

    tasks = tasks or task_count(spark)
    made = (ready.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")
            .mapInArrow(run, "file string, number long, first_id long, n_docs long, n_tokens long, bytes long"))
    made.write.parquet(f"{folder}/files.parquet")
    return spark.read.parquet(f"{folder}/files.parquet").withColumn("folder", F.lit(folder))


def tokens_before(files: DataFrame) -> DataFrame:
    """The files with `before`, the number of ids in all files before: a running sum over a row for each file."""
    from pyspark.sql import Window

    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_records(spark: SparkSession, files: DataFrame, finish, added: str, tasks: int | None = None) -> DataFrame:
    """Read the data files of write_records(), a task for each few files, checking every checksum.

    `start` is the number of ids in all documents before: a running sum over the files (a row each)
    plus one inside the file. `finish(ids)` returns a tuple for the fields named in `added`.
    """
    todo = tokens_before(files).select("folder", "file", "before").repartition(tasks or task_count(spark), "file")
    schema = f"doc_id long, start long, n_tokens long, {added}"

    kinds = arrow_schema(spark, schema)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, root = _fs(row["folder"])
                rows, start, at, data = [], row["before"], 0, b""
                with fs.open_input_stream(f"{root}/{row['file']}.rec") as f:
                    while True:
                        if len(data) - at < HEAD_SIZE or len(data) - at < HEAD_SIZE + struct.unpack_from(HEAD, data, at)[0] + 4:
                            need = 0 if len(data) - at < HEAD_SIZE else struct.unpack_from(HEAD, data, at)[0]
                            more = f.read(max(BUFFER, need + 16))
                            if not more:
                                break
                            data, at = data[at:] + more, 0
                            continue
                        doc, ids, at = unframe(data, at)
                        rows.append((None if doc == NO_ID else doc, start, len(ids), *finish(ids)))
                        start += len(ids)
                        if len(rows) >= 4096:
                            yield arrow_batch(rows, kinds)
                            rows = []
                if at < len(data):
                    raise ValueError(f"{row['file']}: cut off at its end")
                if rows:
                    yield arrow_batch(rows, kinds)

    return todo.mapInArrow(run, schema)


def read_at(folder: str, file: str, offset: int, length: int) -> tuple[int, np.ndarray]:
    """One record by its place in the index: the shuffled read."""
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{file}.rec") as f:
        f.seek(offset)
        doc, ids, _ = unframe(f.read(length))
    return doc, ids


def read_index(folder: str, file: str) -> np.ndarray:
    fs, root = _fs(folder)
    with fs.open_input_file(f"{root}/{file}.idx") as f:
        return np.frombuffer(f.read(), INDEX)
