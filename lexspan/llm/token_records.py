"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard is a file of records in ascending order of doc_id (then text, where ids repeat):
    u64 length of the data | u32 masked CRC of the length | data | u32 masked CRC of the data
all little-endian. The data are the ids as unsigned 16-bit integers where the vocabulary fits into
them, else 32-bit. The checksum is CRC-32, masked by a rotation and a constant, so that checksums of
data that hold checksums stay useful. Beside each shard an index file holds 24 bytes for a record:
i64 doc_id | u64 offset of the record | u64 number of ids. Shards follow each other in doc_id order.

Files are written under a name of their own attempt and renamed when whole: an attempt that is lost
or repeated leaves the same bytes. The manifest (one row for each shard) is all that the driver gets.

Cases: a null text counts as empty and yields the end id alone; a null doc_id sorts first and reads
back as null (its bit pattern is the smallest i64); repeated rows each get a record; an empty table
yields no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm import scratch, tokens

MASK_DELTA = 0xA282EAD8
NULL_ID = -(1 << 63)
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
MANIFEST = "shard int, path string, width int, n_docs long, n_tokens long, n_bytes long"
HEAD, FOOT = struct.Struct("<QI"), struct.Struct("<I")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """A record around some data."""
    length = struct.pack("<Q", len(data))
    return length + FOOT.pack(masked_crc(length)) + data + FOOT.pack(masked_crc(data))


def unframe(blob: memoryview, at: int) -> memoryview:
    """The data of the record at an offset; ValueError if a checksum or a length is wrong."""
    if at + HEAD.size > len(blob):
        raise ValueError(f"a record at {at} is cut off")
    n, crc = HEAD.unpack_from(blob, at)
    end = at + HEAD.size + n
    if masked_crc(bytes(blob[at : at + 8])) != crc or end + FOOT.size > len(blob):
        raise ValueError(f"the length of the record at {at} is broken")
    data = blob[at + HEAD.size : end]
    if masked_crc(data) != FOOT.unpack_from(blob, end)[0]:
        raise ValueError(f"the data of the record at {at} are broken")
    return data


#: Rows of an Arrow batch that are turned into Python objects together.
SLICE = 500


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        end = np.asarray([end_id], encoder.dtype).tobytes()
        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        store, top = _open(folder)
        name = f"{top}/shard-{shard:06d}"
        store.create_dir(top, recursive=True)
        index, at, total = [], 0, 0
        with store.open_output_stream(f"{name}.records.{attempt}") as out:
            for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    data = encoder.encode(text).tobytes() + end
                    n = len(data) // encoder.dtype.itemsize
                    index.append((NULL_ID if doc is None else doc, at, n))
                    at += out.write(frame(data))
                    total += n
        if index:
            with store.open_output_stream(f"{name}.index.{attempt}") as out:
                out.write(np.array(index, INDEX).tobytes())
            for kind in ("index", "records"):
                store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
            row = [[shard], [f"{folder}/shard-{shard:06d}"], [encoder.dtype.itemsize], [len(index)], [total], [at]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                ["shard", "path", "width", "n_docs", "n_tokens", "n_bytes"])
        else:
            store.delete_file(f"{name}.records.{attempt}")

    return write


def write_records(documents: DataFrame, folder: str, tokenizer: str, end_id: int) -> list:
    """Write shards to a folder that all executors reach; the manifest's rows, in order of shards."""
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(rows.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).collect(), key=lambda r: r.shard)


def read_shard(path: str, width: int, order: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) of a shard's records; order: which records, in which order (all, as they lie)."""
    store, name = _open(path)
    with store.open_input_file(f"{name}.index") as f:
        index = np.frombuffer(f.read(), INDEX)
    with store.open_input_file(f"{name}.records") as f:
        for r in index if order is None else index[order]:
            f.seek(int(r["offset"]))
            whole = memoryview(f.read(HEAD.size + int(r["n"]) * width + FOOT.size))
            data = np.frombuffer(unframe(whole, 0), f"<u{width}")
            if len(data) != r["n"]:
                raise ValueError(f"the index of {path} disagrees with its records")
            yield int(r["doc_id"]), data


OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for shard in batch.to_pylist():
            start, rows = shard["start"], []
            for doc, ids in read_shard(shard["path"], shard["width"]):
                rows.append((None if doc == NULL_ID else doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield block(rows)
                    rows = []
            if rows:
                yield block(rows)


def read_records(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files; a task for each shard."""
    start, rows = 0, []
    for m in manifest:
        rows.append((m.shard, m.path, m.width, start))
        start += m.n_tokens
    shards = spark.createDataFrame(rows, "shard int, path string, width int, start long")
    return shards.repartitionByRange(max(1, len(rows)), "shard").mapInArrow(_reader, OUT)


def token_records(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents as records to a folder (a new one in the shared folder), and read them back."""
    spark = documents.sparkSession
    folder = folder or scratch.new_path(spark, "records")
    return read_records(spark, write_records(documents, folder, tokenizer, end_id))
