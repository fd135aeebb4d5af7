"""Token-id files: bit-plane shuffled, zstandard-compressed chunks with an index.

File layout (all integers little-endian)::

    "QIDS" u8 version, u8 plane kind (0 bytes, 1 bits), u16 0, u32 ids per chunk
    chunk 0, chunk 1, ...          each: its planes, compressed one by one
    index                          zstandard over the arrays described by the tail's JSON
    tail JSON, u32 its size, "QIDX"

A chunk is a fixed-size block of ids (the last may be shorter). Its ids are transposed into 4
byte planes or 32 bit planes, and each plane is compressed apart; the index has, for every
chunk, its offset, number of ids and the compressed size of each plane, and for every document
its id (with a null mark) and number of ids, so any document can be read without the others.

Null texts are empty documents; empty documents still hold the end id. Documents with equal or
null ids are kept, one entry each, ordered by id (nulls first) and then by a hash of the text.
An empty table gives no file. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import fresh_dir, shuffle_partitions
from quillstream.llm.tokens import encoder

MAGIC, TAIL = b"QIDS", b"QIDX"
IDS_PER_CHUNK = 1 << 16


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes, or the 32 bit planes, of unsigned 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [rows[:, k].tobytes() for k in range(4)]
    return [np.packbits((rows[:, k] >> j) & 1).tobytes() for k in range(4) for j in range(8)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The ids whose planes these are."""
    rows = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, dtype=np.uint8)
        if bits:
            rows[:, k // 8] |= np.unpackbits(raw, count=n) << (k % 8)
        else:
            rows[:, k] = raw
    return rows.reshape(-1).view("<u4")


class IdWriter:
    """Writes documents to one file; ids are held for one chunk at a time."""

    def __init__(self, out, bits: bool = False, per_chunk: int = IDS_PER_CHUNK, level: int = 3):
        self.out, self.bits, self.per_chunk = out, bits, per_chunk
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC + struct.pack("<BBHI", 1, bits, 0, per_chunk))
        self.left: list[np.ndarray] = []
        self.n_left = 0
        self.chunks: list[list[int]] = []
        self.doc_ids: list[int] = []
        self.nulls: list[bool] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(0 if doc_id is None else int(doc_id))
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.left.append(ids)
        self.n_left += len(ids)
        if self.n_left >= self.per_chunk:
            self._drain(False)

    def _drain(self, last: bool) -> None:
        ids = np.concatenate(self.left) if self.left else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // self.per_chunk * self.per_chunk
        for a in range(0, full, self.per_chunk):
            part = ids[a : min(full, a + self.per_chunk)]
            planes = [self.zip.compress(x) for x in to_planes(part, self.bits)]
            self.chunks.append([self.at, len(part), *map(len, planes)])
            self.at += self.out.write(b"".join(planes))
        self.left, self.n_left = [ids[full:]], len(ids) - full

    def close(self) -> int:
        """Write what is left and the index; gives the number of ids in the file."""
        self._drain(True)
        width = 2 + (32 if self.bits else 4)
        arrays = {
            "chunks": np.array(self.chunks, dtype="<i8").reshape(-1, width),
            "doc_ids": np.array(self.doc_ids, dtype="<i8"),
            "nulls": np.array(self.nulls, dtype="u1"),
            "sizes": np.array(self.sizes, dtype="<i8"),
        }
        packed = self.zip.compress(b"".join(x.tobytes() for x in arrays.values()))
        tail = json.dumps({"at": self.at, "size": len(packed), "width": width, "arrays": {k: [str(x.dtype), x.size] for k, x in arrays.items()}}).encode()
        self.out.write(packed + tail + struct.pack("<I", len(tail)) + TAIL)
        return int(sum(self.sizes))


class IdReader:
    """Reads a file of :class:`IdWriter`: its index at once, chunks when they are asked for."""

    def __init__(self, file, size: int):
        self.file = file
        head = self._read(0, 12)
        if head[:4] != MAGIC:
            raise ValueError("not a token-id file")
        self.bits, self.per_chunk = bool(head[5]), struct.unpack("<I", head[8:12])[0]
        end = self._read(size - 8, 8)
        if end[4:] != TAIL:
            raise ValueError("the file's index is missing")
        n = struct.unpack("<I", end[:4])[0]
        tail = json.loads(self._read(size - 8 - n, n))
        self.unzip = zstandard.ZstdDecompressor()
        raw, at = self.unzip.decompress(self._read(tail["at"], tail["size"])), 0
        for name, (kind, count) in tail["arrays"].items():
            x = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += x.nbytes
            setattr(self, name, x.reshape(-1, tail["width"]) if name == "chunks" else x)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, *sizes = self.chunks[k].tolist()
        raw, planes = self._read(at, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(planes, n, self.bits)

    def ids(self, doc: int) -> np.ndarray:
        """Ids of the file's document number ``doc``, from the chunks that hold them."""
        a, b = int(self.starts[doc]), int(self.starts[doc + 1])
        if a == b:
            return np.zeros(0, np.uint32)
        first, last = a // self.per_chunk, (b - 1) // self.per_chunk
        got = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return got[a - first * self.per_chunk : b - first * self.per_chunk]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, with one chunk in memory beside the document at hand."""
        held, left = np.zeros(0, np.uint32), iter(range(len(self.chunks)))
        for doc_id, null, size in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.sizes.tolist()):
            parts, need = [], size
            while need:
                if not len(held):
                    held = self.chunk(next(left))
                parts.append(held[:need])
                need -= len(parts[-1])
                held = held[len(parts[-1]) :]
            yield None if null else doc_id, np.concatenate(parts) if parts else held[:0]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and path for a folder's URI as Hadoop writes it.

    ``file``, ``hdfs``, ``viewfs``, ``s3``, ``gs`` and ``abfs`` go as they are; Hadoop's names of the
    same stores (``s3a``, ``s3n``, ``abfss``) are Arrow's ``s3`` and ``abfs``.
    """
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + mark + rest)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, *, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, partitions: int | None = None) -> DataFrame:
    """Encode ``docs`` and write one file a range of ids to the folder ``path``.

    Documents are range-partitioned by (id, hash of the text), so one id that holds many rows is
    split as well. Gives the manifest: file, part (ascending in id order), n_docs, n_ids. A file
    is written under a name of its task attempt and then renamed, so retries are harmless. The
    manifest has one row a file; it is computed when it is read.
    """
    spark = docs.sparkSession
    n = partitions or shuffle_partitions(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = base.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        task = TaskContext.get()
        part = task.partitionId()
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}.qids"
        own = f"{root}/.part-{part:06d}-{task.taskAttemptId()}"
        writer = None
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            ids_of = encoder(tokenizer).encode(batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of):
                if writer is None:
                    out = fs.open_output_stream(own)
                    writer = IdWriter(out, bits)
                writer.add(doc_id, ids if end_id is None else np.append(ids, np.uint32(end_id)))
        if writer is None:
            return
        total = writer.close()
        out.close()
        fs.move(own, name)
        row = {"file": [name], "part": [part], "n_docs": [len(writer.sizes)], "n_ids": [total]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return ranged.mapInArrow(write, "file string, part long, n_docs long, n_ids long")


def read_ids(spark, path: str, manifest: list[tuple[str, int]]) -> DataFrame:
    """Read the files of ``manifest`` (file, ids before it) back.

    One row a document: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers) and file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(manifest, "file string, base long").repartition(len(manifest), "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = file_system(path)
        for files in batches:
            for file, base in zip(files.file, files.base):
                with fs.open_input_file(file) as f:
                    reader = IdReader(f, f.size())
                    crcs = [zlib.crc32(ids.tobytes()) for _, ids in reader.documents()]
                ids = pd.array(reader.doc_ids, dtype="Int64")
                ids[reader.nulls.astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": reader.starts[:-1] + base, "n_tokens": reader.sizes, "ids_crc32": np.array(crcs, np.int64), "file": file})

    return files.mapInPandas(read, schema)


def bitplane_round_trip(docs: DataFrame, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, path: str | None = None) -> DataFrame:
    """Write the ids of ``docs`` in the file format, read the files back and describe them.

    Only the manifest (a row a file) reaches the driver, for the ids before each file.
    """
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "ids")
    made = sorted(write_ids(docs, path, tokenizer, end_id, id_col=id_col, text_col=text_col, bits=bits).collect(), key=lambda r: r["part"])
    base, manifest = 0, []
    for row in made:
        manifest.append((row["file"], base))
        base += row["n_ids"]
    return read_ids(spark, path, manifest).drop("file")


def describe_bytes(data: bytes) -> list[tuple[int | None, list[int]]]:
    """All documents of a file held in memory."""
    return [(d, ids.tolist()) for d, ids in IdReader(io.BytesIO(data), len(data)).documents()]
