"""Token files: independent zstandard frames with a trailing seek table.

A shard is a sequence of zstandard frames, each holding the ids of whole
documents as little-endian unsigned 32-bit integers. Two skippable frames
follow: the document index (for each document its id, its frame and its
number of ids) and, last, the seek table of the public seekable format, with
both sizes and a checksum of every frame. A reader takes the footer, then the
two tables, then only the frames of the documents that it wants. Any
zstandard tool can decompress a shard whole.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryweb.llm.common import bounded_batches, own_folder, table
from quarryweb.llm.tokens import VOCABULARY, encoder

#: Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
HAS_CHECKSUMS = 0x80
ENTRY = np.dtype([("packed", "<u4"), ("unpacked", "<u4"), ("checksum", "<u4")])
DOCUMENT = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("ids", "<u4")])

FRAME_BYTES, MOST_FRAME = 1 << 20, 1 << 32


def _low32(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def write_shard(out, documents: Iterable[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 3) -> tuple[int, int]:
    """Writes (doc_id, ids) in the given order to a binary stream; returns the numbers of documents and ids.

    A frame is closed once it has frame_bytes; a document is never split, so a
    longer one has a frame of its own. Sizes in the seek table have 32 bits,
    so a document of 4 GiB of ids or more raises ValueError. Memory: one frame
    and the index.
    """
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
    entries, index, frame, size, total = [], [], [], 0, 0

    def close() -> None:
        nonlocal frame, size
        if frame:
            if size >= MOST_FRAME:
                raise ValueError("a document has more ids than a frame can hold")
            data = b"".join(frame)
            packed = packer.compress(data)
            out.write(packed)
            entries.append((len(packed), len(data), _low32(data)))
            frame, size = [], 0

    for doc_id, ids in documents:
        if frame and size + len(ids) > frame_bytes:
            close()
        index.append((doc_id or 0, doc_id is not None, len(entries), len(ids) // 4))
        frame.append(ids)
        size += len(ids)
        total += len(ids) // 4
    close()
    body = packer.compress(np.array(index, DOCUMENT).tobytes())
    out.write(struct.pack("<II", SKIPPABLE, len(body)) + body + struct.pack("<I", len(body)))
    seek = np.array(entries, ENTRY).tobytes() + FOOTER.pack(len(entries), HAS_CHECKSUMS, SEEKABLE)
    out.write(struct.pack("<II", SEEK_TABLE, len(seek)) + seek)
    return len(index), total


class ShardReader:
    """Random access to a shard through a seekable binary file."""

    def __init__(self, file, size: int):
        self.file, self.frames_read = file, 0
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or flags != HAS_CHECKSUMS:
            raise ValueError("not a token shard: its seek table is missing or of another kind")
        table_bytes = count * ENTRY.itemsize
        head = size - FOOTER.size - table_bytes - 8
        if struct.unpack("<II", self._at(head, 8)) != (SEEK_TABLE, table_bytes + FOOTER.size):
            raise ValueError("the seek table's head is damaged")
        self.entries = np.frombuffer(self._at(head + 8, table_bytes), ENTRY)
        (length,) = struct.unpack("<I", self._at(head - 4, 4))
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._at(head - 4 - length, length)), DOCUMENT)
        self.at = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.index["ids"], dtype=np.int64)])[:-1] if len(self.index) else np.zeros(0, np.int64)

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the shard is shorter than its tables say")
        return data

    def frame(self, k: int) -> bytes:
        self.frames_read += 1
        e = self.entries[k]
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(e["packed"])), max_output_size=int(e["unpacked"]))
        if len(data) != e["unpacked"] or _low32(data) != e["checksum"]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the shard, ids) in file order, of all documents or those with a wanted id."""
        k, data, base = -1, b"", 0
        for row, start in zip(self.index.tolist(), self.starts.tolist(), strict=True):
            doc_id, has_id, frame, n = row
            if frame != k and (wanted is None or has_id and doc_id in wanted):
                data, k = self.frame(frame), frame
                base = int(self.starts[np.searchsorted(self.index["frame"], frame)])
            if wanted is None or has_id and doc_id in wanted:
                yield (doc_id if has_id else None), start, data[(start - base) * 4 : (start - base + n) * 4]


def _opened(uri: str):
    """The file system and the path of a URI, or of a local path."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, vocabulary: str = VOCABULARY, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Encodes every whole text and writes shards under path, in ascending order of id_col; returns the manifest.

    One range exchange of the texts orders them; each task then encodes and
    writes its own shard under a name of its attempt, and the manifest (a
    small Parquet table beside the shards) lists the shards of successful
    attempts only, so retries and lost executors leave no wrong data. Null
    ids come first, equal ids stay separate documents (by text), null texts
    are empty, an empty table gives an empty manifest; other columns are not
    written.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(key.alias("doc_id"), text.alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = _opened(path)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.tokens.zst"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        encode, end = encoder(vocabulary).encode, np.array([end_id], "<u4").tobytes()

        def documents():
            for batch in (b for part in ([first], batches) for b in part):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield doc_id, encode(text.as_py()) + end

        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            n, ids = write_shard(out, documents(), frame_bytes)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "file": [name], "n_docs": [n], "n_ids": [ids]})

    spark.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{path}/created")  # makes the folder, by Spark's own file system
    made = rows.mapInArrow(write, "shard int, file string, n_docs long, n_ids long")
    made.write.parquet(f"{path}/manifest")
    return spark.read.schema("shard int, file string, n_docs long, n_ids long").parquet(f"{path}/manifest")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary) of all documents, or of those in doc_ids.

    The manifest has one row for each shard, so the driver adds up where each
    begins. Checksums of all frames that are read are verified.
    """
    shards, base, wanted = [], 0, None if doc_ids is None else frozenset(doc_ids)
    for r in sorted(spark.read.schema("shard int, file string, n_docs long, n_ids long").parquet(f"{path}/manifest").collect()):
        shards.append((r.file, base))
        base += r.n_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _opened(path)
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                info = store.get_file_info(f"{folder}/{name}")
                with store.open_input_file(f"{folder}/{name}") as file:
                    rows, size = [], 0
                    for doc_id, start, ids in ShardReader(file, info.size).read(wanted):
                        rows.append((doc_id, before + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 8 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    yield _rows(rows)

    def _rows(rows):
        a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame(shards, "file string, before long")
    return listed.repartition(max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents in the file format, reads the files back, and digests what they hold."""
    path = f"{own_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
