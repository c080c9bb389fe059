"""Token ids in seekable binary files: one zstandard frame a document.

A file holds, in this order, the frames of its documents, an index and a seek
table.  A frame is a document's ids as little-endian unsigned 32-bit numbers,
compressed by itself with a content checksum; a document of more than
``FRAME_BYTES`` takes several.  The index is a skippable frame (magic
0x184D2A5D) with a zstandard frame of 13 bytes a document: id (signed 64 bits),
whether it is null (8 bits), number of frames (32 bits).  The seek table is the
skippable frame of the seekable zstandard format: per frame its compressed and
uncompressed size and the low 32 bits of the XXH64 of its content, then the
number of frames, a descriptor with the checksum bit, and 0x8F92EAB1.  Any
zstandard tool decompresses a file as one stream; ``TokenFile`` reads the last
bytes first and then only the frames it is asked for.

Documents are dealt out by ranges of ``doc_id`` (null first), equal ids by a
hash of the text and a number of the row, so file order is id order, and neither
an id nor a row that repeats is too large for a task.
A file is written under a name of the attempt and moved to its own, so a task
that runs again replaces its file by the same bytes.  Files go through Arrow's
file systems to any shared folder; one without a scheme is on Spark's default file
system, like the tables.  Null counts as empty text: the end id alone.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcemine.llm import tokens
from sourcemine.llm.common import stored
from sourcemine.storage import new_scratch_path

END_ID = 2
FRAME_BYTES = 1 << 22
INDEX_MAGIC, TABLE_MAGIC, TABLE_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
_ENTRY, _DOCUMENT = struct.Struct("<III"), struct.Struct("<qBI")


def file_system(uri: str):
    """Arrow's file system for a folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if re.match("file:/(?!/)", uri) else uri


def write_file(out, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write ids of documents to a binary stream: number of documents and ids."""
    import xxhash
    import zstandard

    pack = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
    table, index = bytearray(), bytearray()
    frames = n_documents = n_ids = 0
    for doc_id, ids in documents:
        count = 0
        for at in range(0, len(ids), FRAME_BYTES):
            part = ids[at : at + FRAME_BYTES]
            frame = pack.compress(part)
            out.write(frame)
            table += _ENTRY.pack(len(frame), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF)
            count += 1
        index += _DOCUMENT.pack(doc_id or 0, doc_id is None, count)
        frames, n_documents, n_ids = frames + count, n_documents + 1, n_ids + len(ids) // 4
    body = pack.compress(bytes(index))
    out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
    table += struct.pack("<IBI", frames, 0x80, TABLE_END)
    out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
    return n_documents, n_ids


class TokenFile:
    """Reads documents of one file; ``source`` is a seekable binary stream."""

    def __init__(self, source, size: int):
        import zstandard

        self.source = source
        self.unpack = zstandard.ZstdDecompressor()
        frames, described, mark = struct.unpack("<IBI", self._at(size - 9, 9))
        if mark != TABLE_END or described != 0x80:
            raise ValueError("no seek table at the end")
        start = size - 9 - frames * _ENTRY.size
        if struct.unpack("<II", self._at(start - 8, 8)) != (TABLE_MAGIC, frames * _ENTRY.size + 9):
            raise ValueError("the seek table has another length")
        entries = np.frombuffer(self._at(start, frames * _ENTRY.size), dtype="<u4").reshape(-1, 3)
        self.packed, self.sizes, self.sums = entries.T
        self.places = np.concatenate([[0], np.cumsum(self.packed.astype(np.int64))])
        place = int(self.places[-1])
        magic, length = struct.unpack("<II", self._at(place, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no index of documents")
        index = self.unpack.decompress(self._at(place + 8, length))
        rows = np.frombuffer(index, dtype=[("id", "<i8"), ("none", "u1"), ("n", "<u4")])
        self.doc_ids = [None if none else int(i) for i, none in zip(rows["id"], rows["none"])]
        self.first = np.concatenate([[0], np.cumsum(rows["n"].astype(np.int64))])

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def document(self, k: int) -> bytes:
        """Ids of the k-th document; reads and checks its own frames only."""
        import xxhash

        parts = []
        for f in range(int(self.first[k]), int(self.first[k + 1])):
            data = self.unpack.decompress(self._at(int(self.places[f]), int(self.packed[f])))
            if len(data) != self.sizes[f] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[f]:
                raise ValueError(f"frame {f} does not match its checksum")
            parts.append(data)
        return b"".join(parts)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = tokens.WORD, end_id: int = END_ID) -> DataFrame:
    """Write ``doc_id, text`` to files; the manifest, stored: ``part`` (order of
    the files), ``file``, ``n_documents``, ``n_ids``."""
    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, tokens.FEWER_CHUNKS)
        end = end_id.to_bytes(4, "little")
        rows = ((i, encoder.encode(t) + end) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        head = next(rows, None)
        if head is None:
            return
        files, path = file_system(folder)
        part = TaskContext.get().partitionId()
        name = f"{path}/tokens-{part:06d}.zst"
        attempt = f"{name}.{uuid.uuid4().hex}"
        files.create_dir(path, recursive=True)
        with files.open_output_stream(attempt) as out:
            n_documents, n_ids = write_file(out, (x for rest in ([head], rows) for x in rest))
        files.move(attempt, name)
        columns = [[part], [os.path.basename(name)], [n_documents], [n_ids]]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["part", "file", "n_documents", "n_ids"])

    key = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    row = F.monotonically_increasing_id().alias("row")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row)
    ordered = ordered.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")
    return stored(ordered.mapInArrow(write, "part bigint, file string, n_documents bigint, n_ids bigint"), "manifest")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    folder = qualified(manifest.sparkSession, folder)
    # One row a file: what lies before it in the order of files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    cores = manifest.sparkSession.sparkContext.defaultParallelism

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, path = file_system(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with shared.open_input_file(f"{path}/{name}") as source:
                    tokens_of = TokenFile(source, source.size())
                    out: list[list[int]] = [[], [], []]
                    for k in range(len(tokens_of.doc_ids)):
                        ids = tokens_of.document(k)
                        for column, value in zip(out, (start, len(ids) // 4, zlib.crc32(ids))):
                            column.append(value)
                        start += len(ids) // 4
                    columns = [pa.array(x, pa.int64()) for x in (tokens_of.doc_ids, *out)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    dealt = files.select("file", "before").repartition(max(cores, 2 * cores), "file")
    return dealt.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the files and read them back."""
    folder = folder or new_scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder), folder)
