"""Token ids in Arrow IPC files of equal-length sequences.

A file is one Arrow IPC file (the stream's batches and a footer, so that any
batch can be reached directly) whose columns ``ids`` and ``mask`` are
fixed-size lists: row r of a batch holds ids r*L.. of the file's ids without a
gap, and the mask tells ids from the padding of the last row. The buffers are
neither compressed nor encoded, so that a memory map gives sequences without a
copy. A second small IPC file beside it says where each document begins.

Files are written by range of doc_id, each under a name of its own attempt and
then moved to its final name: a task that runs again writes the same file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import save, work_dir
from . import bytesops as B
from .tokens import Encoder

#: Ids in a sequence, sequences in a record batch.
SEQUENCE, BATCH = 2048, 256
#: Bytes of text that go to one file, about.
FILE_BYTES = 32 << 20
MANIFEST = "part int, n_docs long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI and the path there; plain paths and file: are a mounted shared disk."""
    uri = urlparse(folder)
    if uri.scheme in ("", "file"):
        return pafs.LocalFileSystem(use_mmap=True), uri.path
    return pafs.FileSystem.from_uri(folder)


class SequenceWriter:
    """Writes ids to one file, and the documents' places to the file beside it."""

    def __init__(self, folder: str, part: int, length: int, dtype: str):
        self.fs, self.root = file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.length, self.attempt = part, length, uuid.uuid4().hex
        self.dtype = np.dtype(dtype)
        item = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
        self.out = self.fs.open_output_stream(self._name("ids", self.attempt))
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.side_out = self.fs.open_output_stream(self._name("docs", self.attempt))
        self.side = pa.ipc.new_file(self.side_out, self.index)
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = self.docs = 0

    def _name(self, kind: str, attempt: str = "") -> str:
        return f"{self.root}/{kind}-{self.part:06d}.arrow" + (f".{attempt}" if attempt else "")

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        offsets = self.tokens + np.cumsum(lengths) - lengths
        self.side.write_batch(pa.record_batch([doc_ids, pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], schema=self.index))
        self.held.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        self.tokens += len(ids)
        self.docs += len(lengths)
        if self.waiting >= self.length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        step = self.length * BATCH
        whole = len(ids) if last else len(ids) // step * step
        for at in range(0, whole, step):
            self._write(ids[at : min(at + step, whole)])
        self.held, self.waiting = [ids[whole:].copy()], len(ids) - whole

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        full = np.zeros(rows * self.length, self.dtype)
        full[: len(ids)] = ids
        mask = np.arange(rows * self.length) < len(ids)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(full), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> tuple[int, int]:
        self._flush(True)
        for x in (self.file, self.out, self.side, self.side_out):
            x.close()
        for kind in ("ids", "docs"):
            self.fs.move(self._name(kind, self.attempt), self._name(kind))
        return self.docs, self.tokens


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, sequence: int = SEQUENCE) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids below ``folder`` in ascending doc_id order.

    Returns the manifest (one row a file): part, n_docs, n_tokens and the
    number ``start`` of ids in all files before it. Null texts count as empty.
    Repeated doc_ids stand side by side, in the order of their texts; a null
    doc_id comes first. An empty table gives no files. Rows of one doc_id with
    texts that begin differently may be dealt over several files.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // FILE_BYTES))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, writer = Encoder.of(tokenizer), TaskContext.get().partitionId(), None
        dtype = "uint16" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "uint32"
        for batch in batches:
            for a, b in B.slices(batch.column(1)):
                writer = writer or SequenceWriter(folder, part, sequence, dtype)
                ids, off = encoder.encode(batch.column(1).slice(a, b - a))
                lengths = np.diff(off) + 1
                out = np.full(len(ids) + len(lengths), end_id, np.uint32)
                inner = np.ones(len(out), bool)
                inner[np.cumsum(lengths) - 1] = False
                out[inner] = ids
                writer.add(batch.column(0).slice(a, b - a), out, lengths)
        B.trim()
        if writer:
            n, t = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([t], pa.int64())], names=["part", "n_docs", "n_tokens"])

    manifest = save(ordered.mapInArrow(run, MANIFEST), "manifest")
    # One row a file, so that one task can hold them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def open_ids(folder: str, part: int) -> tuple[pa.RecordBatchFileReader, pa.RecordBatchFileReader]:
    """The readers of a part's sequences and of its documents' places."""
    fs, root = file_system(folder)
    return tuple(pa.ipc.open_file(fs.open_input_file(f"{root}/{kind}-{part:06d}.arrow")) for kind in ("ids", "docs"))


def sequence_at(folder: str, part: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``row`` of a part and its mask, by direct access."""
    ids, _ = open_ids(folder, part)
    batch = ids.get_batch(row // BATCH)
    k = row % BATCH
    length = batch.schema.field("ids").type.list_size
    values = batch.column(0).flatten().to_numpy()[k * length : (k + 1) * length]
    return values, batch.column(1).slice(k, 1).flatten().to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, folder: str, files: int) -> DataFrame:
    """Read the files back: one row per document with the place of its ids among all, their number and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, docs = open_ids(folder, part)
                held, base, at = np.zeros(0, "<u4"), 0, 0  # ids from `base` on
                for i in range(docs.num_record_batches):
                    places = docs.get_batch(i)
                    offsets, lengths = places.column(1).to_numpy(), places.column(2).to_numpy()
                    crc = np.zeros(len(offsets), np.int64)
                    for k, (o, n) in enumerate(zip(offsets.tolist(), lengths.tolist())):
                        more = [held[o - base :]]
                        have = len(more[0])
                        while have < n:
                            more.append(ids.get_batch(at).column(0).flatten().to_numpy().astype("<u4"))
                            have += len(more[-1])
                            at += 1
                        if len(more) > 1:
                            held, base = np.concatenate(more), o
                        crc[k] = zlib.crc32(held[o - base : o - base + n].tobytes())
                    yield pa.RecordBatch.from_arrays([places.column(0), pa.array(start + offsets, pa.int64()), places.column(2), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("part", "start").repartition(max(1, files)).mapInArrow(run, RESULT)


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents to files and return what is read back from them."""
    spark: SparkSession = docs.sparkSession
    folder = folder or work_dir(spark, "tokens")
    manifest = encode_to_files(docs, tokenizer, end_id, folder)
    return read_documents(manifest, folder, manifest.count())


def local_path(folder: str) -> str:
    """The mounted path of a file: folder."""
    return os.path.normpath(urlparse(folder).path)
