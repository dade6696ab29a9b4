"""Best-fit packing of token sequences.

Best-fit decreasing places each document, longest first, into the open bin
with the least room that still takes it. Bins of equal room are alike and so
are documents of equal length, so the run is made over *counts*: the corpus is
reduced to a histogram of piece lengths (at most ``limit`` values), and a
segment tree over remaining capacities finds the tightest open class of bins
in logarithmic time for a whole run of equal documents. The outcome is that of
placing the documents one by one. What comes out is a list of runs (length,
ranks, bins, offset), whose number is bounded by ``limit`` alone; each piece
finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save
from . import bytesops as B
from .tokens import Encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Rows of one length that are numbered in one task, about.
RANKED = 1_000_000


def _kept(table: DataFrame, keep: tuple[str, ...]) -> str:
    """The columns that go along, as the end of a schema."""
    return "".join(f", `{c}` {table.schema[c].dataType.simpleString()}" for c in keep)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every text, append ``end_id`` and cut what is longer than ``limit`` into pieces of that length.

    A null or empty text is the end id alone. Repeated rows give repeated
    pieces. Only ``doc_id``, ``text`` and the columns ``keep``, which every
    piece repeats, are read, whatever else the table has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in batches:
            for a, b in B.slices(batch.column(1)):
                ids, off = encoder.encode(batch.column(1).slice(a, b - a))
                doc, piece, start, length, crc, of = [], [], [], [], [], []
                raw, end = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
                for r, (row, (x, y)) in enumerate(zip(batch.column(0).slice(a, b - a).to_pylist(), zip(off[:-1].tolist(), off[1:].tolist())), a):
                    n = y - x + 1
                    for k, at in enumerate(range(0, n, limit)):
                        to = min(at + limit, n)
                        c = zlib.crc32(raw[4 * (x + at) : 4 * (x + min(to, n - 1))])
                        doc.append(row)
                        of.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(to - at)
                        crc.append(zlib.crc32(end, c) if to == n else c)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc)), *(batch.column(2 + k).take(pa.array(of, pa.int64())) for k in range(len(keep)))], names=["doc_id", "piece", "start", "length", "ids_crc32", *keep])

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, PIECES + _kept(docs, keep))


class CapacityTree:
    """A segment tree over capacities 0..limit that finds the least capacity of at least some size at which bins are open."""

    def __init__(self, limit: int):
        self.size = 1 << (limit + 1).bit_length()
        self.open = np.zeros(2 * self.size, dtype=bool)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def tightest(self, least: int) -> int:
        """The least open capacity >= ``least``, or -1."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Run:
    """Pieces ``first_rank``.. of one length: ``per_bin`` to a bin, from bin ``first_bin`` on, the first at ``offset``."""

    length: int
    first_rank: int
    first_bin: int
    per_bin: int
    offset: int


def best_fit(counts: dict[int, int], limit: int) -> tuple[list[Run], int]:
    """Best-fit decreasing over a histogram of lengths; the runs, and the number of bins."""
    tree, classes, runs, bins = CapacityTree(limit), {}, [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            classes.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= limit:
            raise ValueError(f"a piece of {length} tokens does not fit {limit}")
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:  # open new bins, as many as the rest takes
                capacity = limit
                n = -(-left // (limit // length))
                first, bins = bins, bins + n
            else:
                first, n = classes[capacity].pop()
                if not classes[capacity]:
                    del classes[capacity]
                    tree.set(capacity, False)
            per_bin = capacity // length
            full = min(n, left // per_bin)
            runs.append(Run(length, rank, first, per_bin, limit - capacity))
            put(capacity - per_bin * length, first, full)
            placed, used = full * per_bin, full
            if full < n and placed < left:  # the last pieces share one bin
                rest = left - placed
                put(capacity - rest * length, first + full, 1)
                placed, used = left, full + 1
            put(capacity, first + used, n - used)
            left -= placed
            rank += placed
    return runs, bins


def pack(pieces: DataFrame, limit: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Give each piece (columns of ``PIECES`` and ``keep``) its sequence and its offset there.

    Ties between equal lengths go by doc_id and piece; any order gives as many
    sequences. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = save(pieces, "pieces")
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    runs, _ = best_fit(by_length, limit)
    runs.sort(key=lambda r: (r.length, r.first_rank))
    table = spark.sparkContext.broadcast(np.array([(r.length, r.first_rank, r.first_bin, r.per_bin, r.offset) for r in runs], np.int64).reshape(-1, 5))

    # Ranks within a length, numbered by salted parts so that a common length does not meet in one task.
    salts = max(16, sum(by_length.values()) // RANKED)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(parts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"), *keep)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        key = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            j = rank - runs[at, 1]
            seq = runs[at, 2] + j // runs[at, 3]
            offset = runs[at, 4] + (j % runs[at, 3]) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(seq), pa.array(offset), *batch.columns[6:]], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *keep])

    return ranked.mapInArrow(place, PLACED + _kept(pieces, keep))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limit: int = 4096, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokenise and pack whole documents into sequences of at most ``limit`` tokens; one row per piece.

    ``docs`` has doc_id and text; null texts count as empty (the end id alone).
    Pieces repeat the columns ``keep`` of their documents.
    """
    return pack(token_pieces(docs, tokenizer, end_id, limit, keep), limit, keep)
