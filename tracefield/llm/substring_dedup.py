"""Removal of passages that stand elsewhere too, by FM-index shards.

A window is ``WINDOW`` successive words. Every window names an anchor, the
least hash of its runs of ``ANCHOR`` words; equal windows have equal anchors at
equal places. Successive windows with one anchor make a segment, so each window
of the corpus stands in exactly one segment. Segments are sharded by anchor:

1. Anchors that stand once in the corpus are dropped; their windows are unique.
2. Equal segments are one, with the number of times that they stand there.
3. A shard's FM-index is built over its segments, with a mark on those that
   stand twice or more, which then count twice. Every segment of the documents is streamed against the
   index of its shard: the matching statistics tell for its ends how long a run
   before them occurs twice, and runs of ``WINDOW`` words or more are reported.
4. Each document gets the windows found and loses the words that they cover.

An anchor with so many different segments that they would make a shard of their
own (those of a passage that stands in very many documents) is not kept in one
place: its segments are taken apart into windows, sharded by the window's outer
words as well, and equal windows are added up on their way there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, save
from . import bytesops as B
from .fm_index import FMIndex
from .skew import join_one

WINDOW, ANCHOR = 35, 8
SPREAD = WINDOW - ANCHOR + 1
#: Words of one FM-index, about.
SHARD_WORDS = 1 << 18
#: Different segments of one anchor beyond which they are taken apart; so many make an index or two.
CROWDED = 1 << 13
SEGMENTS = "doc long, hash long, at int, windows int, anchor long, segment long"


def _keyed(docs: DataFrame) -> DataFrame:
    """A row's key is its doc_id and its text's hash: rows that repeat a doc_id with another text are told apart, equal rows have equal results."""
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("hash", F.xxhash64("text"))


def segments_of(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first word (in the slice), number of windows, anchor and hash of each segment of word hashes ``h``."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = len(h) - WINDOW + 1
    if n <= 0:
        return none
    row = B.rows_of(first)
    g = B.grams(h, ANCHOR)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(at):
        return none
    view = np.lib.stride_tricks.sliding_window_view(g, SPREAD)
    anchor = np.empty(len(at), np.int64)
    for a in range(0, len(at), 1 << 16):
        anchor[a : a + (1 << 16)] = view[at[a : a + (1 << 16)]].argmin(1)
    anchor += at
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)]
    start = at[new]
    windows = np.diff(np.append(np.flatnonzero(new), len(at)))
    return row[start], start, windows, g[anchor[new]], B.run_hashes(h, start, start + windows + WINDOW - 1)


def segment_table(docs: DataFrame) -> DataFrame:
    """All segments of all rows; words of ``at`` are counted from the row's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.slices(batch.column(2)):
                data, offsets = B.buffer(batch.column(2).slice(a, b - a))
                starts, ends, first = B.words(data, offsets)
                row, at, windows, anchor, segment = segments_of(B.span_hashes(data, starts, ends), first)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array((at - first[row]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))],
                    names=["doc", "hash", "at", "windows", "anchor", "segment"],
                )

    return _keyed(docs).select("doc", "hash", "text").mapInArrow(run, SEGMENTS)


CONTENT = "shard long, anchor long, segment long, skip int, unit long, n long, words binary"


def segment_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The units of the segments that ``wanted`` (doc, hash, list of at, windows, anchor, segment, n, crowded) names, with their word hashes.

    A segment is a unit, or, where its anchor is crowded, each of its windows;
    ``skip`` tells which window a unit begins with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            for a, b in B.slices(batch.column(0)):
                data, offsets = B.buffer(batch.column(0).slice(a, b - a))
                starts, ends, first = B.words(data, offsets)
                h = B.span_hashes(data, starts, ends)
                rows = []
                for k in range(a, b):
                    for s in lists[k].as_py():
                        x = int(first[k - a]) + s["at"]
                        if not s["crowded"]:
                            rows.append((s["anchor"], s["anchor"], s["segment"], 0, s["segment"], s["n"], h[x : x + s["windows"] + WINDOW - 1].tobytes()))
                            continue
                        at = x + np.arange(s["windows"])
                        units = B.run_hashes(h, at, at + WINDOW).view(np.int64).tolist()
                        outer = (B.run_hashes(h, at, at + 4) * np.uint64(B.BASE) + B.run_hashes(h, at + WINDOW - 4, at + WINDOW)).view(np.int64).tolist()
                        for j, (unit, shard) in enumerate(zip(units, outer)):
                            rows.append((s["anchor"] ^ shard, s["anchor"], s["segment"], j, unit, s["n"], h[x + j : x + j + WINDOW].tobytes()))
                columns = list(zip(*rows)) or [[]] * 7
                kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "anchor", "segment", "skip", "unit", "n", "words"])

    rows = _keyed(docs).select("doc", "hash", "text").join(wanted, ["doc", "hash"]).dropDuplicates(["doc", "hash"])
    return rows.select("text", "wanted").mapInArrow(run, CONTENT)


def repeated_in_shard(words: list[np.ndarray], often: np.ndarray) -> list[np.ndarray]:
    """For each unit of a shard, which of its windows occur twice there; a unit that is ``often`` there counts twice."""
    lengths = np.array([len(w) for w in words])
    _, symbols = np.unique(np.concatenate(words), return_inverse=True)
    text = np.zeros(int(lengths.sum()) + len(words), np.int64)
    place = np.cumsum(np.r_[0, lengths[:-1] + 1])
    inside = np.ones(len(text), bool)
    inside[place + lengths] = False
    text[inside] = symbols + 1
    index = FMIndex(text, 2 * WINDOW, np.repeat(often, lengths + 1))
    out = [np.zeros(n - WINDOW + 1, bool) for n in lengths]
    # Ranges of windows that are not decided yet, each with the window that is asked for next. A run that occurs twice
    # decides all windows within it, and one that does not all windows around it: so the ends of a unit are asked first,
    # and then the middles of what is left.
    unit, low, high = np.arange(len(words)), np.zeros(len(words), np.int64), lengths - WINDOW
    ask, round_ = np.where(often, high, low), 0
    while len(unit):
        end = ask + WINDOW
        length = index.matching_lengths(text, place[unit] + end, end - low)
        found = length >= WINDOW
        # Windows first to last are decided.
        first = np.where(found, end - length, ask)
        last = np.where(found, ask, np.minimum(end - length - 1, high))
        for k, x, y in zip(unit[found].tolist(), first[found].tolist(), last[found].tolist()):
            out[k][x : y + 1] = True
        before, after = first > low, last < high
        unit = np.r_[unit[before], unit[after]]
        low, high, found = np.r_[low[before], last[after] + 1], np.r_[first[before] - 1, high[after]], np.r_[found[before], found[after]]
        ask = np.where(found, high, low) if not round_ else (low + high + 1) // 2
        round_ += 1
    return out


def judge_shards(content: DataFrame) -> DataFrame:
    """shard, unit and (skip, number) of the runs of repeated windows of all units (shard, unit, n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[tuple]) -> pa.RecordBatch:
            marks = repeated_in_shard([np.frombuffer(r[3], np.uint64) for r in rows], np.array([r[2] > 1 for r in rows]))
            out = []
            for r, mark in zip(rows, marks):
                if mark.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, mark.astype(np.int8), 0]))
                    out += [(r[0], r[1], int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
            columns = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["shard", "unit", "first", "number"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD_WORDS and r[0] != held[-1][0]:
                    yield judged(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3]) // 8
        if held:
            yield judged(held)
        B.trim()

    dealt = content.select("shard", "unit", "n", "words").repartition("shard").sortWithinPartitions("shard", "unit")
    return dealt.mapInArrow(run, "shard long, unit long, first int, number int")


def cover(words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of a row's words the windows (first, number) cover."""
    change = np.zeros(words + 1, np.int32)
    for first, number in spans:
        change[first] += 1
        change[first + number + WINDOW - 1] -= 1
    return np.cumsum(change[:-1]) > 0


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc, hash (see the keys of rows) and ``spans`` (first window, number of windows) of all rows with a repeated window."""
    table = save(segment_table(docs), "segments")
    kinds = save(table.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("doc", "hash", "at", "windows")).alias("one")), "kinds")
    anchors = kinds.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).filter(F.col("all") > 1)
    wanted = join_one(kinds, anchors.select("anchor", (F.col("kinds") > CROWDED).alias("crowded")), ["anchor"])
    wanted = wanted.select("one.*", "anchor", "segment", "n", "crowded").groupBy("doc", "hash").agg(F.collect_list(F.struct("at", "windows", "anchor", "segment", "n", "crowded")).alias("wanted"))  # at most a document's own segments
    content = save(segment_words(docs, wanted), "content")
    discard(kinds)
    # Windows of crowded anchors are added up before they meet; a segment stands alone.
    alone = content.filter(F.col("shard") == F.col("anchor")).select("shard", "unit", "n", "words")
    windows = content.filter(F.col("shard") != F.col("anchor")).groupBy("shard", "unit").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
    judged = save(judge_shards(alone.unionByName(windows)), "judged")
    # From units back to segments, and from these to their places; what is a window's meets no segment.
    whole = judged.select(F.col("shard").alias("anchor"), F.col("unit").alias("segment"), F.col("first").alias("skip"), "number")
    parts = join_one(content.filter(F.col("shard") != F.col("anchor")).select("shard", "unit", "anchor", "segment", "skip"), judged.select("shard", "unit", "number"), ["shard", "unit"])
    found = whole.unionByName(parts.select("anchor", "segment", "skip", "number"))
    found = save(found.groupBy("anchor", "segment").agg(F.collect_list(F.struct("skip", "number")).alias("runs")), "found")  # at most a segment's own windows
    discard(content, judged)
    spans = join_one(table, found, ["anchor", "segment"]).select("doc", "hash", "at", F.explode("runs").alias("run")).select("doc", "hash", (F.col("at") + F.col("run.skip")).alias("first"), "run.number")
    spans = save(spans.distinct().groupBy("doc", "hash").agg(F.collect_list(F.struct("first", "number")).alias("spans")), "spans")  # as above
    discard(table, found)
    return spans


def _each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` with their spans (null where there are none)."""
    spans = repeated_windows(docs)
    return _keyed(docs).select("doc", "hash", *columns).join(spans, ["doc", "hash"], "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row.

    A word goes if a window covers it whose words also start anywhere else.
    Null and empty texts have no words. Rows that are repeated lose whatever is
    long enough, as it stands in the other row too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(2)
            out = []
            for a, b in B.slices(batch.column(1)):
                data, offsets = B.buffer(batch.column(1).slice(a, b - a))
                starts, ends, first = B.words(data, offsets)
                raw = data.tobytes()
                for k in range(a, b):
                    x, y = int(first[k - a]), int(first[k - a + 1])
                    spans = lists[k].as_py()
                    gone = cover(y - x, [(s["first"], s["number"]) for s in spans]) if spans else np.zeros(y - x, bool)
                    kept = b" ".join(raw[i:j] for i, j in zip(starts[x:y][~gone].tolist(), ends[x:y][~gone].tolist()))
                    out.append((ids[k], y - x, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _each(docs, ["doc_id", "text"])
    return rows.select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
