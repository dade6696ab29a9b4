"""Language-model scores by logistic context mixing.

The model predicts a text bit by bit, from the high bit of each byte down. For
contexts of the last 0 to 4 and 6 bytes it counts bits. Their
predictions, as logits, are added up under weights that a gate chooses (by bit
and by how much the two longest contexts have seen); a last stage refines the
sum by what such predictions were worth in the corpus. A text is closed by one
end symbol (the byte 255, which UTF-8 lacks), so the scores are probabilities
of whole texts.

* Counts are sums over all training documents. They are exact and grow with
  the corpus: the distinct symbols in context of each group of documents are
  dealt over buckets by a hash of the last three bytes of their context, so
  that all counts of longer contexts are at hand within a bucket. Those of up
  to two bytes are broadcast; there are at most 2^24 of them.
* Weights are learned online within each bucket: its symbols are gone through
  in a fixed order, part by part; a part's bits are predicted from the counts
  *without* the bit at hand, and then a step is taken. The refining table is
  filled in the same pass, once the weights are warm. The model has the mean of
  the buckets' weights, by what each weight set saw.
* Scoring uses the finished model. Buckets depend on the corpus alone, and what
  they learned is added up in whole numbers, so that a score depends neither on
  the order nor on the partitioning of the table.

The unigram base score has its token counts by the same way: a group's distinct
tokens go to buckets by their hashes, and their counts come back. So there is
neither a broadcast vocabulary nor a join by token, and a frequent token is one
entry for each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, save
from . import bytesops as B

#: Bytes of context of each predictor.
CONTEXT = (0, 1, 2, 3, 4, 6)
ORDERS = len(CONTEXT)
END = 255
PAD = CONTEXT[-1]
#: Levels of what a context has seen, for the gate; weight sets (by two contexts' levels and the bit).
LEVELS = 4
SETS = LEVELS * LEVELS * 8
#: Buckets of a prediction in the refining table.
BUCKETS = 24
#: Share of a Newton step (by each weight alone) that a step takes; steps in a bucket.
RATE, STEPS = 0.15, 16
#: Costs are whole multiples of 1 / FINE bits, so that sums of them are exact.
FINE = 1024
#: Weights are added up as whole multiples of 1 / GRAIN, each weight set's by the bits that it saw.
GRAIN = 1024
#: Bytes of text whose symbols are sorted at a time, and of a group of documents.
SLICE, GROUP = 1 << 20, 8 << 20
#: Bytes of text for each bucket of contexts, and for each bucket of tokens.
BUCKET = 2 << 20
#: Bytes of context whose counts are broadcast at most.
SHORT = 2
#: Entries that a task holds before it adds up equal ones.
ENTRIES = 1 << 21
END_TOKEN = np.uint64(0xE0F0E0F0E0F0E0F1)


#: For each number of bytes before a symbol, the bits of its key that they and the symbol fill.
_FILLED = np.array([((((1 << 8 * j) - 1) << 8 * (PAD - j)) << 8) | 255 for j in range(PAD + 1)], np.uint64)


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of every symbol of all rows, and then those of the rows' end symbols.

    A key has the bytes of the context, the nearest first, and then the symbol:
    sorted keys have equal contexts side by side.
    """
    n, size = len(data), np.diff(offsets)
    out = np.zeros(n + len(size), np.uint64)
    if n:
        # The PAD bytes up to each place, by two, four and six.
        two = data.astype(np.uint64) << np.uint64(8)
        two[1:] |= data[:-1]
        before = two << np.uint64(32)
        before[2:] |= two[:-2] << np.uint64(16)
        before[4:] |= two[:-4]
        del two
        before <<= np.uint64(8)
        out[1:n] = before[:-1]
        out[:n] |= data
        for j in range(PAD):  # what is before a row is not its context
            at = offsets[:-1][size > j] + j
            out[at] &= _FILLED[j]
        some = size > 0
        out[n:][some] = before[offsets[1:][some] - 1] & _FILLED[np.minimum(size[some], PAD)]
    out[n:] &= ~np.uint64(255)
    out[n:] |= np.uint64(END)
    return out


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all rows' symbols, and how often each occurs."""
    return np.unique(symbols(data, offsets), return_counts=True)


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 0).astype(np.int64) + (n > 2) + (n > 12)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


@dataclass
class Mixer:
    weights: np.ndarray  # SETS x (ORDERS + 1), the last for a constant
    refined: np.ndarray  # (256 nodes * BUCKETS) x 2: bits that were 1, all
    seen: np.ndarray  # by weight set: the bits it was learned from

    @classmethod
    def new(cls) -> "Mixer":
        w = np.full((SETS, ORDERS + 1), 0.3)
        w[:, -1] = 0
        return cls(w, np.zeros((256 * BUCKETS, 2)), np.zeros(SETS))

    def totals(self) -> np.ndarray:
        """Whole numbers that may be added up in any order: what each set saw, the weights by it, the refining table."""
        seen = np.rint(self.seen).astype(np.int64)
        grains = np.rint(np.clip(self.weights, -8, 8) * GRAIN).astype(np.int64)
        return np.concatenate([seen, (grains * seen[:, None]).ravel(), np.rint(self.refined).astype(np.int64).ravel()])

    @classmethod
    def of_totals(cls, totals: np.ndarray) -> "Mixer":
        """The mixer of added-up totals; a set that nothing was learned for keeps its first weights."""
        out = cls.new()
        seen, weights, refined = np.split(totals, [SETS, SETS * (ORDERS + 2)])
        known = seen > 0
        out.weights[known] = weights.reshape(SETS, ORDERS + 1)[known] / (seen[known, None] * float(GRAIN))
        out.seen, out.refined = seen.astype(float), refined.reshape(-1, 2).astype(float)
        return out


@dataclass
class Counted:
    """Exact counts for some keys: by order and b, the symbols seen in the key's context whose first b bits are those of its symbol."""

    depths: np.ndarray  # ORDERS x 9 x keys

    def part(self, which: slice) -> "Counted":
        return Counted(self.depths[:, :, which])

    def bits(self, k: int, bit: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits seen at the node, and those that were 1."""
        n, same = self.depths[k, bit], self.depths[k, bit + 1]
        return n.astype(np.float32), np.where(y == 1, same, n - same).astype(np.float32)


def _of_order(keys: np.ndarray, k: int) -> np.ndarray:
    """The nearest bytes of an order's context, and the symbol."""
    return keys >> np.uint64(8 * (PAD + 1 - CONTEXT[k])) << np.uint64(8) | keys & np.uint64(255)


def short_of(keys: np.ndarray) -> np.ndarray:
    """The keys without the bytes of their contexts beyond SHORT."""
    return keys & np.uint64((((1 << 8 * SHORT) - 1) << 8 * (PAD + 1 - SHORT)) | 255)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times[order], first)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct keys, sorted (by sorting: several times as fast as a hash table here)."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys


def _depths(ids: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For sorted (context, symbol) ids, the sums of ``times`` over those that share the context and the symbol's first 0 to 8 bits."""
    out = np.zeros((9, len(ids)), np.int64)
    if len(ids):
        for b in range(9):
            p = ids >> np.uint64(8 - b)
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            out[b] = np.repeat(np.add.reduceat(times, first), np.diff(np.r_[first, len(ids)]))
    return out


def short_counts(ids: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and depths of each order of up to SHORT bytes, from the counts of :func:`short_of` keys."""
    found = [_summed(_of_order(ids, k), times) for k in range(ORDERS) if CONTEXT[k] <= SHORT]
    kind = np.int32 if times.sum() < 1 << 31 else np.int64
    return [(i, _depths(i, t).astype(kind)) for i, t in found]


def counted(keys: np.ndarray, times: np.ndarray, short: list[tuple[np.ndarray, np.ndarray]]) -> Counted:
    """The counts for all keys of a bucket."""
    out = np.empty((ORDERS, 9, len(keys)), short[0][1].dtype)
    for k in range(ORDERS):
        ids = _of_order(keys, k)
        if k < len(short):
            out[k] = short[k][1][:, np.searchsorted(short[k][0], ids)]
        elif k == ORDERS - 1:  # the keys themselves
            out[k] = _depths(keys, times)
        else:
            own, at = np.unique(ids, return_inverse=True)
            out[k] = _depths(own, np.bincount(at, times, len(own)).astype(np.int64))[:, at]
    return Counted(out)


def predictions(table: Counted, keys: np.ndarray, bit: int, own: bool):
    """For one bit of each key's symbol: the bit, its node, the logits of all orders and the weight set; ``own``: leave the bit at hand out of the counts."""
    symbol = (keys & np.uint64(255)).astype(np.int64)
    node = (256 + symbol) >> (8 - bit)
    y = ((symbol >> (7 - bit)) & 1).astype(np.float32)
    inputs = np.empty((ORDERS + 1, len(keys)), np.float32)
    inputs[-1] = 0.3
    seen = []
    for k in range(ORDERS):
        n, one = table.bits(k, bit, y)
        if own:
            n, one = np.maximum(n - 1, 0), np.maximum(one - y, 0)
        inputs[k] = np.log((one + np.float32(0.3)) / (np.maximum(n - one, 0) + np.float32(0.3)))
        seen.append(n)
    which = (_level(seen[-1]) * LEVELS + _level(seen[-2])) * 8 + bit
    return y, node, inputs, which


def _mixed(mixer: "Mixer", inputs: np.ndarray, which: np.ndarray) -> np.ndarray:
    z = mixer.weights[:, 0][which] * inputs[0]
    for k in range(1, ORDERS + 1):
        z += mixer.weights[:, k][which] * inputs[k]
    return z


def _bucket(node: np.ndarray, x: np.ndarray) -> np.ndarray:
    return node * BUCKETS + np.clip((x + 12) * (BUCKETS / 24), 0, BUCKETS - 1).astype(np.int64)


def learn(table: Counted, mixer: Mixer, keys: np.ndarray, times: np.ndarray, warm: bool) -> None:
    """One online step over some symbols, and their share of the refining table once the weights are warm."""
    for bit in range(8):
        y, node, x, which = predictions(table, keys, bit, own=True)
        z = _mixed(mixer, x, which)
        p = _squash(z)
        err, bend = (y - p) * times, (p * (1 - p) + 1e-3) * times
        for k in range(ORDERS + 1):
            g, h = np.bincount(which, err * x[k], SETS), np.bincount(which, bend * x[k] ** 2, SETS)
            mixer.weights[:, k] += np.clip(RATE * g / (h + 20.0), -0.3, 0.3)  # sets that are hardly touched move little
        mixer.seen += np.bincount(which, times, SETS)
        if warm:
            b = _bucket(node, z)
            mixer.refined[:, 0] += np.bincount(b, y * times, len(mixer.refined))
            mixer.refined[:, 1] += np.bincount(b, times, len(mixer.refined))


def bits_of(table: Counted, mixer: Mixer, keys: np.ndarray) -> np.ndarray:
    """The cost in bits of each key's symbol in its context, to 1 / FINE bits."""
    out = np.zeros(len(keys))
    for bit in range(8):
        y, node, x, which = predictions(table, keys, bit, own=False)
        z = _mixed(mixer, x, which)
        p = _squash(z)
        b = _bucket(node, z)
        one, n = mixer.refined[b, 0], mixer.refined[b, 1]
        p = np.clip(0.5 * p + 0.5 * (one + 2 * p) / (n + 2), 1e-6, 1 - 1e-6)
        out -= np.log2(np.where(y == 1, p, 1 - p))
    return np.rint(out * FINE) / FINE


def held_out(folds: int = 10):
    """Whether crc32 of the doc_id as text leaves no remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows and the n + 1 places of the rows in them."""
    low = B.lower(data)
    starts, ends, first = B.words(low, offsets)
    return B.span_hashes(low, starts, ends), first


NUMBERED = "group long, row long, doc_id long, train boolean, text string"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a number and that of their group: successive rows of about GROUP bytes.

    Groups only bundle what travels to the buckets and back; no result depends on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = len(batch)
            place = size + np.cumsum(np.diff(B.buffer(batch.column(2))[1]).astype(np.int64)) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((task << 36) + place // GROUP), pa.array((task << 36) + row + np.arange(n)), *batch.columns], names=["group", "row", "doc_id", "train", "text"])
            row, size = row + n, int(place[-1]) if n else size

    return docs.select("doc_id", (~held_out()).alias("train"), "text").mapInArrow(run, NUMBERED)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (B.mix(keys >> np.uint64(8 * (PAD - 2))) % np.uint64(buckets)).astype(np.int64)


def _token_bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return buckets + (tokens % np.uint64(buckets)).astype(np.int64)


BLOCKS = "bucket long, group long, keys binary, times binary"


def _block_rows(group: int, keys: np.ndarray, times: np.ndarray, bucket: np.ndarray | int) -> list[tuple]:
    """Rows of BLOCKS: sorted keys with their times, split by bucket."""
    if isinstance(bucket, int):
        return [(bucket, group, _packed(keys), _packed(times.astype("<i4")))]
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    out = []
    for part in np.split(order, edges):
        if len(part):
            out.append((int(bucket[part[0]]), group, _packed(keys[part]), _packed(times[part].astype("<i4"))))
    return out


def requests(rows: DataFrame, buckets: int) -> DataFrame:
    """Blocks of the distinct symbol keys and tokens of each group, and how often they stand in training rows.

    Buckets from 0 have symbols, those from ``buckets`` tokens; bucket -1 has
    the group's counts of contexts of SHORT bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # keys, with a bit below that tells training rows
        words: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(group: int) -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            own = (keys & np.uint64(1)).astype(np.int32)
            keys >>= np.uint64(1)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys, times = keys[first], np.add.reduceat(own, first)
            names, uses = _summed(*(np.concatenate(x) for x in zip(*words)))
            words.clear()
            out = _block_rows(group, *_summed(short_of(keys), times), -1)
            out += _block_rows(group, keys, times, _bucket_of(keys, buckets)) + _block_rows(group, names, uses, _token_bucket_of(names, buckets))
            columns = zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["bucket", "group", "keys", "times"])

        current = None
        for batch in batches:
            groups, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1], True]) if len(groups) else np.zeros(1, int)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and groups[x] != current:
                    yield flush(current)
                current = int(groups[x])
                for a, b in B.slices(batch.column(2).slice(x, y - x), SLICE):
                    part = batch.column(2).slice(x + a, b - a)
                    own = train[x + a : x + b]
                    for some, weight in ((part.filter(pa.array(own)), 1), (part.filter(pa.array(~own)), 0)):
                        if len(some):
                            data, offsets = B.buffer(some)
                            held.append(symbols(data, offsets) << np.uint64(1) | np.uint64(weight))
                            codes, names = pd.factorize(tokens(data, offsets)[0])
                            uses = np.bincount(codes, minlength=len(names))
                            words.append((np.append(names, END_TOKEN), np.append(uses, len(some)) * weight))
        if held:
            yield flush(current)
        B.trim()

    return rows.select("group", "train", "text").mapInArrow(run, BLOCKS)


def _packed(values: np.ndarray) -> bytes:
    """The values byte plane by byte plane, which compresses well, in one zstd frame."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def _unpacked(body: bytes, kind: str) -> np.ndarray:
    body, size = zstandard.ZstdDecompressor().decompress(body), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, len(body) // size).T).view(kind).ravel()


def _read(batch: pa.RecordBatch, i: int, keys: int, values: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(batch.column(keys)[i].as_py(), "<u8"), _unpacked(batch.column(values)[i].as_py(), kind)


def _in_two_steps(rows: DataFrame, n: int, run, schema: str) -> DataFrame:
    """``run`` over about the root of ``n`` shares of the rows, then over all that came of them."""
    shares = max(1, int(n**0.5))
    once = rows.repartition(shares).mapInArrow(run, schema) if shares > 1 else rows
    return once.repartition(1).mapInArrow(run, schema)


def collect_short(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all :func:`short_of` keys; at most 2^24, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for i in range(len(batch)):
                k, t = _read(batch, i, 0, 1, "<i8")
                held.append((k, t))
                size += len(k)
                if size > ENTRIES:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    size = 0
        keys, times = _summed(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array([_packed(keys)], pa.binary()), pa.array([_packed(times)], pa.binary())], names=["keys", "times"])

    def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = [_packed(_unpacked(x.as_py(), "<i4").astype("<i8")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(times, pa.binary())], names=["keys", "times"])

    schema = "keys binary, times binary"
    rows = blocks.filter("bucket = -1").select("keys", "times")
    n = rows.count()
    found = _in_two_steps(rows.mapInArrow(widened, schema), n, run, schema).collect()  # one row
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _unpacked(found[0]["keys"], "<u8"), _unpacked(found[0]["times"], "<i8")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """Each whole bucket and its blocks (group, keys, times); rows come sorted by bucket."""
    held, current = [], None
    for batch in batches:
        for i, bucket in enumerate(batch.column(0).to_pylist()):
            if held and bucket != current:
                yield current, held
                held = []
            current = bucket
            held.append((batch.column(1)[i].as_py(), *_read(batch, i, 2, 3, "<i4")))
    if held:
        yield current, held


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.filter("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket", "group")


def _merged(blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a bucket and the sums of their times."""
    return _summed(np.concatenate([x[1] for x in blocks]), np.concatenate([x[2] for x in blocks]).astype(np.int64))


def fit_mixer(blocks: DataFrame, buckets: int, short) -> tuple[Mixer, int, int]:
    """The mixer, and the numbers of training tokens and of different ones, from one pass over the buckets; ``short`` is broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, table = 0, short_counts(*short.value)
        for number, bucket in _buckets(batches):
            keys, times = _merged(bucket)
            keys, times = keys[times > 0], times[times > 0]
            mixer, vocabulary = Mixer.new(), [0, 0]
            if number >= buckets:
                vocabulary = [int(times.sum()), len(times)]
            elif len(keys):
                known = counted(keys, times, table)
                weight = times.astype(np.float32)
                for part in range(STEPS):
                    which = slice(part, None, STEPS)
                    learn(known.part(which), mixer, keys[which], weight[which], part >= STEPS // 2)
            total = total + np.append(mixer.totals(), vocabulary)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["totals"])
        B.trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for x in batch.column(0):
                total = total + np.frombuffer(x.as_py(), np.int64)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["totals"])

    learned = save(_dealt(blocks).mapInArrow(run, "totals binary"), "mixer")  # one row a task
    found = _in_two_steps(learned, learned.count(), add, "totals binary").collect()  # one row
    if not found:
        return Mixer.new(), 0, 0
    totals = np.frombuffer(found[0]["totals"], np.int64)
    return Mixer.of_totals(totals[:-2]), int(totals[-2]), int(totals[-1])


def answers(blocks: DataFrame, buckets: int, short, mixer) -> DataFrame:
    """(group, bucket, body): the costs (int32, in 1 / FINE bits) of a group's distinct symbols, or the counts (int64) of its distinct tokens, in the order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = short_counts(*short.value)
        for number, bucket in _buckets(batches):
            keys, times = _merged(bucket)
            value = times if number >= buckets else np.rint(bits_of(counted(keys, times, table), mixer.value, keys) * FINE).astype(np.int32)
            for at in range(0, len(bucket), 64):
                some = bucket[at : at + 64]
                out = [_packed(value[np.searchsorted(keys, k)]) for _, k, _ in some]
                yield pa.RecordBatch.from_arrays([pa.array([g for g, *_ in some], pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array(out, pa.binary())], names=["group", "bucket", "body"])
        B.trim()

    return _dealt(blocks).mapInArrow(run, "group long, bucket long, body binary")


SCORED = "doc_id long, n_tokens long, n_known long, base double, bits double, n_bytes long"


def score_groups(rows: DataFrame, buckets: int) -> DataFrame:
    """Every row of each group, from its texts and its answers (group; doc_id, text; or bucket, body, which come first, sorted by bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, costs, counts = None, [], [], []
        shift = np.uint64(64 - 8 * (PAD + 1))  # a key's free bits have its row, so that plain sorting brings both in order
        step = 1 << int(shift)

        def in_place(keys: np.ndarray, bucket: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
            out = np.empty(len(keys), found[0].dtype)
            out[np.argsort(bucket, kind="stable")] = np.concatenate(found)
            return out

        def scored_group() -> Iterator[pa.RecordBatch]:
            keys = _distinct(np.concatenate([x[1] for x in held]))
            cost = in_place(keys, _bucket_of(keys, buckets), costs) / FINE
            names = _distinct(np.concatenate([x[4] for x in held]))
            count = in_place(names, _token_bucket_of(names, buckets), counts)
            log = np.log10(count + 0.1)
            for ids, own, reps, owner, words, word, of, n_bytes in held:
                n = len(ids)
                bits = np.bincount(owner, np.repeat(cost[np.searchsorted(keys, own)], reps), n)
                at = np.searchsorted(names, words)[word]
                base, known = np.bincount(of, log[at], n), np.bincount(of, count[at] > 0, n)
                columns = [ids, pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(bits), pa.array(n_bytes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base", "bits", "n_bytes"])

        for batch in batches:
            groups, asked = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (asked[1:] != asked[:-1]), True]) if len(groups) else np.zeros(1, int)
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if groups[x] != current:
                    if held:
                        yield from scored_group()
                    current, held, costs, counts = groups[x], [], [], []
                if asked[x]:
                    for bucket, body in zip(batch.column(4).slice(x, y - x).to_pylist(), batch.column(5).slice(x, y - x)):
                        costs.append(_unpacked(body.as_py(), "<i4")) if bucket < buckets else counts.append(_unpacked(body.as_py(), "<i8"))
                    continue
                text = batch.column(3).slice(x, y - x)
                for a, b in ((i, min(i + step, b)) for a, b in B.slices(text, SLICE) for i in range(a, b, step)):
                    data, offsets = B.buffer(text.slice(a, b - a))
                    row = np.append(B.rows_of(offsets), np.arange(b - a))
                    mixed = symbols(data, offsets) << shift | row.astype(np.uint64)
                    mixed.sort()
                    own = mixed >> shift
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    h, begin = tokens(data, offsets)
                    word, words = pd.factorize(np.append(h, np.full(b - a, END_TOKEN)))
                    of = np.append(B.rows_of(begin), np.arange(b - a))
                    # Distinct keys, their numbers and rows; distinct tokens, the number of each, and rows.
                    held.append((batch.column(2).slice(x + a, b - a), own[first], np.diff(np.append(first, len(own))).astype(np.int32), (mixed & np.uint64(step - 1)).astype(np.uint8 if step <= 256 else np.int32), words, word.astype(np.int32), of.astype(np.int32), np.diff(offsets)))
        if held:
            yield from scored_group()
        B.trim()

    return rows.mapInArrow(run, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and score every row.

    Null texts count as empty: one end token, one end symbol. Repeated rows
    each get their row. Without training rows N and V are 0 and the base score
    is 0 a token (all tokens share the same mass), and the model is uniform.
    ``bits`` is the cost of the whole text, ``bits_per_byte`` that over its
    bytes and the end symbol.
    """
    spark = docs.sparkSession
    docs = save(numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "rows")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 16 + size // BUCKET
    blocks = save(requests(docs, buckets), "requests")
    short = spark.sparkContext.broadcast(collect_short(blocks))
    model, n, v = fit_mixer(blocks, buckets, short)
    mixer = spark.sparkContext.broadcast(model)
    none = lambda kind: F.lit(None).cast(kind)
    found = save(answers(blocks, buckets, short, mixer), "answers")
    discard(blocks)
    found = found.select("group", none("long").alias("row"), none("long").alias("doc_id"), none("string").alias("text"), "bucket", "body")
    both = found.unionByName(docs.select("group", "row", "doc_id", "text", none("long").alias("bucket"), none("binary").alias("body")))
    both = both.repartition("group").sortWithinPartitions("group", F.col("row").asc_nulls_first(), "bucket")
    mass = float(np.log10(n + 0.1 * (v + 1)))
    return score_groups(both, buckets).select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"),
        "bits",
        (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
