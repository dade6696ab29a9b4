"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1. Every document's set of distinct 5-word shingles gets a 128-bit key and a
   MinHash signature. Equal sets are one class, stood for by its least doc_id.
2. Signatures are cut into bands; classes that agree on a band share a bucket.
3. Within a bucket, pairs of different components are compared batch by batch
   of their signatures. A pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold falls below ``MISS``.
4. Survivors are verified exactly on the full sets, and links join components.

What is wanted is the components, not all pairs. So a first round verifies the
best survivor of each member only: copies by the thousand are joined by as many
links as there are copies. A second round takes the buckets that still hold
several components. Signatures first tell the members that have a surviving
pair across components; only their texts are sent, and their block goes through
these pairs, joining components as it finds links; only the links leave the
task. After it every surviving pair of every bucket has been verified or lies
within a component. Buckets larger than a block are dealt over blocks;
signatures of members outside a bucket's main component are then taken to its
other blocks too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..storage import save
from . import bytesops as B
from .skew import join_one

WORDS = 5
BANDS, ROWS = 25, 5
#: Probability with which a pair at the threshold may be dropped in step 3.
MISS = 1e-5
#: Hashes compared at a time.
STEP = 25
#: Members of a bucket that are compared in one task at a time, and their shingles.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
#: Bytes of text after which a task goes through the buckets it holds.
HELD = 16 << 20
SHINGLED = "doc_id long, n_shingles long, h1 long, h2 long, signature binary, bands array<long>"


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row, sorted, and the n + 1 places of the rows in them.

    Words are lower-cased (A-Z). A row of fewer than ``n`` words has its whole
    sequence as one shingle; one without words has none.
    """
    data = B.lower(data)
    starts, ends, first = B.words(data, offsets)
    h = B.span_hashes(data, starts, ends)
    size = np.diff(first)
    row = B.rows_of(first)
    run = B.grams(h, n)
    ok = row[: len(run)] == row[n - 1 :] if len(run) else np.zeros(0, bool)
    found, owner = run[ok], row[: len(run)][ok]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = np.array([B.grams(h[first[r] : first[r + 1]], int(size[r]))[0] for r in short], np.uint64)
        found, owner = np.concatenate([found, whole]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(offsets)))


def signatures(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima (64 bits) of each row that has shingles; other rows are zero."""
    out = np.zeros((len(first) - 1, BANDS * ROWS), np.uint64)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        odd, add = B.stream(BANDS * ROWS, 9) | np.uint64(1), B.stream(BANDS * ROWS, 10)
        for k in range(BANDS * ROWS):
            out[filled, k] = np.minimum.reduceat((sets ^ add[k]) * odd[k], first[filled])
    return out


def shingle_table(docs: DataFrame) -> DataFrame:
    """The size of every row's set, its 128-bit key, its signature (8 bits a hash) and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.slices(batch.column(1)):
                data, offsets = B.buffer(batch.column(1).slice(a, b - a))
                sets, first = shingles(data, offsets)
                n = np.diff(first)
                filled = np.flatnonzero(n > 0)
                keys = np.zeros((2, b - a), np.uint64)
                for k in range(2):
                    if len(filled):
                        keys[k, filled] = np.add.reduceat(B.mix(sets ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)), first[filled])
                sig = signatures(sets, first) >> np.uint64(32)
                bands = np.empty((b - a, BANDS), np.uint64)
                for k in range(BANDS):
                    v = np.full(b - a, k + 1, np.uint64)
                    for c in range(k * ROWS, (k + 1) * ROWS):
                        v = v * np.uint64(B.BASE) + sig[:, c]
                    bands[:, k] = B.mix(v)
                low = np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8))
                sizes = np.arange(b - a + 1, dtype=np.int32)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array(n.astype(np.int64)),
                    *(pa.array(k.view(np.int64)) for k in keys),
                    pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(sizes * (BANDS * ROWS)), pa.py_buffer(low.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(sizes * BANDS), pa.array(bands.view(np.int64).ravel())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SHINGLED)


@lru_cache(maxsize=None)
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number n of hashes compared, the least number of matches at which a pair goes on.

    From a uniform prior, the similarity after m of n matches is Beta(m + 1,
    n - m + 1); what is below the threshold with probability over 1 - miss is
    dropped. Matches of 8 bits by chance raise both sides alike.
    """
    t = threshold + (1 - threshold) / 256
    out = [0]
    for n in range(1, BANDS * ROWS + 1):
        above, m = 0.0, 0
        while True:
            above += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if above >= miss or m == n:
                break
            m += 1
        out.append(m)
    return tuple(out)


def compare(sig: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (numbers in i, j) that no batch of hashes rules out, and their matches."""
    need = least_matches(threshold)
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for at in range(0, BANDS * ROWS, STEP):
        part = (sig[i[alive], at : at + STEP] == sig[j[alive], at : at + STEP]).sum(1)
        matches[alive] += part
        alive = alive[matches[alive] >= need[min(at + STEP, BANDS * ROWS)]]
    return alive, matches[alive]


def bucket_pairs(group: np.ndarray, comp: np.ndarray, probe: np.ndarray, sig: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs within the groups (equal neighbours in ``group``) across components, at most ``most`` for each member by matches.

    A pair is found in every bucket that it shares: the stored 8 bits of a hash
    can't tell whether an earlier band's key (of 32 bits a hash) is shared too.
    Two probes are not compared; each is a plain member of its own block.
    """
    if not len(group):
        return (np.zeros(0, np.int64),) * 3
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = np.arange(len(group))
    last = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)
    left = last[np.searchsorted(last, at)] - at  # members after this one in its group
    live = at[left > 0]
    d = 1
    while len(live):
        i, j = live, live + d
        ok = (comp[i] != comp[j]) & ~(probe[i] & probe[j])
        i, j = i[ok], j[ok]
        for x in range(0, len(i), 1 << 17):
            a, b = i[x : x + (1 << 17)], j[x : x + (1 << 17)]
            keep, m = compare(sig, a, b, threshold)
            if len(keep):
                found.append((a[keep], b[keep], m))
        d += 1
        live = live[left[live] >= d]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    a, b, m = (np.concatenate(x) for x in zip(*found))
    if most < 1 << 20 and len(a):
        keep = np.zeros(len(a), bool)
        for side in (a, b):
            order = np.lexsort((-m, side))
            s = side[order]
            head = np.r_[True, s[1:] != s[:-1]]
            rank = np.arange(len(s)) - np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
            keep[order[rank < most]] = True
        a, b, m = a[keep], b[keep], m[keep]
    return a, b, m


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (equal key and block, which follow each other) of a moderate size."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + len(batch), size + batch.nbytes
        if rows < 4 * BLOCK and size < HELD:
            continue
        table = pa.Table.from_batches(held)
        key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        inside = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1]))
        if not len(inside):
            continue
        cut = int(inside[-1]) + 1  # the last group may go on
        yield table.slice(0, cut)
        held = [pa.Table.combine_chunks(table.slice(cut)).to_batches()[0]]
        rows, size = len(held[0]), held[0].nbytes
    if rows:
        yield pa.Table.from_batches(held)


def _pairs_of(table: pa.Table, threshold: float, most: int):
    """The docs and components of a table of whole groups, and its surviving pairs."""
    key, block, doc, comp = (table.column(c).to_numpy() for c in ("key", "block", "doc", "comp"))
    data, _ = B.buffer(table.column("signature"))
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    probe = table.column("probe").to_numpy().astype(bool)
    return doc, comp, bucket_pairs(group, comp, probe, data.reshape(len(key), BANDS * ROWS), threshold, most)


_MEMBER = ("key", "block", "doc", "comp", "probe", "signature")


def _dealt(members: DataFrame, *more: str) -> DataFrame:
    return members.select(*_MEMBER, *more).repartition("key", "block").sortWithinPartitions("key", "block", "doc")


def best_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """For each doc of ``members`` (key, block, doc, comp, probe, signature) its best surviving pair (a < b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            doc, _, (a, b, m) = _pairs_of(table, threshold, 1)
            x, y = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(m)], names=["a", "b", "matches"])

    pairs = _dealt(members).mapInArrow(run, "a long, b long, matches long")
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
    return best.select("a", "b")


def survivors(members: DataFrame, threshold: float) -> DataFrame:
    """Those of ``members`` (as above), without signatures, that have a surviving pair in their block."""
    kept = _MEMBER[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            _, _, (a, b, _) = _pairs_of(table, threshold, 1)
            rows = table.select(list(kept)).take(pa.array(np.unique(np.concatenate([a, b]))))
            yield from rows.combine_chunks().to_batches()

    return _dealt(members).mapInArrow(run, "key long, block long, doc long, comp long, probe int")


def block_links(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components within each block of ``members`` (as above, and text).

    Pairs are taken by their matches; a pair whose components have met, or that
    another bucket of the task has brought already, is not verified, so that a block gives fewer links than it has members.
    """
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            doc, comp, (a, b, m) = _pairs_of(table, threshold, 1 << 30)
            left, right = [], []
            if len(a):
                used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                text = table.column("text").combine_chunks().take(pa.array(used))
                parts = [shingles(*B.buffer(text.slice(x, y - x))) for x, y in B.slices(text)]
                sets = [v[first[k] : first[k + 1]] for v, first in parts for k in range(len(first) - 1)]
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.setdefault(x, x) != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                tried: set[tuple[int, int]] = set()
                order = np.argsort(-m, kind="stable")
                for i, j, x, y in zip(a[order].tolist(), b[order].tolist(), at[: len(a)][order].tolist(), at[len(a) :][order].tolist()):
                    p, q = find(int(comp[i])), find(int(comp[j]))
                    pair = (min(int(doc[i]), int(doc[j])), max(int(doc[i]), int(doc[j])))
                    if p != q and pair not in tried:
                        tried.add(pair)
                        one, other = sets[x], sets[y]
                        if 100 * min(len(one), len(other)) < percent * max(len(one), len(other)):
                            continue
                        both = len(np.intersect1d(one, other, assume_unique=True))
                        if 100 * both >= percent * (len(one) + len(other) - both):
                            root[max(p, q)] = min(p, q)
                            left.append(int(doc[i]))
                            right.append(int(doc[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return _dealt(members, "text").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of which the full shingle sets reach the threshold.

    The text of b goes to where that of a is; pairs of one a are dealt over
    tasks by their number.
    """
    percent = round(100 * threshold)
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    lead = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("doc_id")).select("a", "part", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    rest = dealt.join(texts, F.col("b") == F.col("doc_id")).select("a", "part", F.lit(1).alias("role"), "b", "text")
    rows = lead.unionByName(rest).repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, own = None, None
        for batch in batches:
            left, right = [], []
            for x, y in B.slices(batch.column(4)):
                sets, first = shingles(*B.buffer(batch.column(4).slice(x, y - x)))
                for k in range(y - x):
                    a, role, b = (batch.column(c)[x + k].as_py() for c in (0, 2, 3))
                    s = sets[first[k] : first[k + 1]]
                    if role == 0:
                        current, own = a, s.copy()
                    elif a == current:
                        both = len(np.intersect1d(own, s, assume_unique=True))
                        if 100 * both >= percent * (len(own) + len(s) - both):
                            left.append(a)
                            right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _with_components(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the component of each doc."""
    comps = connected_components(links)
    return members.join(comps, members["doc"] == comps["vertex"], "left").withColumn("comp", F.coalesce("component", "doc")).drop("vertex", "component")


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents are linked when the Jaccard similarity of their shingle sets is
    ``threshold`` or more (compared in whole percents); component_id is the
    least doc_id reachable. Texts that are null or hold no word are linked with
    nothing. Repeated rows are linked with each other. A null doc_id takes the
    component of its text's class, or null where there is no other row.
    """
    table = save(shingle_table(docs), "shingles")
    filled = table.filter("n_shingles > 0 and doc_id is not null")
    classes = save(filled.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("doc")), "classes")
    # By document and not by class: the copies of one text don't meet in one task.
    reps = save(filled.select("doc_id", "n_shingles", "signature", "bands").join(classes.select(F.col("doc").alias("doc_id")), "doc_id").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "doc"), "signatures")

    rows = reps.select("doc", "n_shingles", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("key", "band").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("mass")).filter("size > 1")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("mass") / BLOCK_SHINGLES)).cast("long")
    members = join_one(rows, sizes.select("key", "band", blocks.alias("blocks")), ["key", "band"])
    members = save(members.select("key", "band", "doc", "blocks", F.pmod(F.xxhash64("doc", "band"), F.col("blocks")).alias("block")), "buckets")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"])
    texts = save(texts, "texts")
    signature = reps.select("doc", "signature")

    first = members.withColumn("comp", F.col("doc")).withColumn("probe", F.lit(0)).join(signature, "doc")
    links = save(verify(save(best_pairs(first, threshold), "pairs"), texts, threshold), "links")
    wide = members.filter("blocks > 1").limit(1).count() > 0
    content = signature.join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    for across in (False, True)[: 1 + wide]:
        now = save(_with_components(members, links), "members")
        open_ = now.groupBy("key", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key", "band")
        now = join_one(now, open_, ["key", "band"]).withColumn("probe", F.lit(0))  # buckets of one component are done with
        if across:
            now = _probes(now.filter("blocks > 1"))
        alive = save(survivors(now.join(signature, "doc"), threshold), "survivors")
        links = links.unionByName(save(block_links(alive.join(content, "doc"), threshold), "links"))

    known = connected_components(links)
    of = classes.join(known, classes["doc"] == known["vertex"], "left").select("h1", "h2", "n_shingles", F.coalesce("component", "doc").alias("component"))
    out = join_one(table.select("doc_id", "n_shingles", "h1", "h2"), of, ["h1", "h2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _probes(members: DataFrame) -> DataFrame:
    """``members`` of wide buckets, and those outside a bucket's largest component once more in each of its other blocks."""
    sizes = members.groupBy("key", "band", "comp").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key", "band").agg(F.max_by("comp", "n").alias("main"))
    stray = join_one(members, main, ["key", "band"]).filter("comp <> main").drop("main")
    away = stray.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("to <> block")
    return members.unionByName(away.withColumn("block", F.col("to")).withColumn("probe", F.lit(1)).drop("to"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each group of near-duplicates; all columns stay. Of rows that repeat a doc_id one stays; rows without a doc_id all stay."""
    kept = near_duplicates(docs, threshold).filter("kept").select("doc_id").distinct()
    one = docs.join(kept, "doc_id").dropDuplicates(["doc_id"]).select(*docs.columns)
    return one.unionByName(docs.filter(F.col("doc_id").isNull()))


