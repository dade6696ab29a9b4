"""Benchmark decontamination by pigeonhole edit matching.

An item that stands in a text with at most e edits, cut into e + 1 pieces, has
one piece unchanged there. The pieces of all items are found in one pass of an
Aho-Corasick automaton over each text; around each hit the item is compared
with Myers' bit-parallel edit distance, which gives the least distance over all
substrings of the window.

Texts and items are compared lower-cased, with white space folded to single
spaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.08
#: Items of fewer characters must stand in a text exactly, between word ends.
SHORT = 24
#: Characters of items that are broadcast at a time; a larger benchmark is taken in blocks.
BLOCK_CHARS = 4 << 20
HITS = "doc_id long, item_id long, start long, end long, distance int, allowed int"


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_item(text: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their places."""
    n = errors + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def allowed_errors(text: str, rate: float = ERROR_RATE, short: int = SHORT) -> int:
    return 0 if len(text) < short else int(rate * len(text))


class Myers:
    """The bit vectors of one pattern; Python's integers are as wide as it needs."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The least edit distance of the pattern to a substring of ``text``, and the first end at which it is reached."""
        full, top = (1 << self.length) - 1, 1 << self.length - 1
        plus, minus, score, get = full, 0, self.length, self.masks.get
        low, at = score, 0
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = up << 1 & full  # a match may begin anywhere in the text
            down = down << 1 & full
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if score < low:
                low, at = score, j
        return low, at


class Matcher:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE, short: int = SHORT):
        import ahocorasick

        self.short = short
        self.items, self.errors, self.pattern, self.reverse = [], [], {}, {}
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = folded(text)
            if not text:
                continue
            e = allowed_errors(text, rate, short)
            for at, piece in split_item(text, e):
                places.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text))
            self.errors.append(e)
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _myers(self, i: int, held: dict, text: str) -> Myers:
        if i not in held:
            held[i] = Myers(text)
        return held[i]

    def find(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item_id, start, end, distance, allowed) of the best place of each item that the folded text holds."""
        if not self.items:
            return []
        text = folded(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for i, at in where:
                e, size = self.errors[i], len(self.items[i][1])
                begin = end + 1 - n - at  # where the item begins if nothing before the piece is added or lost
                a, b = max(0, begin - e), begin + size + e
                w = windows.setdefault(i, [])
                if w and a <= w[-1][0] + e and a >= w[-1][0] - e:
                    w[-1] = [min(w[-1][0], a), max(w[-1][1], b)]
                else:
                    w.append([a, b])
        out = []
        for i, spans in windows.items():
            item_id, item = self.items[i]
            e, best = self.errors[i], None
            for a, b in spans:
                part = text[a:b]
                if e == 0:
                    k = part.find(item)
                    if k < 0 or len(item) < self.short and (text[a + k - 1 : a + k].strip() or text[a + k + len(item) : a + k + len(item) + 1].strip()):
                        continue
                    d, end = 0, a + k + len(item)
                    start = a + k
                else:
                    k = part.find(item)
                    if k >= 0:
                        d, start, end = 0, a + k, a + k + len(item)
                    else:
                        d, end = self._myers(i, self.pattern, item).best(part)
                        if d > e:
                            continue
                        _, back = self._myers(i, self.reverse, item[::-1]).best(part[:end][::-1])
                        start, end = a + end - back, a + end
                if best is None or (d, start) < best[:2]:
                    best = (d, start, end)
                if d == 0:
                    break
            if best:
                out.append((item_id, best[1], best[2], best[0], e))
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_CHARS`` characters (or one item)."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).orderBy("item_id").toLocalIterator():
        if block and size + len(r["text"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, short: int = SHORT) -> DataFrame:
    """One row for each document and item that it holds within ``rate`` edits a character.

    Items of fewer than ``short`` characters must stand there unchanged and by
    themselves, from word end to word end; with 0 all items are alike and may
    stand inside words.

    start and end are places in the folded text. Null and empty texts hold
    nothing, null and empty items are held by nothing. Repeated documents give
    repeated rows. The benchmark is the query set: it is broadcast in blocks of
    bounded size, and every block runs against all rows.
    """
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast((block, rate, short))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in matcher.find(text.as_py())]
                columns = list(zip(*rows)) or [[]] * 6
                types = [pa.int64()] * 4 + [pa.int32()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "start", "end", "distance", "allowed"])

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], HITS)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns stay. Rows without a doc_id can't be told apart and stay."""
    held = find_items(docs, benchmark, rate).select("doc_id").distinct()
    return docs.join(held, "doc_id", "left_anti").select(*docs.columns)
