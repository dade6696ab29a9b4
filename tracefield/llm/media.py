"""Interleaved document sequences of texts and media.

A page's HTML is parsed into one ordered list of structs: runs of text, and
references to media by digest with their captions. Payloads live in a table of
their own, content-addressed by the SHA-256 of the payload and stored
losslessly as 8-bit grey PNG images. References are resolved by a join on the
digest; an item keeps its place and its caption whether or not it resolves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import save, work_dir
from . import bytesops as B
from .skew import join_one

#: Samples in a line of a stored image; payloads are a whole number of blocks of BLOCK bytes.
WIDTH, BLOCK = 576, 576
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
STORED = "digest string, media binary"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """``payload`` (a positive multiple of ``width`` bytes) as an 8-bit grey image."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(lines), width + 1), np.uint8)  # each line begins with filter type 0
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an image that :func:`encode_png` made, as lines."""
    if media[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG file")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only lines without a filter are read")
    return raw[:, 1:]


def payload_of(text: bytes) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of the block size."""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def describe(samples: np.ndarray) -> str:
    """Mean, deviation, entropy and an 8-bin histogram of an image's samples."""
    flat = samples.ravel()
    counts = np.bincount(flat, minlength=256)
    n = max(1, len(flat))
    p = counts[counts > 0] / n
    mean = float((counts * np.arange(256)).sum() / n)
    dev = float(np.sqrt(max(0.0, (counts * np.arange(256) ** 2.0).sum() / n - mean**2)))
    bins = counts.reshape(8, 32).sum(1)
    return f"{samples.shape[1] if samples.ndim > 1 else n}x{len(samples)};mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};hist=" + "/".join(map(str, bins))


class _Interleaver(HTMLParser):
    """Collects text runs and media references in document order."""

    MEDIA = ("img", "audio", "video", "source", "embed")
    BREAKS = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "tr", "table", "blockquote", "pre")
    HIDDEN = ("script", "style", "template", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.hidden = 0
        self.figures: list[list[int]] = []
        self.caption: list[str] | None = None

    def _end_run(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.MEDIA:
            src = dict(attrs).get("src") or ""
            self._end_run()
            self.items.append({"kind": "media", "text": None, "ref": src[len(SCHEME) :] if src.startswith(SCHEME) else src, "caption": dict(attrs).get("alt")})
            if self.figures:
                self.figures[-1].append(len(self.items) - 1)
        elif tag == "figcaption":
            self._end_run()
            self.caption = []
        elif tag in self.BREAKS:
            self._end_run()
            if tag == "figure":
                self.figures.append([])

    def handle_startendtag(self, tag, attrs):
        if tag not in self.HIDDEN:  # a hidden element without content hides nothing
            self.handle_starttag(tag, attrs)

    def _end_caption(self) -> None:
        text = " ".join("".join(self.caption or []).split())
        self.caption = None
        for i in self.figures[-1] if self.figures else ():
            self.items[i]["caption"] = text
        if not self.figures and text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            self._end_caption()
        elif tag in self.BREAKS:
            self._end_run()
            if tag == "figure" and self.figures:
                if self.caption is not None:
                    self._end_caption()
                self.figures.pop()

    def handle_data(self, data):
        if not self.hidden:
            (self.run if self.caption is None else self.caption).append(data)

    def result(self) -> list[dict]:
        self.close()
        if self.caption is not None:
            self._end_caption()
        self._end_run()
        return [{"position": k, **x} for k, x in enumerate(self.items)]


def parse_html(html: str | None) -> list[dict]:
    """The ordered items of a page; none for a null or empty one. A caption goes to the media of its figure."""
    parser = _Interleaver()
    parser.feed(html or "")
    return parser.result()


def interleave(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key`` and ``items`` (array of ITEM) of every page."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_html(x.as_py()) for x in batch.column(1)], kind)], names=["key", "items"])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).alias("html")).mapInArrow(run, f"key long, items array<{ITEM}>").withColumnRenamed("key", key)


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Store the payload of every text below ``folder``; the table of digest and media.

    Equal payloads are one medium: of those that stand together in a slice one is stored, and all are read as one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in B.slices(batch.column(0)):
                seen: dict[str, bytes] = {}
                for x in batch.column(0).slice(a, b - a):
                    payload = payload_of((x.as_py() or "").encode())
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in seen:
                        seen[digest] = encode_png(payload)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.binary())], names=["digest", "media"])

    docs.select("text").mapInArrow(run, STORED).write.option("compression", "none").parquet(folder)
    return docs.sparkSession.read.schema(STORED).parquet(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Decode every stored medium and describe it; one row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = m.as_py()
                samples = decode_png(raw)
                payload = samples.tobytes()
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), describe(samples)))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, FEATURES).dropDuplicates(["digest"])


def resolve(pages: DataFrame, media: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per item of ``pages`` (key, items), in its place, with the columns of ``media`` (one row a digest) where its reference resolves, else null."""
    items = save(pages.select(key, F.explode("items").alias("item")).select(key, "item.*"), "items")
    return join_one(items, media.withColumnRenamed("digest", "ref"), ["ref"], "left")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """A page for each document that shows its payload as a figure: doc_id, n_bytes and html. The caption holds the unpadded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = []
            for x in batch.column(1):
                text = (x.as_py() or "").encode()
                html.append(f'<figure><img src="{SCHEME}{hashlib.sha256(payload_of(text)).hexdigest()}"><figcaption>{len(text)}</figcaption></figure>')
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(html, pa.string())], names=["doc_id", "html"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, html string")


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text's payload, reference it from a page, read it back through the reference and describe it.

    Null and empty texts have a payload of one block of bytes 255. Repeated
    rows each get their row; equal texts have equal values.
    """
    spark: SparkSession = docs.sparkSession
    stored = store(docs, folder or work_dir(spark, "media"))
    pages = interleave(documents_as_media(docs), "doc_id")
    found = resolve(pages, media_features(stored), "doc_id")
    return found.select("doc_id", F.col("caption").cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


