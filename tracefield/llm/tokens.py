"""Exact tokenisation of whole columns of text with the ``tokenizers`` library.

A text is cut where the pre-tokenizers of the supported vocabularies cut it in
any case: before a single white-space character between two characters that
are surely none, and between a letter and an ASCII punctuation mark other than
the apostrophe. Each distinct piece is encoded once per Python worker by the
library; a text's ids are the ids of its pieces in order, equal to those of
the whole text. Pieces are known by 64-bit hashes. A text in which a special
token of the vocabulary is spelled out is encoded by the library as a whole,
which gives that token one id, wherever it stands.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from . import bytesops as B

#: Pieces that a worker remembers at most; beyond that it starts anew (ids do not depend on it).
REMEMBERED = 3_000_000

_letter = np.zeros(256, dtype=bool)
_letter[ord("A") : ord("Z") + 1] = _letter[ord("a") : ord("z") + 1] = True
#: Bytes of letters that :func:`pieces` knows.
_LETTERS = bytes(np.flatnonzero(_letter).tolist()) + bytes([0xC3, *range(0x80, 0xC0)])
_solid = np.zeros(256, dtype=bool)
_solid[0x21:0x7F] = True
_mark = _solid & ~_letter
_mark[ord("0") : ord("9") + 1] = False
_mark[ord("'")] = False
_white = np.zeros(256, dtype=bool)
_white[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and per row the number of its first piece (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # Letters of two bytes from U+00C0 to U+00FF, but for the signs of multiplication and division.
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    starts_letter = _letter[data] | pair
    ends_letter = _letter[data]
    ends_letter[1:] |= pair[:-1]
    mark, solid = _mark[data], _solid[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:-2] = _white[data[1:-1]] & (solid | ends_letter)[:-2] & (solid | starts_letter)[2:]
    cut[1:n] |= (ends_letter[:-1] & mark[1:]) | (mark[:-1] & starts_letter[1:])
    edge = offsets[:-1][np.diff(offsets) > 0]
    cut[edge] = True
    # White space at a row's end has no neighbour after it.
    last = offsets[1:][np.diff(offsets) > 0] - 1
    lone = last[_white[data[last]] & ~np.isin(last, edge)]
    cut[lone] = False
    at = np.flatnonzero(cut[:n])
    return at, np.searchsorted(at, offsets)


class Encoder:
    """Encodes columns of text with one tokenizer file; a worker keeps one for each file.

    ``folded``: the vocabulary's normaliser drops white space and lower-cases,
    so that pieces which differ in those alone are one piece.
    """

    _known: dict[tuple[str, bool], "Encoder"] = {}

    @classmethod
    def of(cls, path: str, ordinary: bool = False) -> "Encoder":
        if (path, ordinary) not in cls._known:
            cls._known[path, ordinary] = cls(path, ordinary)
        return cls._known[path, ordinary]

    def __init__(self, path: str, ordinary: bool = False):
        """``ordinary``: strings of special tokens are text like any other, instead of one id each as the library has it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [] if ordinary else [t.content for t in added]
        #: Whether a special token's string is looked for in the normalised text.
        self.loose = any(t.normalized for t in added)
        kinds = str(self.tokenizer.normalizer)
        self.folded = "Lowercase" in kinds and "\\s+" in kinds
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """Encode new pieces. Runs of letters after a space are encoded side by side, in one text, and told apart by their word numbers."""
        plain, odd = [], []
        for i, t in enumerate(texts):
            (plain if t[:1] == b" " and len(t) > 1 and not t[1:].translate(None, _LETTERS) and b"\xc3\x97" not in t and b"\xc3\xb7" not in t else odd).append(i)
        ids: list = [None] * len(texts)
        for a in range(0, len(plain), 2000):
            block = plain[a : a + 2000]
            e = self.tokenizer.encode(b"".join(texts[i] for i in block).decode(), add_special_tokens=False)
            word = np.array(e.word_ids, np.int64)
            bounds = np.searchsorted(word, np.arange(len(block) + 1))
            got = np.array(e.ids, np.uint32)
            if len(word) and word[-1] == len(block) - 1:
                for k, i in enumerate(block):
                    ids[i] = got[bounds[k] : bounds[k + 1]]
            else:
                odd += block
        for a in range(0, len(odd), 2000):
            block = odd[a : a + 2000]
            for i, e in zip(block, self.tokenizer.encode_batch_fast([texts[i].decode() for i in block], add_special_tokens=False)):
                ids[i] = np.array(e.ids, np.uint32)
        new = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        lengths = np.array([len(x) for x in ids], np.int32)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(new)] = new
        places = self.used + np.cumsum(lengths, dtype=np.int64) - lengths
        self.used += len(new)
        # The known keys are sorted: only the new ones are, and go in between.
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.keys, hashes[order])
        self.keys = np.insert(self.keys, at, hashes[order])
        self.places = np.insert(self.places, at, places[order])
        self.lengths = np.insert(self.lengths, at, lengths[order])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == hashes) if len(self.keys) else np.zeros(len(hashes), bool)

    def _holds_special(self, col: pa.Array) -> np.ndarray:
        """Rows that spell out a special token."""
        out = np.zeros(len(col), bool)
        for t in self.special:
            out |= pc.match_substring(pc.fill_null(col, ""), t, ignore_case=self.loose).to_numpy(zero_copy_only=False)
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows (uint32) and the n + 1 offsets of the rows in them. Null and empty texts have no ids."""
        whole = self._holds_special(col)
        if not whole.any():
            return self._encode_pieces(col)
        ids, off = self._encode_pieces(pc.if_else(pa.array(whole), "", pc.fill_null(col, "")))
        parts = [ids[a:b] for a, b in zip(off[:-1], off[1:])]
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(self.tokenizer.encode(col[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _encode_pieces(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = B.buffer(col)
        at, first = pieces(data, offsets)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.append(at[1:], len(data))
        starts = at
        if self.folded:
            key = B.lower(data)
            starts = at + (_white[data[at]] & (ends - at > 1))
        else:
            key = data
        codes, values = pd.factorize(B.span_hashes(key, starts, ends))
        place, known = self._find(values)
        if not known.all():
            if len(self.keys) > REMEMBERED:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            seen = np.full(len(values), -1, np.int64)
            seen[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = key.tobytes()
            lead = b" " if self.folded else b""
            texts = [lead + raw[starts[i] : ends[i]] for i in seen[new].tolist()]
            self._learn(values[new], texts)
            place, _ = self._find(values)
        each = self.lengths[place][codes].astype(np.int64)
        begin = self.places[place][codes]
        out = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=out[1:])
        take = np.repeat(begin - out[:-1], each)
        take += np.arange(out[-1])
        return self.pool[take], out[first]
