"""Token ids of whole Arrow text columns with the tokenizers library.

Byte-pair encoding treats each piece that the pre-tokenizer cuts on its own, and pieces repeat.
So a slice's pieces are found with array operations, and the library's model encodes each
different piece once in a worker's life (up to ``CACHE_PIECES``, after which the memory starts
anew).  Texts with characters whose class could differ between Unicode versions, and texts that
hold a special token's string, go through the library whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from tessera.llm import arrays

CACHE_PIECES = 3_000_000
#: Code points below this are classed by table, the others go through the library.
TABLE = 0x250
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    kinds = np.full(TABLE, OTHER, np.uint8)
    for c in range(TABLE):
        major = unicodedata.category(chr(c))[0]
        kinds[c] = {"L": LETTER, "N": NUMBER}.get(major, OTHER)
    kinds[[9, 10, 13, 32]] = SPACE
    return kinds


def _certain() -> np.ndarray:
    sure = np.zeros(TABLE, bool)
    sure[[9, 10, 13]] = sure[0x20:0x7F] = sure[0xA1:] = True
    sure[[0xAD, 0x130]] = False  # a soft hyphen; a letter whose lower case is two characters
    return sure


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """Encodes columns of texts; one for each worker and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        #: Byte-level files keep white space in pieces; word files lower-case and drop it.
        self.by_word = spec["normalizer"] is not None
        known = {"ByteLevel"} if not self.by_word else {"Sequence"}
        if spec["pre_tokenizer"]["type"] not in known or spec["model"]["type"] != "BPE":
            raise ValueError(f"not a known byte-pair tokenizer: {path}")
        self.kinds, self.sure, self.alphabet = _classes(), _certain(), _printable()
        self.lowered = np.array([ord(chr(c).lower()[0]) for c in range(TABLE)], np.uint32)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0

    def encode(self, column: pa.Array, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has; ``last`` is put after each."""
        texts = column.to_pylist()
        texts = [t or "" for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        odd = points >= TABLE
        odd[~odd] = ~self.sure[points[~odd]]
        marks = np.zeros(len(texts), bool)
        marks[np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1] = True
        for i, t in enumerate(texts):
            if not marks[i] and any(s in t for s in self.special):
                marks[i] = True
        if marks.any():
            keep = np.repeat(~marks, size)
            points, size = points[keep], np.where(marks, 0, size)
            offsets = np.concatenate([[0], np.cumsum(size)])
        flat, count = self._by_pieces(points, offsets)
        parts = np.split(flat, np.cumsum(count)[:-1]) if marks.any() or last is not None else None
        if parts is None:
            return flat, count
        for i in np.flatnonzero(marks):
            parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        if last is not None:
            end = np.array([last], np.uint32)
            parts = [x for p in parts for x in (p, end)]
            count = np.array([len(p) + 1 for p in parts[::2]], np.int64)
        else:
            count = np.array([len(p) for p in parts], np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), count

    def _by_pieces(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if self.by_word:
            points = self.lowered[points]
        starts, ends = self._cut(points, offsets)
        keys = arrays.hashes(points, starts, ends)
        found, first, where = np.unique(keys, return_index=True, return_inverse=True)
        slot = self._slots(found, points, starts[first], ends[first])
        slot = slot[where]
        size = self.size[slot].astype(np.int64)
        done = np.cumsum(size)
        total = int(done[-1]) if len(done) else 0
        pick = np.arange(total) + np.repeat(self.at[slot] - (done - size), size)
        by_text = np.searchsorted(starts, offsets, "left")
        done = np.concatenate([[0], done])
        return self.ids[pick].astype(np.uint32), np.diff(done[by_text])

    def _cut(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces, as the tokenizer's pattern cuts them from left to right."""
        kind = self.kinds[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = kind[1:] != kind[:-1]
        change |= edge[:-1]
        space = kind == SPACE
        if self.by_word:
            begin = change & ~space
            begin |= kind == NUMBER
        else:
            blank = np.zeros(n, bool)  # the character before is a plain space of the same text
            blank[1:] = points[:-1] == 32
            blank &= ~edge[:-1]
            before_solid = np.zeros(n, bool)
            before_solid[:-1] = space[:-1] & ~space[1:]
            before_solid &= ~edge[1:]
            begin = (change & space) | before_solid | (change & ~space & ~blank)
        # 's 't 'm 'd 're 've 'll at the start of a piece are pieces of their own
        quote = np.flatnonzero((points[:-1] == 39) & begin[:-1] & (kind[1:] == LETTER) & ~edge[1:-1])
        if len(quote):
            one = points[quote + 1]
            two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            short = np.isin(one, [115, 116, 109, 100])
            for which, size in ((short, 2), (long & ~short, 3)):
                at = quote[which]
                begin[at + 1] = False
                after = at + size
                after = after[after < n]
                begin[after[(kind[after] == LETTER) & ~edge[after]]] = True
        starts = np.flatnonzero(begin)
        stop = begin | edge[:-1]
        if self.by_word:
            stop |= change
            ends = np.flatnonzero(np.concatenate([stop, [True]]))
            if len(quote):  # the letter after a quote has changed class but goes on with the piece
                joined = np.zeros(n + 1, bool)
                joined[quote[short | long] + 1] = True
                ends = ends[~joined[ends]]
            ends = ends[np.searchsorted(ends, starts, "right")]
        else:
            ends = np.append(starts[1:], n)
        return starts, ends

    def _slots(self, found: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where each piece's ids are; pieces not seen before are encoded by the library's model."""
        if len(self.keys) > CACHE_PIECES:
            self.forget()
        at = np.searchsorted(self.keys, found)
        known = np.zeros(len(found), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == found[inside]
        new = np.flatnonzero(~known)
        if len(new):
            text = points.tobytes().decode("utf-32-le")
            tokenize, alphabet = self.model.tokenize, self.alphabet
            ids, size = [], []
            for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True):
                piece = text[a:b]
                if not piece.isascii() or not piece.isalnum():
                    piece = piece.encode().decode("latin-1").translate(alphabet)
                got = tokenize(piece)
                size.append(len(got))
                ids.extend([t.id for t in got])
            fresh = np.array(ids, np.uint16)
            while self.used + len(fresh) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(fresh)] = fresh
            size = np.array(size, np.int32)
            begins = self.used + np.cumsum(size, dtype=np.int64) - size
            self.used += len(fresh)
            put = at[new]
            self.keys = np.insert(self.keys, put, found[new])
            self.at = np.insert(self.at, put, begins)
            self.size = np.insert(self.size, put, size)
            at = np.searchsorted(self.keys, found)
        return at


_made: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The worker's encoder for a tokenizer file."""
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]
