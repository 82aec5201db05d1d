"""Token ids of whole texts, by the tokenizers library, with a bounded cache of pieces.

A byte-level BPE never merges across its pre-tokens, and a space that stands before
a character that is no white space always begins a pre-token.  So a text can be cut
there and each piece encoded alone.  Pieces repeat: those of a batch are hashed
together, looked up in a table, compared byte by byte with what the table holds, and
only unknown ones go to the library.  A text that holds one of the file's added
tokens goes to the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from . import common as C

#: Kinds of bytes: 1 letter, 2 digit, 3 other mark, 4 white space; 0 (what is not ASCII, controls) is never cut from its neighbours.
_KIND = np.zeros(256, np.uint8)
for _kind, _ranges in enumerate(([(0x41, 0x5A), (0x61, 0x7A)], [(0x30, 0x39)], [(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)], [(0x09, 0x0D), (0x20, 0x20)]), 1):
    _KIND[C.byte_class(_ranges)] = _kind
#: First bytes of characters that are surely no white space.
_SOLID = C.byte_class([(0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4)])
#: Pieces that are one pre-token.
_SIMPLE = re.compile(rb" ?(?:[A-Za-z]|\xc3[^\x97\xb7])+| ?[0-9]+| ?[!-&(-/:-@[-`{-~]+|[\t-\r ]+")
#: Text bytes that are encoded together, and the length up to which pieces are kept.
SLICE, LONG = 1 << 20, 24
_SLOTS = 21
_HELD: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def runs_of(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, .. (size[0] of them), start[1], ..: the places of runs, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of pieces: every row's first, and places where the tokenizer always begins a pre-token."""
    begin = np.zeros(len(raw), bool)
    kind = _KIND[raw]
    accent = np.flatnonzero(raw[:-1] == 0xC3)  # two bytes, letters but for the two signs
    accent = accent[(raw[accent + 1] != 0x97) & (raw[accent + 1] != 0xB7)]
    kind[accent] = kind[accent + 1] = 1
    left, right = kind[:-1], kind[1:]
    white = kind == 4
    ends = np.zeros(len(raw), bool)  # last bytes of rows: what follows is another row
    rows = at[:-1][np.diff(at) > 0]
    ends[rows[rows > 0] - 1] = True
    # between kinds, but for white space before a word and an apostrophe before letters
    begin[1:] = (left != right) & (left > 0) & (left < 4) & (right > 0) & ~((raw[:-1] == 39) & (right == 1))
    # of white space before a word, the last character stands apart; a space goes with the word
    last = white[:-1] & _SOLID[raw[1:]] & ~ends[:-1]
    begin[:-1] |= last
    begin[1:] |= last & (raw[:-1] != 32)
    begin[rows] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes texts with one tokenizer file as the library does; holds at most ``most`` pieces."""

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        tokens = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, tokens))) if tokens else None
        self.model, self.most, self.known = self.tokenizer.model, most, 0
        self.characters = byte_characters()
        # slot -> number of a piece; number -> its bytes (as three words), and its ids in one array
        self.number = np.full(1 << _SLOTS, -1, np.int32)
        self.words = np.zeros((3, 1 << 16), np.uint64)
        self.first, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.ids, self.used = np.empty(1 << 18, np.uint32), 0

    cuts = staticmethod(cuts)

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a piece that is not known yet."""
        if _SIMPLE.fullmatch(piece):
            if piece.isalpha():
                parts = [piece.decode()]
            elif piece[1:].isalpha() and piece[0] == 32:
                parts = [self.characters[32] + piece[1:].decode()]
            else:
                parts = [piece.decode("latin-1").translate(self.characters)]
        else:
            parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece.decode())]
        return array("I", [t.id for p in parts for t in self.model.tokenize(p)]).tobytes()

    def _find(self, words: list[np.ndarray], slots: tuple[np.ndarray, np.ndarray], short: np.ndarray) -> np.ndarray:
        """Number of each piece, or -1; equal slots are not taken for equal pieces."""
        out = np.full(len(short), -1, np.int32)
        if not self.known:
            return out
        todo = np.flatnonzero(short)
        for slot in slots:
            k = self.number[slot[todo]]
            ok = k >= 0
            for w, own in zip(words, self.words, strict=True):
                ok &= own[np.maximum(k, 0)] == w[todo]
            out[todo[ok]] = k[ok]
            todo = todo[~ok]
        return out

    def _keep(self, words: list[np.ndarray], slots: tuple[np.ndarray, np.ndarray], made: list[bytes]) -> None:
        """Remember new pieces, as far as there is room."""
        room = self.most - self.known
        if room <= 0 or not made:
            return
        made, words, slots = made[:room], [w[:room] for w in words], [s[:room] for s in slots]
        n, size = len(made), np.array([len(x) // 4 for x in made])
        while self.known + n > len(self.first):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        own = slice(self.known, self.known + n)
        self.words[:, own] = words
        self.size[own], self.first[own] = size, self.used + np.cumsum(size) - size
        new = np.frombuffer(b"".join(made), np.uint32)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(new)] = new
        self.used += len(new)
        todo = np.arange(n)
        for slot in slots:
            todo = todo[self.number[slot[todo]] < 0]
            self.number[slot[todo]] = self.known + todo
            todo = todo[self.number[slot[todo]] != self.known + todo]
        self.known += n

    def _slice(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows without added tokens, and the offsets of the rows' ids."""
        if not len(raw):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        start = self.cuts(raw, at)
        size = np.diff(np.append(start, len(raw)))
        padded = np.concatenate([raw, np.zeros(LONG, np.uint8)])
        eight = np.ndarray(len(raw) + LONG - 7, "<u8", padded, strides=(1,))
        words = [np.zeros(len(start), np.uint64) for _ in range(3)]
        for i, w in enumerate(words):  # the bytes of a piece, in words of eight
            some = np.flatnonzero(size > 8 * i) if i else slice(None)
            n = np.minimum(size[some] - 8 * i, 8).astype(np.uint64)
            w[some] = eight[np.minimum(start[some] + 8 * i, len(raw))] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - n * np.uint64(8)))
        h = words[0] * np.uint64(0x9E3779B97F4A7C15) ^ words[1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ words[2] * np.uint64(0x165667B19E3779F9)
        h = C.mix(h)
        slots = (h >> np.uint64(64 - _SLOTS)).astype(np.int64), (h & np.uint64((1 << _SLOTS) - 1)).astype(np.int64)
        number = self._find(words, slots, size <= LONG)
        known, new = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
        # ids of known pieces stand in the table, those of new ones behind it
        first, count = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        first[known], count[known] = self.first[number[known]], self.size[number[known]]
        source = self.ids[: self.used]
        if len(new):
            data, seen, made, which, keep = raw.tobytes(), {}, [], [], []
            for i, s, n in zip(new.tolist(), start[new].tolist(), size[new].tolist(), strict=True):
                piece = data[s : s + n]
                j = seen.get(piece)
                if j is None:
                    j = seen[piece] = len(made)
                    made.append(self._piece(piece))
                    if n <= LONG:
                        keep.append((i, j))
                which.append(j)
            fresh = np.array([len(x) // 4 for x in made], np.int64)
            first[new], count[new] = (len(source) + np.cumsum(fresh) - fresh)[which], fresh[which]
            source = np.concatenate([source, np.frombuffer(b"".join(made), np.uint32)])
            if keep:
                at_, of = np.array(keep).T
                self._keep([w[at_] for w in words], [x[at_] for x in slots], [made[j] for j in of.tolist()])
        ends = np.concatenate([[0], np.cumsum(count)])
        return source[runs_of(first, count)], ends[np.searchsorted(start, at)]

    def encode_rows(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of the rows, end to end, and the offsets of each row's ids."""
        data = raw.tobytes()
        if self.added is None or not self.added.search(data):
            return self._slice(raw, at)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if self.added.search(data, a, b):
                out.append(np.array(self.tokenizer.encode(data[a:b].decode(), add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self._slice(raw[a:b], np.array([0, b - a]))[0])
        return np.concatenate(out), np.cumsum([0, *map(len, out)])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of one text; null and empty texts have none."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0]

    def documents(self, batch, end_id: int):
        """(doc_id, ids and the end id) of each row of a batch with doc_id and text."""
        end = np.array([end_id], np.uint32)
        for part, raw, at in C.pieces(batch, SLICE):
            ids, ids_at = self.encode_rows(raw, at)
            for doc, a, b in zip(part["doc_id"].to_pylist(), ids_at[:-1].tolist(), ids_at[1:].tolist(), strict=True):
                yield doc, np.concatenate([ids[a:b], end])


def word_cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First bytes of pieces for a tokenizer that drops white space and takes letters, single digits and other marks apart."""
    begin = np.zeros(len(raw), bool)
    kind = _KIND[raw]
    accent = np.flatnonzero(raw[:-1] == 0xC3)
    accent = accent[(raw[accent + 1] != 0x97) & (raw[accent + 1] != 0xB7)]
    kind[accent] = kind[accent + 1] = 1
    left, right = kind[:-1], kind[1:]
    # nothing that is composed, and no word, goes over white space; an apostrophe can take the letters behind it
    begin[1:] = (left != right) & ((left == 4) | (right == 4) | (left > 0) & (right > 0) & ~((raw[:-1] == 39) & (right == 1)))
    begin[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(begin)


class WordEncoder(Encoder):
    """For files whose tokenizer lower-cases, drops white space and marks the ends of words."""

    cuts = staticmethod(word_cuts)

    def _piece(self, piece: bytes) -> bytes:
        if piece.isspace():
            return b""
        if piece.isalpha():  # letters of ASCII
            return array("I", [t.id for t in self.model.tokenize(piece.decode().lower())]).tobytes()
        return array("I", self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()


def encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _HELD:
        _HELD[path] = kind(path)
    return _HELD[path]
