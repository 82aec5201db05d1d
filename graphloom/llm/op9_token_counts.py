"""Token counts by a linear longest-match automaton.

The vocabulary is a trie; a node's failure link leads to where matching goes on when
no child fits, and each node holds how many tokens are popped on that way.  Reading a
word, each byte moves down the trie or over failure links, so the number of greedy
longest-match pieces comes out in linear time without building a piece.

Words are normalised as the vocabulary's file says (composed, lower case) and end
with its end-of-word mark, so final pieces are told from inner ones.

Defined cases: null, empty and blank texts have no words and no tokens; a word that the
vocabulary cannot spell is one unknown token; repeated rows are counted one by one;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common as C
from .tokens import byte_characters

END = "</w>"
#: Words of the vocabulary file's pre-tokenizer; a fixed value of that file format.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
COUNTS = "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint, longest bigint"
_HELD: dict[str, Automaton] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(path: str) -> list[str]:
    """The vocabulary's pieces, without special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec["added_tokens"]}
    return [p for p in spec["model"]["vocab"] if p not in special]


class Automaton:
    """Counts greedy longest-match pieces of words; symbols are bytes, 256 is the end of a word."""

    def __init__(self, pieces: Iterable[tuple[int, ...]], most: int = 500_000) -> None:
        self.next: dict[int, int] = {}  # node * 512 + symbol -> node
        token = [False]
        order: list[tuple[int, int, int]] = []  # parent, symbol, node
        for piece in pieces:
            node = 0
            for s in piece:
                key = node * 512 + s
                to = self.next.get(key)
                if to is None:
                    to = self.next[key] = len(token)
                    token.append(False)
                    order.append((node, s, to))
                node = to
            token[node] = node != 0
        depth = [0] * len(token)
        for u, _, v in order:
            depth[v] = depth[u] + 1
        self.fail = [-1] * len(token)
        self.pops = [0] * len(token)
        for u, s, v in sorted(order, key=lambda x: depth[x[2]]):
            if token[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            z, pops = self.fail[u], self.pops[u]
            while z >= 0 and z * 512 + s not in self.next:
                pops += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.next[z * 512 + s], pops
        self.known: dict[str, int] = {}
        self.most = most

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of a symbol sequence; -1 if it cannot be spelt."""
        node, n, go, fail, pops = 0, 0, self.next, self.fail, self.pops
        for s in symbols:
            while (to := go.get(node * 512 + s)) is None:
                if not node or fail[node] < 0:
                    return -1
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return -1
            n += pops[node]
            node = fail[node]
        return n

    def word(self, word: str) -> int:
        """Pieces of one word with its end mark; remembered, up to a bound."""
        n = self.known.get(word)
        if n is None:
            n = self.count((*word.encode(), 256))
            if len(self.known) < self.most and len(word) < 64:
                self.known[word] = n
        return n

    @classmethod
    def of_file(cls, path: str) -> Automaton:
        byte = {c: b for b, c in byte_characters().items()}
        split = lambda p: (*(byte[c] for c in p.removesuffix(END)), *([256] if p.endswith(END) else []))
        return cls(split(p) for p in pieces_of(path))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(unicodedata.normalize("NFC", text or "").lower())


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    if path not in _HELD:
        _HELD[path] = Automaton.of_file(path)
    automaton = _HELD[path]
    for batch in batches:
        out = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            n = list(map(automaton.word, words_of(text.as_py())))
            unknown = n.count(-1)
            out.append((doc, len(n), sum(n) + 2 * unknown, unknown, max(n, default=0)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in COUNTS.split(", ")])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown and longest (tokens of the longest word) of whole texts."""
    path = path or default_path()
    return C.clean(docs, "doc_id", "text").mapInArrow(lambda it: _count(it, path), COUNTS)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts(C.table(spark, sf_dir, "documents"))


#: Greedy longest matches over 49,000 pieces have no SQL form; brute force stands in.
SQL = None
