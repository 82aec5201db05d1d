import random
import zlib

import cases
import numpy as np
import tokenizers

from graphloom.llm import op4_repair as op4
from graphloom.llm import op9_token_counts as op9
from graphloom.llm import op10_pack as op10
from graphloom.llm import tokens


def plain():
    return tokenizers.Tokenizer.from_file(tokens.default_path())


def test_cached_pieces_equal_the_library():
    enc, ref, r = tokens.encoder(tokens.default_path()), plain(), random.Random(1)
    alphabet = " \n\t  aB1'.,sé 　漢\x1c\x85#​<|>"
    for i in range(3000):
        x = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        x = x.replace("B", "'re ") if i % 3 == 0 else x + "<|endoftext|>" * (i % 50 == 1)
        assert enc.encode(x).tolist() == ref.encode(x, add_special_tokens=False).ids
    alphabet = ["\n", " ", "\t", "  ", "\u2003", "\xa0", "a", "bc", "É", "é", "×", "'", "'s", "'ll", "7", "²", ".", "(", "漢", "e\u0301", "\x1c", "я", "<|endoftext|>", "ab" * 20]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 9))) for _ in range(6000)]
    for few in (400_000, 300):  # a cache with room, and a full one
        enc = tokens.Encoder(tokens.default_path(), few)
        for at in range(0, len(texts), 50):
            rows = texts[at : at + 50]
            raw = [x.encode() for x in rows]
            ids, ids_at = enc.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            want = [ref.encode(x, add_special_tokens=False).ids for x in rows]
            assert [ids[a:b].tolist() for a, b in zip(ids_at[:-1], ids_at[1:], strict=True)] == want


def test_pieces_of_one_slot(monkeypatch):
    monkeypatch.setattr(tokens, "_SLOTS", 2)
    enc, ref = tokens.Encoder(tokens.default_path()), plain()
    for _ in range(2):
        for i in range(40):
            x = f"word{i} other{i * 7} w" + "x" * i
            assert enc.encode(x).tolist() == ref.encode(x, add_special_tokens=False).ids


def ids_of(text, end):
    return np.array([*plain().encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_repair_round_trip(spark, tmp_path):
    rows, df = cases.documents(spark)
    op4.write(df, f"file://{tmp_path}/ids", shard_ids=5000)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op4.read(spark, f"file://{tmp_path}/ids").collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        ids = ids_of(t, 2)
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    op4.write(cases.empty(spark), f"file://{tmp_path}/none")
    assert op4.read(spark, f"file://{tmp_path}/none").count() == 0


def test_repair_random_access():
    r = np.random.default_rng(1)
    docs = [np.append(r.integers(0, 5, r.integers(0, 900)), 2).astype(np.uint32) for _ in range(20)] + [np.append(np.full(500, 3), 2).astype(np.uint32)]
    data = op4.write_shard(docs, 2, 2)
    shard = op4.Shard(data)
    assert (shard.all() == np.concatenate(docs)).all() and len(shard.symbols) < sum(map(len, docs)) / 2
    for i, d in enumerate(docs):
        a = int(r.integers(0, len(d)))
        b = int(r.integers(a, len(d) + 1))
        assert (shard.document(i) == d).all() and (shard.span(i, a, b) == d[a:b]).all()


def test_repair_leaves_no_frequent_pair(monkeypatch):
    r = np.random.default_rng(3)
    for wide in (False, True):
        words = [r.integers(3, 300, r.integers(2, 9)) for _ in range(400)]
        docs = [np.append(np.concatenate([words[int(i)] for i in r.zipf(1.3, 200) % 400]), 2).astype(np.uint32) for _ in range(40)]
        docs.append(np.append(np.full(77, 5), 2).astype(np.uint32))
        if wide:  # more than 65,536 symbols
            docs.append(np.append(np.arange(10, 70_000), 2).astype(np.uint32))
        shard = op4.Shard(op4.write_shard(docs, 2))
        assert (shard.all() == np.concatenate(docs)).all() and (len(shard.rules) + shard.base > 1 << 16) == wide
        end = int(np.searchsorted(shard.alphabet, 2))
        s, count, last = shard.symbols.tolist(), {}, {}
        for i, p in enumerate(zip(s[:-1], s[1:], strict=True)):
            if end not in p and last.get(p) != i - 1:
                count[p], last[p] = count.get(p, 0) + 1, i
        assert max(count.values(), default=0) < op4.LEAST


def test_pack(spark):
    rows, df = cases.documents(spark)
    got = op10.pack(df.repartition(3), size=1024, open_windows=8, group=5).toPandas()
    want = sorted((i, len(x), zlib.crc32(x[a : a + 1024].tobytes()), a) for i, t in rows for x in [ids_of(t, 1)] for a in range(0, len(x), 1024))
    assert sorted(zip(got.doc_id, got.doc_tokens, got.ids_crc32, got.start, strict=True)) == want
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 1024
    assert got.length.sum() / (1024 * got.sequence_id.nunique()) > 0.9
    assert op10.pack(cases.empty(spark)).count() == 0


def test_packed_sequences(spark):
    rows, df = cases.documents(spark)
    pieces = op10.pack(df.repartition(3), size=1024, open_windows=8, group=5, with_ids=True).persist()
    got = {r.sequence_id: (r.n_tokens, np.frombuffer(r.ids, "<u4")) for r in op10.sequences(pieces, 1024, 7).collect()}
    assert all(len(x) == 1024 and (x[n:] == 7).all() for n, x in got.values())
    for p in pieces.collect():
        assert zlib.crc32(got[p.sequence_id][1][p.offset : p.offset + p.length].astype("<u4").tobytes()) == p.ids_crc32
    assert sum(n for n, _ in got.values()) == sum(len(ids_of(t, 1)) for _, t in rows)


def test_added_tokens_get_their_ids(spark, tmp_path):
    ref = tokenizers.Tokenizer.from_file(tokens.default_path())
    enc = tokens.encoder(tokens.default_path())
    texts = ["a<|endoftext|>b", "<|endoftext|>", " a  <|endoftext|> b\n", "<|endoftext|><|endoftext|>é", "<|endoftext", "a b", "it's \n 漢"]
    want = [ref.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in want[0] and [enc.encode(t).tolist() for t in texts] == want
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")

    def crc(ids, end):
        return zlib.crc32(np.array([*ids, end], "<u4").tobytes())

    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in op10.pack(df).collect()} == {i: (len(x) + 1, crc(x, 1)) for i, x in enumerate(want)}
    op4.write(df, f"file://{tmp_path}/ids")
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op4.read(spark, f"file://{tmp_path}/ids").collect()} == {i: (len(x) + 1, crc(x, 2)) for i, x in enumerate(want)}


def test_automaton():
    r = random.Random(2)
    for _ in range(150):
        pieces = {tuple(r.choice([97, 98, 99, 256]) for _ in range(r.randint(1, 5))) for _ in range(r.randint(2, 12))}
        automaton = op9.Automaton(pieces)
        for _ in range(40):
            s = [r.choice([97, 98, 99, 256]) for _ in range(r.randint(0, 12))]
            i = n = 0
            while i < len(s):
                step = next((k for k in range(5, 0, -1) if i + k <= len(s) and tuple(s[i : i + k]) in pieces), 0)
                if not step:
                    n = -1
                    break
                i, n = i + step, n + 1
            assert automaton.count(s) == n


def test_token_counts(spark):
    rows, df = cases.documents(spark)
    byte, pieces = tokens.byte_characters(), set(op9.pieces_of(op9.default_path()))

    def greedy(word):
        s, i, n = [*(byte[b] for b in word.encode()), op9.END], 0, 0
        while i < len(s):
            i = next(j for j in range(len(s), i, -1) if "".join(s[i:j]) in pieces)
            n += 1
        return n

    some = {w: greedy(w) for _, t in rows for w in set(op9.words_of(t)) if len(w) < 40}
    got = {r.doc_id: r for r in op9.token_counts(df).collect()}
    for i, t in rows:
        words = op9.words_of(t)
        if all(w in some for w in words):
            assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(some[w] for w in words), 0)
    assert op9.token_counts(cases.empty(spark)).count() == 0
