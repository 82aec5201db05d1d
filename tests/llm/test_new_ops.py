"""Hard negatives, best-fit packing and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import tokenizers

import cases
from graphloom.llm import op11_hard_negatives as op11
from graphloom.llm import op12_best_fit as op12
from graphloom.llm import op13_repair_turns as op13
from graphloom.llm import tokens

ENDS = re.compile(r"(s?(ua)+)?")


def brute_repair(rows):
    """rows: (turn, role, text) in order.  Tries every audit with up to two insertions at each place."""
    seen, fault = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    choices = [["D"] if f in ("b", "d") else ["K", "Ru", "Ra", "D"] for f in fault]
    gaps = [(), ("Iu",), ("Ia",), ("Iu", "Ia"), ("Ia", "Iu")]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for x in put[k]:
                    cost, audit = cost + 5, audit + "I"
                    out.append(("user" if x == "Iu" else "assistant", ""))
                if k < len(rows):
                    e = edits[k]
                    audit += e[0]
                    if e == "D":
                        cost += 2
                        continue
                    cost += (e != "K") + 5 * (fault[k] == "t")
                    out.append((rows[k][1] if e == "K" else "user" if e == "Ru" else "assistant", rows[k][2]))
            if best and (cost, audit) >= best[:2]:
                continue
            if ENDS.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("b"), fault.count("d"), fault.count("t"), illegal, *best)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        out += [row] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def test_repair_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(r.choice([1, 2, 3, 3, 4])):
            rows.append((conv, r.choice([None, *range(9)]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(["Yes.", "No!", "What", " \t", "", None, "a.", "é?\n"])))
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, copies int")
    got = {x[0]: tuple(x)[1:] for x in op13.repair(df, op13.damaged).collect()}
    assert set(got) == {x[0] for x in rows}
    for conv in got:
        want = brute_repair(after_damage([x for x in rows if x[0] == conv]))
        assert got[conv] == want, conv
    assert op13.repair(df.limit(0), op13.damaged).count() == 0


def test_repair_of_long_and_repeated(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(5000)] + [(2, 7, "user", "Same.")] * 3000
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {x.conv_id: x for x in op13.repair(df).collect()}
    assert got[1].cost == 0 and got[1].audit == "K" * 5000
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in turns[:5000]).encode()).hexdigest()
    assert got[2].duplicate == 2999 and got[2].cost == 2 * 3000 and got[2].audit == "D" * 3000


def test_audits_compare_like_strings(monkeypatch):
    r = random.Random(2)
    for prime in ((1 << 61) - 1, 7):  # with 7, hashes collide all the time
        monkeypatch.setattr(op13, "_PRIME", prime)
        made = [(op13.Audit(None, ""), "")]
        for _ in range(400):
            node, s = r.choice(made[-40:])
            c = r.choice("DIKR")
            made.append((op13.Audit(node, c), s + c))
        for _ in range(4000):
            (a, x), (b, y) = r.choice(made), r.choice(made)
            assert op13.precedes(a, b) == (x < y) and str(a) == x


def brute_best_fit(lengths, size):
    """Piece by piece, by falling length, the bin with the least room; returns the bins' fills."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, used in enumerate(bins) if used + n <= size]
        if fits:
            k = max(fits, key=lambda k: bins[k])
            bins[k] += n
        else:
            bins.append(n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    r = random.Random(4)
    for turn in range(60):
        size = r.choice([7, 50, 64, 200])
        lengths = [r.randint(1, size) if turn % 3 else min(size, 1 + int(r.expovariate(8 / size))) for _ in range(r.choice([0, 1, 30, 300]))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        rows = op12.plan(counts, size)
        bins, seen = {}, {}
        for i, (n, rank, first, offset) in enumerate(rows):
            upto = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else counts[n]
            for k in range(upto - rank):
                bins.setdefault(first + k, []).append((offset, n))
            seen[n] = seen.get(n, 0) + upto - rank
        assert seen == counts
        for held in bins.values():
            held.sort()
            assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1]
        assert sorted(sum(n for _, n in held) for held in bins.values()) == brute_best_fit(lengths, size)


def word_ids(text):
    ref = tokenizers.Tokenizer.from_file(op12.default_path())
    return np.array([*ref.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_best_fit(spark):
    rows, df = cases.documents(spark)
    for size, parts in ((256, 5), (64, 2)):
        got = op12.pack_best_fit(df.repartition(parts), size).toPandas()
        want = sorted((i, k, a, len(x[a : a + size]), zlib.crc32(x[a : a + size].tobytes())) for i, t in rows for x in [word_ids(t)] for k, a in enumerate(range(0, len(x), size)))
        assert sorted(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32, strict=True)) == want
        fill = got.groupby("sequence_id").length.sum()
        for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
            assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist()
        assert sorted(fill) == brute_best_fit(got.length.tolist(), size)
    assert op12.pack_best_fit(cases.empty(spark)).count() == 0


def test_word_pieces_equal_the_library():
    ref, r = tokenizers.Tokenizer.from_file(op12.default_path()), random.Random(3)
    alphabet = ["\n", " ", "\t", "\x0b", "  ", "\u2003", "\xa0", "\x85", "a", "J", "Bc", "É", "é", "×", "İ", "ß", "Σ", "'", "'s", "'LL", "'ve", "7", "42", "²", ".", "--", "(", "漢", "e\u0301", "\u030c", "\u0301", "\x1c", "я", "한", "\u1112\u1161", "<|endoftext|>", "<|startoftext|>", "ab" * 20]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 9))) for _ in range(8000)]
    for few in (400_000, 300):
        enc = tokens.WordEncoder(op12.default_path(), few)
        for at in range(0, len(texts), 50):
            part = texts[at : at + 50]
            raw = [x.encode() for x in part]
            ids, ids_at = enc.encode_rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            want = [ref.encode(x, add_special_tokens=False).ids for x in part]
            assert [ids[a:b].tolist() for a, b in zip(ids_at[:-1], ids_at[1:], strict=True)] == want


def vectors(seed, n, dim, small=False):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = (r.integers(-2, 3, dim) / 256 if small else r.normal(0, 0.3, dim)).astype(np.float32).tolist()
        rows.append((i * (7 if small else 1), v, int(r.integers(0, 3))))
    rows += [(700, rows[3][1], 1), (900, [0.0] * dim, 1), (1400, None, 2), (1500, [None] + [0.5] * (dim - 1), 2), (1600, [float("nan")] * dim, 1), (1700, [float("inf")] * dim, 1), (1800, [0.1] * dim, None), (None, [0.1] * dim, 1)]
    return rows + rows[:40]  # repeated rows


SHAPE = "vec_id bigint, embedding array<float>, label int, key int, v string, windows int"


def test_hard_negatives_against_sql(spark, monkeypatch):
    monkeypatch.setattr(op11, "LEAF", 4)
    monkeypatch.setattr(op11, "BLOCK", 64)
    monkeypatch.setattr(op11, "TILE", 512)
    for seed, n, dim, small in ((1, 300, 8, False), (2, 400, 3, True), (3, 30, 1, True)):
        rows = vectors(seed, n, dim, small)
        df = spark.createDataFrame([(*x, 1, "x", 2) for x in rows], SHAPE)
        got = sorted(tuple(x) for x in op11.mine(op11.usable(df, relabel=True)).collect())
        con = duckdb.connect()
        embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"vec_id": "Int64", "label": "Int64"})  # noqa: F841
        rel = con.sql(op11.SQL.replace("FROM embeddings", "FROM (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding, label FROM embeddings)"))
        assert rel.columns == op11.RESULT
        assert got == sorted(rel.fetchall()) and len(got) > 10
    assert op11.mine(op11.usable(df.limit(0))).count() == 0
    assert op11.mine(op11.usable(df.where("vec_id % 100 <> 0"))).count() == 0


def test_tree_prunes_and_finds_all():
    r = np.random.default_rng(5)
    for dim, n in ((2, 5000), (5, 3000), (1, 700)):
        v = r.integers(-300, 300, (n, dim))
        order, leaves = op11.packed(v)
        assert sorted(order) == list(range(n)) and max(np.diff(leaves)) <= op11.LEAF and leaves[-1] == n
        tree = op11.Tree(order, order % 3, v[order], leaves)
        read = 0
        for anchor in r.integers(-300, 300, (20, dim)):
            scores = tree.v @ anchor
            lo, hi = sorted(int(x) for x in r.choice(scores, 2))
            low, high = tree.intervals(anchor[None, :])
            mine, mask = op11.Windows([(lo, hi), (op11.LEAST, op11.MOST)], 5), tree.labels != 1
            read += op11.search(tree, anchor, [x[0] for x in low], [x[0] for x in high], mine, mask)
            for found, (a, b) in zip(mine.found, [(lo, hi), (op11.LEAST, op11.MOST)], strict=True):
                some = mask & (scores >= a) & (scores <= b)
                assert found == sorted(zip((-scores[some]).tolist(), tree.ids[some].tolist(), strict=True))[:5]
        assert dim > 2 or read < 20 * len(leaves) / 2


def test_large_components_stay_whole(spark):
    rows = [(i * 100, [float(i + 1) * 2.0**17, 3.0 + i], i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want, v = set(), {i: [int(256 * x) for x in e] for i, e, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b], strict=True))
    for i, _, label in rows:
        for p in sorted((j for j, _, x in rows if x == label and j != i), key=lambda j: (-dot(i, j), j))[:5]:
            fits = [j for j, _, x in rows if x != label and 80 * dot(i, p) <= 100 * dot(i, j) <= 100 * dot(i, p)]
            want |= {(i, p, k, j, dot(i, p), dot(i, j)) for k, j in enumerate(sorted(fits, key=lambda j: (-dot(i, j), j))[:5], 1)}
    assert {tuple(x) for x in op11.mine(op11.usable(df)).collect()} == want
