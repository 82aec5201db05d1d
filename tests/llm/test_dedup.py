import hashlib
import random
import re
from collections import Counter, defaultdict

import cases
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common as C
from graphloom.llm import op1_suffix_dedup as op1
from graphloom.llm import op5_minhash as op5
from graphloom.llm import op7_warc as op7


def brute_repeats(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = True
        left = np.frombuffer(t, np.uint8)[~hit].tobytes()
        yield len(t), int(hit.sum()), int((np.diff(np.append(0, hit.astype(int))) == 1).sum()), left


@pytest.mark.parametrize(("length", "lead", "piece"), [(40, 16, 1500), (64, 8, op1.SLICE)])
def test_repeats(spark, monkeypatch, length, lead, piece):
    monkeypatch.setattr(op1, "SLICE", piece)
    rows, df = cases.documents(spark)
    want = Counter(zip([i for i, _ in rows], brute_repeats([(t or "").encode() for _, t in rows], length), strict=True))
    got = Counter((r.row.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept)) for r in op1.remove_repeats(df, length, lead).collect())
    assert got == Counter({k: v for k, v in want.items()})


def test_repeats_around_a_hot_passage(spark):
    r = np.random.default_rng(5)

    def text(n):
        return bytes(r.integers(97, 123, n).astype(np.uint8))

    # the least hash of all lies early in the hot passage, so that many suffixes share over 128 bytes
    hot = min((text(200) for _ in range(3000)), key=lambda x: C.mix(C.windows_hash(np.frombuffer(x, np.uint8), 64)[:30]).min())
    texts = []
    for _ in range(120):
        left, right = text(150), text(150)
        texts += [text(r.integers(150, 300)) + left + hot + right + text(r.integers(150, 300)) for _ in range(2)]
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        got = {x.row.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept) for x in op1.remove_repeats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == dict(enumerate(brute_repeats(texts, 400)))


def brute_passages(texts, words):
    found = [list(re.finditer("[^\x20\x09-\x0d]+", t)) for t in texts]
    count = Counter(t[m[i].start() : m[i + words - 1].end()] for t, m in zip(texts, found, strict=True) for i in range(len(m) - words + 1))
    for t, m in zip(texts, found, strict=True):
        hit = np.zeros(len(t), bool)
        for i in range(len(m) - words + 1):
            s, e = m[i].start(), m[i + words - 1].end()
            if count[t[s:e]] > 1:
                hit[s:e] = True
        yield "".join(c for c, h in zip(t, hit, strict=True) if not h)


def test_passages_are_counted_in_words(spark):
    r = random.Random(7)

    def some(n, most=3):
        return ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, most))) for _ in range(n)]

    def rows_of(passage):  # in two documents, between other words, blanks and lines
        return [" ".join(some(80, 9)) + " " + passage + "\n" + " ".join(some(70, 9)) for _ in range(2)]

    short, fewer, long = " ".join(some(51, 2)), " ".join(some(50, 2)), "  ".join(some(70)) + "\n" + " ".join(some(30))
    blanks = " ".join(some(60, 2))
    wide = " ".join("w" * r.randint(20, 30) for _ in range(40))  # 800 bytes and more, but 40 words
    texts = [*rows_of(short), *rows_of(fewer), *rows_of(long), *rows_of(wide), rows_of(blanks)[0], rows_of(blanks.replace(" ", "\n"))[0], "x " * 300, short, " " + long + " "]
    df = spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, " \n ")], "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in corpus_pipeline.suffix_dedup(spark, df, "").collect()}
    assert [got.pop(i) for i in (100, 101, 102)] == [None, "", " \n "]
    assert len(short) < 256 and short not in got[0] and fewer in got[2] and wide in got[6]
    assert got == dict(enumerate(brute_passages(texts, 51)))


def test_words_in_passages(spark):
    r = random.Random(9)

    def some(n):
        return ["".join(r.choice("abcde") for _ in range(r.randint(1, 6))) for _ in range(n)]

    a, b, c = some(51), some(50), some(80)
    texts = [some(60) + a + some(40), a + some(9) + c, b + some(70), some(20) + b, c[10:] + some(3) + c[:70] + some(2) + c[20:75], [], some(4)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(99, None)], "rid bigint, text string")
    count = Counter(tuple(t[i : i + 51]) for t in texts for i in range(len(t) - 50))
    want = {}
    for j, t in enumerate(texts):
        hit = {k for i in range(len(t) - 50) if count[tuple(t[i : i + 51])] > 1 for k in range(i, i + 51)}
        if hit:
            want[j] = len(hit)
    assert {x.rid: x.n_passage_words for x in op1.passage_words(df).collect()} == want and len(want) == 3


def test_repeats_keep_columns_and_characters(spark):
    rows, df = cases.documents(spark)
    out = op1.dedup_documents(df, 41, 16)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("doc_id = 1000").first().text is None
    assert not [r for r in out.collect() if r.text and "�" in r.text]


def test_repeats_of_nothing(spark):
    assert op1.remove_repeats(cases.empty(spark)).count() == 0


def test_multikey_order():
    r = np.random.default_rng(0)
    strings = [bytes(r.integers(97, 100, r.integers(1, 30)).astype(np.uint8)) for _ in range(2000)] + [b"same"] * 50
    assert [strings[i] for i in op1.multikey_order(op1._words(strings, 32))] == sorted(strings)


def brute_components(rows, k, percent=80):
    sets = {}
    for at, (_, t) in enumerate(rows):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))
        sets[at] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {a: a for a in sets}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    by, both = defaultdict(list), Counter()
    for a, s in sets.items():
        for x in s:
            both.update((b, a) for b in by[x])
            by[x].append(a)
    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for a in sets:
        least[top(a)] = min(least.get(top(a), rows[a][0]), rows[a][0])
    return Counter((rows[a][0], len(s), least[top(a)]) for a, s in sets.items())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, monkeypatch, k):
    monkeypatch.setattr(op5, "BLOCK", 16)
    rows, df = cases.documents(spark, seed=k)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op5.NearDuplicates(df, k=k).components().collect())
    assert got == brute_components(rows, k)


def nearly_similar(n, seed=0):
    """A group around one text: few edits and many, cut ends, sub-groups that share edits and cut ends."""
    r = random.Random(seed)
    new = iter(range(10**6))
    base = [f"b{i}" for i in range(130)]

    def edited(words, times):
        words = list(words)
        for i in r.sample(range(len(words)), times):
            words[i] = f"n{next(new)}"
        return words

    own = [edited(base, k) for k in (3, 6, 9)]
    rows = []
    for i in range(n):
        words = edited(base, r.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]))
        if i % 4 == 1:
            words = edited(own[i % 3], r.randrange(6))
        elif i % 4 == 2:
            words = base[: r.randint(60, 130)]
        elif i % 8 == 3:
            words = edited(base[r.randint(0, 30) :], r.randrange(4)) + [f"n{next(new)}"] * r.randint(0, 9)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("levels", "blocks", "small"), [(0, 1, 3), (1, 1, 3), (3, 1, 3), (3, 2, 12)])
def test_near_duplicates_in_a_large_group(spark, monkeypatch, levels, blocks, small):
    for name, x in (("BLOCK", 8), ("SMALL", small), ("LEVELS", levels), ("FEW_BLOCKS", blocks)):
        monkeypatch.setattr(op5, name, x)
    rows = nearly_similar(240)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op5.NearDuplicates(df, k=4).components().collect())
    assert got == brute_components(rows, 4)
    assert 20 < len({c for _, _, c in got}) < 200


def test_long_lists_do_not_cost_a_comparison_of_each_pair(spark, monkeypatch, tmp_path):
    def count(batches, *_):
        for batch in batches:
            with open(f"{tmp_path}/sent", "a") as f:
                f.write(f"{sum(len(side) for c in ('one', 'two') for side in batch[c].to_pylist())}\n")
        return iter(())

    monkeypatch.setattr(op5, "BLOCK", 8)
    monkeypatch.setattr(op5, "_compare", count)
    sent = []
    for n in (200, 400):
        r = random.Random(n)
        rows = [(i, " ".join(f"n{n * i + j}" if j in edits else f"b{j}" for j in range(130))) for i in range(n) for edits in [set(r.sample(range(130), 6))]]
        (tmp_path / "sent").write_text("0\n")
        op5.NearDuplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=4)
        sent.append(sum(map(int, (tmp_path / "sent").read_text().split())))
    assert sent[1] < 3 * sent[0] + 1000


def test_near_dedup_keeps_one(spark):
    rows, df = cases.documents(spark)
    out = op5.near_dedup(df, k=4)
    assert out.columns == df.columns
    assert out.count() == len({c if n else (c, d, i) for i, (d, n, c) in enumerate(brute_components(rows, 4).elements())})
    assert op5.near_dedup(cases.empty(spark)).count() == 0


def test_equal_digest_of_rest(spark, sf_dir):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for (i, _), x in zip(docs, brute_repeats([t for _, t in docs], 400), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1.op1_suffix_dedup(spark, sf_dir).collect()}
    assert got == want


def with_splits(spark, n, f):
    """f() with files cut into ``n`` splits or more, as if more cores had joined."""
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.minPartitionNum", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 27 if n == 1 else 1 << 12))
    try:
        return f()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_row_numbers_do_not_follow_the_splits(spark, tmp_path):
    rows, df = cases.documents(spark)
    long = df.withColumn("row", F.repeat(F.sha2("text", 256), 200))  # several row groups
    long.repartition(3).write.option("parquet.block.size", "4096").parquet(f"file://{tmp_path}/docs")
    docs = spark.read.parquet(f"file://{tmp_path}/docs")
    ids = lambda d: sorted((r.rid, r.row.doc_id) for r in C.numbered(d).select("rid", "row").collect())
    few, many = with_splits(spark, 1, docs.rdd.getNumPartitions), with_splits(spark, 40, lambda: spark.read.parquet(f"file://{tmp_path}/docs").rdd.getNumPartitions())
    assert few < many
    for d in (docs, docs.select("doc_id", "text").where("doc_id <> 5"), spark.read.parquet(f"file://{tmp_path}/docs", f"file://{tmp_path}/docs"), docs.join(docs.select("doc_id").distinct(), "doc_id")):
        a, b = with_splits(spark, 1, lambda d=d: ids(d)), with_splits(spark, 40, lambda d=d: ids(d))
        assert len({i for i, _ in a}) == len(a) == d.count() and len({i for i, _ in b}) == len(b)
    assert with_splits(spark, 1, lambda: ids(docs)) == with_splits(spark, 40, lambda: ids(docs))

    def late(build, collect):
        """A plan that is made with one number of splits and run with another."""
        plan = with_splits(spark, 1, build)
        return with_splits(spark, 40, lambda: collect(plan))

    kept = late(lambda: op5.near_dedup(docs, k=4), lambda x: sorted(r.doc_id for r in x.collect()))
    assert kept == sorted(r.doc_id for r in op5.near_dedup(docs, k=4).collect()) and len(kept) > 10
    cut = lambda x: Counter((r.row.doc_id, r.n_removed, r.kept) for r in x.collect())
    want = Counter((i, x[1], x[3]) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 40), strict=True))
    assert late(lambda: op1.remove_repeats(docs, 40, 16), cut) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.coalesce("text", F.lit("")).alias("html"))
    op7.write(pages, f"file://{tmp_path}/warc")
    assert op7.read(spark, f"file://{tmp_path}/warc").count() == len(rows)
