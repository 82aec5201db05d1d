import hashlib
import re
import zlib

import cases
import duckdb
import numpy as np
import pytest
import pyarrow as pa

import corpus_pipeline
from graphloom.llm import common as C
from graphloom.llm import op2_decontaminate as op2
from graphloom.llm import op3_chunks as op3
from graphloom.llm import op6_toxicity as op6
from graphloom.llm import op7_warc as op7
from graphloom.llm import op8_licenses as op8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


@pytest.mark.parametrize(("block", "piece"), [(1 << 20, 1 << 16), (60, 13)])
def test_decontaminate(spark, monkeypatch, block, piece):
    monkeypatch.setattr(op2, "BLOCK", block)
    monkeypatch.setattr(op2, "PIECE", piece)
    rows, df = cases.documents(spark)
    texts = [t for _, t in rows]
    items = [(1, " ".join(words(texts[0])[5:30])), (22, "Tie, tie"), (3, None), (4, ""), (5, "never seen"), (6, texts[7]), (7, "a"), (6, texts[9]), (None, " ".join(words(texts[11])[3:40])), (8, "new words " * 3000 + texts[20])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, rid string")
    windows = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for j in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[j : j + m]), set()).add("" if i is None else str(i))
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if own := windows.get(tuple(w[j : j + m])):
                    found |= own
                    hit |= set(range(j, j + m))
        want.append((i, len(w), len(hit), sorted(found)))
    got = [(r.row.doc_id, r.n_words, r.n_hit, r["items"]) for r in op2.annotate(df, bench).collect()]
    assert sorted(got) == sorted(want)
    kept = op2.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not x[2] for x in want)
    longest = {(r.item_id, r.item_start): r.n_words for r in op2.longest_matches(df, bench).collect()}
    if piece > 1000:  # matches end with the pieces
        assert longest["1", 0] == 25 and longest["6", 0] == max(len(words(texts[7])), len(words(texts[9]))) and longest["1", 3] == 22
    assert all(n >= min(10, longest["1", 0]) for (i, _), n in longest.items() if i == "1")
    assert op2.annotate(cases.empty(spark), bench).count() == 0
    assert op2.annotate(df, bench.limit(0)).where("n_hit > 0").count() == 0


def test_chunks(spark):
    rows, df = cases.documents(spark)
    got = {r.doc_id: r for r in op3.ChunkStore(df).features().collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[1003].media_sha256 == got[1004].media_sha256
    store = op3.ChunkStore(df)
    again = {r.doc_id: r for r in store.features().collect()}
    assert again == got  # the same table gives the same stored bytes
    staged = store.staged.collect()
    bodies = {r.digest: bytes(r.body) for r in staged if r.body is not None}
    for i, t in rows:
        rid = min(r.rid for r in staged if r.doc_id == i)  # rows may repeat
        media = b"".join(bytes(r.digest) + bodies[r.digest] for r in sorted((r for r in staged if r.rid == rid), key=lambda r: r.seq))
        payload = (t or "").encode()
        payload += bytes(max(64, -(-len(payload) // 64) * 64) - len(payload))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"mean={sum(payload) / len(payload):.4f};max={max(payload)};" in got[i].feature
    assert op3.ChunkStore(cases.empty(spark)).features().count() == 0


def test_cuts_move_with_the_content():
    p = np.random.default_rng(0).integers(0, 256, 300_000).astype(np.uint8)
    shifted = np.concatenate([p[:1000], np.array([1, 2, 3], np.uint8), p[1000:]])
    a, b = op3.cuts(p), op3.cuts(shifted)
    assert len(set(a) & {x - 3 for x in b}) > len(a) - 4 and a[-1] == len(p) and max(np.diff([0, *a])) <= op3.MOST


def test_network_gradients():
    raw, at = C.text_buffer(pa.array(["you are a bad mean thing", "nice day to you all"]))
    index, words_at, bucket, grams, grams_at = op6.features(raw, at)
    net = op6.Network()
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    _, first, n = op6.windows(words_at)
    mask = np.arange(op6.WINDOW) < n[:, None]
    place = np.append(index, 0)[np.where(mask, np.minimum(first[:, None] + np.arange(op6.WINDOW), len(index)), len(index))]
    args = (bucket, grams, grams_at, place, mask, np.array([1, 0.0]), np.ones(2))
    g, _ = net.gradients(*args)
    for k, x in net.p.items():
        i = np.unravel_index(np.argmax(abs(g[k])), x.shape)
        old, loss = x[i], []
        for step in (1e-3, -1e-3):
            x[i] = old + step
            loss.append(net.gradients(*args)[1])
        x[i] = old
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][i]) < 1e-4 * max(1, abs(g[k][i]))


def test_toxicity_held_out(spark):
    _, base = cases.documents(spark, n=400, extra=False)
    rows = [(r.doc_id, (r.text or "") + (" you vile scum" if r.doc_id % 5 == 0 and r.doc_id < 400 else "")) for r in base.where("doc_id < 400").dropDuplicates(["doc_id"]).collect()]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i, _ in rows] + [(5000, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    net = op6.fit(docs, labels)
    got = {r.row.doc_id: r.score for r in op6.score(docs, net).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.3) == (i % 5 == 0) for i in held]) > 0.95
    assert 0 <= got[900] == got[901] < 0.3
    assert op6.score(docs, op6.fit(docs, labels.limit(0))).where("score > 0").count() == 0
    assert op6.drop_toxic(cases.empty(spark), net).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/ b\r\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999), (None, "n", big), (2, None, big), (8, "v", "y" * 1000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    op7.write(pages, f"file://{tmp_path}/w", archive_bytes=300)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op7.read(spark, f"file://{tmp_path}/w").collect()), key=str)
    digest = lambda t: (len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
    want = [(i, *digest(t), "response", None) for i, _, t in rows if t != big] + [(2, *digest(big), "response", None)] + [(i, *digest(big), "revisit", 2) for i in (1, None, 2)]
    assert got == sorted(want, key=str)
    folder = tmp_path / "out"
    folder.mkdir()
    assert op7.export(spark, f"file://{tmp_path}/w", str(folder)) == len(list(folder.iterdir())) > 1
    op7.write(pages.limit(0), f"file://{tmp_path}/none")
    assert op7.read(spark, f"file://{tmp_path}/none").count() == 0


def test_licenses(spark):
    notice = dict(op8.TEMPLATES)
    long = notice["mit-grant"]
    broken = " ".join(w for i, w in enumerate(long.split()) if i != 20)
    rows, _ = cases.documents(spark)
    rows = [(i, t) for i, t in rows] + [(2000, "x y " + long), (2001, broken), (2002, " ".join(long.split()[:20])), (2003, "Released under the MIT License. " * 3), (2003, "Released under the MIT License. " * 3), (2004, notice["bsd-redistribution"].upper())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    want = sorted(con.sql(f"SELECT doc_id, template_id, matched, template_shingles, first_word FROM ({op8.SQL})").fetchall())
    got = sorted((r.doc_id, r.template_id, r.matched, r.template_shingles, r.first_word) for r in op8.scan(docs, op8.default_templates(spark)).collect())
    assert got == want and {2000, 2001, 2003, 2004} <= {r[0] for r in got} and 2002 not in {r[0] for r in got}
    assert op8.scan(cases.empty(spark), op8.default_templates(spark)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = C.stored(stage(spark, docs, sf_dir), name)
        if name != "pack":
            assert out.columns == columns and 0 < out.count() <= docs.count()
            docs = out
    want = {(r.doc_id, r.n) for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert want == {(r.doc_id, r.doc_tokens) for r in out.select("doc_id", "doc_tokens").distinct().collect()} and len(want) == docs.count()
