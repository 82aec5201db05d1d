"""Every stage of the corpus pipeline against brute force, with nulls, copies, empty tables and clashing columns."""

import random
from collections import Counter

import cases
import corpus_pipeline
import pytest
from test_dedup import brute_components, brute_passages
from test_others import words
from test_tokens import ids_of

from graphloom.llm import op6_toxicity as op6

#: the columns of documents, and such as operators use themselves
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid bigint, row string, spans string, `a.b` int"


def corpus(spark, tmp_path, tables=True):
    """Writes documents, labels and benchmark into a folder."""
    r = random.Random(4)
    rows, _ = cases.documents(spark)
    clean = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(300)]
    some = lambda n: [r.choice(clean) for _ in range(n)]
    shared = some(60)
    rows += [(2000 + i, " ".join(some(70) + shared + some(70))) for i in range(3)]
    item = some(25)
    rows += [(3000, " ".join(some(40) + item[3:20] + some(40))), (3001, " ".join(some(40) + item[3:11] + some(40)))]
    toxic = [(4000 + i, " ".join([*some(40), "you", "vile", "scum", *some(5)])) for i in range(60)]
    fair = [(5000 + i, " ".join(some(48))) for i in range(120)]
    rows += [*toxic, *fair, (None, " ".join(some(30))), (None, None), rows[5], rows[5]]
    full = [(i, t, "xx", "hot" if k % 3 else None, None if t is None else len(t), k, "row", None, 1) for k, (i, t) in enumerate(rows)]
    labels = [(i, 1, 1) for i, _ in toxic] + [(i, 1, 0) for i, _ in fair] + [(None, 1, 1), (4001, None, None)]
    bench = [(1, " ".join(item)), (2, None), (None, ""), (2, "never seen here at all")]
    for name, data, schema in (("documents", full, SCHEMA), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", bench, "item_id bigint, text string")):
        df = spark.createDataFrame(data if tables else [], schema)
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return full if tables else []


def stage(spark, name, docs, folder):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, str(folder))


def rows_of(df):
    return Counter(map(tuple, df.collect()))


def test_toxicity_stage(spark, tmp_path):
    full = corpus(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = stage(spark, "toxicity", docs, tmp_path)
    assert out.columns == docs.columns
    kept = rows_of(out)
    assert not kept - Counter(full)
    gone = Counter(full) - kept
    bad = [x for x in full if x[0] is not None and 4000 <= x[0] < 5000]
    assert sum(x in gone for x in bad) >= 0.95 * len(bad)
    assert sum(k for x, k in gone.items() if x not in bad) <= 0.03 * len(full)
    assert not any(not (x[1] or "").strip() for x in gone)  # null and blank texts stay
    # the rows that go are those at or over the threshold
    net = op6.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert gone == Counter(tuple(r.row) for r in op6.score(docs, net).collect() if r.score >= op6.THRESHOLD)


def test_near_dedup_stage(spark, tmp_path):
    full = corpus(spark, tmp_path)
    # row numbers in the place of ids: ids are null and repeat
    groups = {}
    for (i, n, c), k in brute_components([(x[5], x[1]) for x in full], 5).items():
        groups.setdefault(c if n else ("alone", i), set()).add(i)
        assert k == 1
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = stage(spark, "near_dedup", docs, tmp_path)
    assert out.columns == docs.columns
    got = rows_of(out)
    assert not got - Counter(full)
    kept = {x[5] for x in got}
    assert sum(got.values()) == len(kept) == len(groups)
    assert all(len(g & kept) == 1 for g in groups.values()) and len(groups) < len(full) - 20


def test_suffix_dedup_stage(spark, tmp_path):
    full = [x for x in corpus(spark, tmp_path) if x[0] is not None and 2000 <= x[0] < 6000 or not x[1]]
    docs = spark.createDataFrame(full, SCHEMA)
    out = stage(spark, "suffix_dedup", docs, tmp_path)
    assert out.columns == docs.columns
    want, left = Counter(), list(brute_passages([x[1] or "" for x in full], 51))
    for x, t in zip(full, left, strict=True):
        t = None if x[1] is None else t
        want[(*x[:1], t, *x[2:4], None if t is None else len(t), *x[5:])] += 1
    assert rows_of(out) == want and sum(a[1] != b for a, b in zip(full, left, strict=True) if a[1]) == 3


def test_decontamination_stage(spark, tmp_path):
    full = corpus(spark, tmp_path)
    windows = set()
    for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect():
        w = words(r.text)
        m = min(10, len(w))
        windows |= {tuple(w[j : j + m]) for j in range(len(w) - m + 1 if m else 0)}

    def hit(text):
        w = words(text)
        return any(tuple(w[j : j + m]) in windows for m in {len(x) for x in windows} for j in range(len(w) - m + 1))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = stage(spark, "decontaminate", docs, tmp_path)
    assert out.columns == docs.columns
    assert rows_of(out) == Counter(x for x in full if not hit(x[1]))
    assert [x[0] for x in full if hit(x[1])] == [3000]


def test_pack_stage(spark, tmp_path):
    full = corpus(spark, tmp_path)
    got = stage(spark, "pack", spark.read.parquet(str(tmp_path / "documents.parquet")), tmp_path).toPandas()
    ids = [(x[0], len(ids_of(x[1], 1))) for x in full]
    # pieces that start at 0 are one for each document
    first = got[got.start == 0]
    assert Counter((None if i != i else int(i), n) for i, n in zip(first.doc_id, first.doc_tokens, strict=True)) == Counter(ids)
    assert got.length.sum() == sum(n for _, n in ids)
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.length.sum() <= 2048 and g.offset.tolist() == [0, *g.length.cumsum()[:-1]]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_empty_tables(spark, tmp_path, name):
    corpus(spark, tmp_path, tables=False)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = stage(spark, name, docs, tmp_path)
    assert out.count() == 0 and (name == "pack" or out.columns == docs.columns)
