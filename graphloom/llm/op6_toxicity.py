"""Toxicity scores by a small bidirectional gated recurrent network, trained in numpy.

Each word enters as a hashed word vector beside the mean of its hashed character
n-gram vectors.  The network reads windows of words in both directions, pools the
states by attention, and gives each window a logit; a document's logit is the
largest of all its overlapping windows, over the whole text, and a fitted
logistic map turns it into a probability.

The network is fitted on the driver from a bounded sample of labelled rows (see
``fit``); it is a few megabytes whatever the input.  Scoring is one pass over the
documents without a shuffle.

Defined cases: null and wordless texts are one empty window and get the score of
no evidence; labels that are null are not learnt from; with no labelled rows of
either kind the score is the share of toxic labels (0 without labels); repeated
rows are scored one by one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .op2_decontaminate import WORD

WINDOW, STRIDE = 32, 16
#: Windows that are read at once.
BATCH = 2048
WORD_ROWS, CHAR_ROWS = 1 << 15, 1 << 14
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
GRAMS = (3, 5)
THRESHOLD = 0.3


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of each word among the distinct ones, row offsets, word bucket of each distinct word, its character buckets end to end, their offsets)."""
    raw = C.lower_ascii(raw)
    start, end, words_at = C.words_of(raw, at, WORD)
    hashes = C.words_hash(raw, start, end)
    _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    bucket = (C.mix(hashes[first]) >> C.U64(17)).astype(np.int64) % WORD_ROWS
    # each distinct word between two boundary bytes
    size = (end - start)[first]
    ends = np.cumsum(size + 2)
    begin = ends - size - 2
    chars = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    chars[np.repeat(begin + 1, size) + step] = raw[np.repeat(start[first], size) + step]
    grams, of = [], []
    word = np.repeat(np.arange(len(size)), size + 2)
    for g in GRAMS:
        h = C.windows_hash(chars, g)
        inside = word[: len(h)] == word[g - 1 : g - 1 + len(h)]
        grams.append((C.mix(h[inside] ^ C.U64(g)) >> C.U64(17)).astype(np.int64) % CHAR_ROWS)
        of.append(word[: len(h)][inside])
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return index, words_at, bucket, grams[order], np.searchsorted(of[order], np.arange(len(size) + 1))


def windows(words_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of the overlapping windows of each row; one at least."""
    n = np.diff(words_at)
    count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
    row = np.repeat(np.arange(len(n)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return row, words_at[:-1][row] + step * STRIDE, np.minimum(WINDOW, n[row] - step * STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass and gradients; all arrays are float32."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        d, h, a = WORD_DIM + CHAR_DIM, HIDDEN, ATTENTION
        self.p = {"words": (r.standard_normal((WORD_ROWS, WORD_DIM)) * 0.1).astype(np.float32), "chars": (r.standard_normal((CHAR_ROWS, CHAR_DIM)) * 0.1).astype(np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": draw(d, 3 * h), f"U{k}": draw(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, a), "ca": np.zeros(a, np.float32), "v": draw(a), "o": draw(2 * h), "co": np.full(1, -2, np.float32)}
        self.scale = np.array([1.0, 0.0])  # logistic map of a document's largest logit
        self.base: float | None = None  # a constant score, where nothing can be learnt

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, grams_at: np.ndarray) -> np.ndarray:
        """Input vector of each distinct word."""
        p = self.p
        out = np.empty((len(bucket), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = p["words"][bucket]
        if len(bucket):
            out[:, WORD_DIM:] = np.add.reduceat(p["chars"][grams], grams_at[:-1], axis=0) / np.diff(grams_at)[:, None]
        return out

    def _read(self, k: str, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; x: projected inputs of the distinct words, at: (windows, steps) into x."""
        u, h = self.p[f"U{k}"], HIDDEN
        n, t = at.shape
        state = np.zeros((n, h), np.float32)
        out = np.empty((t, n, h), np.float32)
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            xi, m = x[at[:, i]], mask[:, i, None]
            zr = 1 / (1 + np.exp(-(xi[:, : 2 * h] + state @ u[:, : 2 * h])))
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(xi[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((i, state, z, r, new))
            state = np.where(m, new + z * (state - new), state)
            out[i] = state
        return out

    def logits(self, vectors: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        p = self.p
        both = [self._read(k, vectors @ p[f"W{k}"] + p[f"c{k}"], at, mask, keep.setdefault(k, []) if keep is not None else None) for k in "fb"]
        s = np.concatenate(both, axis=2)  # steps, windows, states
        e = np.tanh(s @ p["A"] + p["ca"])
        w = np.where(mask.T, np.exp(np.clip(e @ p["v"], -20, 20)), 0)
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if keep is not None:
            keep |= {"s": s, "e": e, "w": w, "pooled": pooled}
        return pooled @ p["o"] + p["co"][0]

    def gradients(self, bucket, grams, grams_at, at, mask, y, weight) -> tuple[dict[str, np.ndarray], float]:
        """Of the weighted cross-entropy over windows, by back-propagation through time."""
        p, h, keep = self.p, HIDDEN, {}
        vectors = self.inputs(bucket, grams, grams_at)
        q = sigmoid(self.logits(vectors, at, mask, keep))
        d = ((q - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": keep["pooled"].T @ d, "co": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        s, e, w = keep["s"], keep["e"], keep["w"]
        dw = np.einsum("tnh,nh->tn", s, dp)
        ds = w[:, :, None] * dp
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tna,tn->a", e, de)
        dt = de[:, :, None] * p["v"] * (1 - e * e)
        g["A"], g["ca"] = np.einsum("tnh,tna->ha", s, dt, optimize=True), dt.sum(axis=(0, 1))
        ds += dt @ p["A"].T
        dvectors = np.zeros_like(vectors)
        for k, part in (("f", ds[:, :, :h]), ("b", ds[:, :, h:])):
            u = p[f"U{k}"]
            gu, gx = np.zeros_like(u), np.zeros((len(vectors), 3 * h), np.float32)
            back = np.zeros((at.shape[0], h), np.float32)
            for i, state, z, r, new in reversed(keep[k]):
                m = mask[:, i, None]
                back = back + part[i]
                dh = np.where(m, back, 0)
                dn = dh * (1 - z) * (1 - new * new)
                drs = dn @ u[:, 2 * h :].T
                dz = dh * (state - new) * z * (1 - z)
                dr = drs * state * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                np.add.at(gx, at[:, i], dx)
                gu[:, : 2 * h] += state.T @ dx[:, : 2 * h]
                gu[:, 2 * h :] += (r * state).T @ dn
                back = np.where(m, dh * z + drs * r + dx[:, : 2 * h] @ u[:, : 2 * h].T, back)
            g[f"U{k}"], g[f"W{k}"], g[f"c{k}"] = gu, vectors.T @ gx, gx.sum(axis=0)
            dvectors += gx @ p[f"W{k}"].T
        g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
        np.add.at(g["words"], bucket, dvectors[:, :WORD_DIM])
        size = np.diff(grams_at)
        np.add.at(g["chars"], grams, np.repeat(dvectors[:, WORD_DIM:] / size[:, None], size, axis=0))
        loss = -float((weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum() / weight.sum())
        return g, loss

    def documents(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The largest window logit of each row."""
        return self._best(raw, at)[0]

    def _best(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest logit of each row, and the logits of all windows."""
        index, words_at, bucket, grams, grams_at = features(raw, at)
        row, first, n = windows(words_at)
        vectors = np.concatenate([self.inputs(bucket, grams, grams_at), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
        out = np.empty(len(row), np.float32)
        index = np.append(index, np.full(WINDOW, len(bucket)))
        for i in range(0, len(row), BATCH):
            mask = np.arange(WINDOW) < n[i : i + BATCH, None]
            place = np.where(mask, first[i : i + BATCH, None] + np.arange(WINDOW), len(index) - 1)
            out[i : i + BATCH] = self.logits(vectors, index[place], mask)
        begin = np.searchsorted(row, np.arange(len(at) - 1))
        return np.maximum.reduceat(out, begin), out

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(at) - 1, self.base)
        return sigmoid(self.documents(raw, at).astype(np.float64) * self.scale[0] + self.scale[1])


def train(texts: list[str], y: np.ndarray, epochs: int = 10, seed: int = 7) -> Network:
    """Fit a network; a document counts through its best window so far."""
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.asarray(y, np.float32)
    raw, at = C.text_buffer(pa.array(texts, pa.string()))
    index, words_at, bucket, grams, grams_at = features(raw, at)
    row, first, n = windows(words_at)
    # first coordinates start as shrunken log odds of words and n-grams over documents
    seen = {name: np.zeros((2, rows), np.int64) for name, rows in (("words", WORD_ROWS), ("chars", CHAR_ROWS))}
    for a, b in _document_runs(words_at):
        doc, word = np.divmod(np.unique(np.repeat(np.arange(a, b), np.diff(words_at[a : b + 1])) * len(bucket) + index[words_at[a] : words_at[b]]), max(len(bucket), 1))
        grams_of = np.repeat(doc, np.diff(grams_at)[word])
        for name, of, key in (("words", doc, bucket[word]), ("chars", grams_of, _spread(grams, grams_at, word))):
            of, key = np.divmod(np.unique(of * seen[name].shape[1] + key), seen[name].shape[1])
            for toxic in (0, 1):
                seen[name][toxic] += np.bincount(key[y[of] == toxic], minlength=seen[name].shape[1])
    for name, (neg, pos) in seen.items():
        odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1))
        net.p[name][:, 0] = np.clip(odds * (pos + neg) / (pos + neg + 4), -1, 4)
    prior = net.p["words"][bucket, 0] + np.add.reduceat(net.p["chars"][grams, 0], grams_at[:-1]) / np.diff(grams_at) if len(bucket) else np.zeros(0)
    sums = np.concatenate([[0], np.cumsum(np.maximum(prior, 0)[index])])
    value = sums[np.minimum(first + n, len(sums) - 1)] - sums[np.minimum(first, len(sums) - 1)]
    begin = np.searchsorted(row, np.arange(len(y) + 1))
    index = np.append(index, 0)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    turn = 0
    for epoch in range(epochs):
        if epoch in (4, 7):
            value = net._best(raw, at)[1]
        best = np.array([begin[i] + int(np.argmax(value[begin[i] : begin[i + 1]])) for i in range(len(y))])
        other = begin[:-1] + (r.random(len(y)) * np.diff(begin)).astype(np.int64)
        pick = np.concatenate([best, other[y == 0]])  # every window of a clean document is clean
        label = np.concatenate([y, np.zeros(int((y == 0).sum()), np.float32)])
        order = r.permutation(len(pick))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for i in range(0, len(order), 128):
            own = order[i : i + 128]
            k = pick[own]
            mask = np.arange(WINDOW) < n[k, None]
            place = index[np.where(mask, np.minimum(first[k, None] + np.arange(WINDOW), len(index) - 1), len(index) - 1)]
            used, local = np.unique(place, return_inverse=True)
            size = np.diff(grams_at)[used] if len(bucket) else np.zeros(0, np.int64)
            if not len(bucket):
                continue
            g, _ = net.gradients(bucket[used], _spread(grams, grams_at, used), np.concatenate([[0], np.cumsum(size)]), local.reshape(place.shape), mask, label[own], np.ones(len(own), np.float32))
            turn += 1
            for name, x in g.items():
                x = np.clip(x, -1, 1)
                m[name] += 0.1 * (x - m[name])
                v[name] += 0.01 * (x * x - v[name])
                net.p[name] -= rate * (m[name] / (1 - 0.9**turn)) / (np.sqrt(v[name] / (1 - 0.99**turn)) + 1e-6)
    return net


def _document_runs(words_at: np.ndarray, most: int = 50_000) -> Iterator[tuple[int, int]]:
    """Runs of documents with about ``most`` words, one document at least."""
    at, n = 0, len(words_at) - 1
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(words_at, words_at[at] + most, "right")) - 1))
        yield at, to
        at = to


def _spread(grams: np.ndarray, grams_at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The n-grams of the chosen words, end to end."""
    size = np.diff(grams_at)[which]
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return grams[np.repeat(grams_at[:-1][which], size) + step]


def _logistic(x: np.ndarray, y: np.ndarray, prevalence: float) -> np.ndarray:
    """Slope and shift of a logistic map from logits to probabilities, rows weighted to the true share."""
    x = x.astype(np.float64)
    weight = np.where(y > 0, prevalence / max(y.sum(), 1), (1 - prevalence) / max((y == 0).sum(), 1))
    weight /= weight.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        q = sigmoid(a * x + b)
        g = np.array([(weight * (q - y) * x).sum() + 1e-3 * (a - 1), (weight * (q - y)).sum()])
        s = weight * q * (1 - q)
        hess = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = max(0.05, a - step[0]), b - step[1]
    return np.array([a, b])


def _held_out(doc_id):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, most: int = 900, longest: int = 20_000) -> Network:
    """Train on at most ``most`` toxic and twice as many clean labelled documents.

    They are those of least doc_id hash among texts of at most ``longest`` bytes, read
    whole; rows whose crc32(doc_id) mod 4 is 2 are never read.  A document that has
    both labels counts as toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    known = known.withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(1)))
    counts = {0: 0, 1: 0}
    for r in known.groupBy((F.col("y") > 0).alias("toxic")).count().collect():
        counts[int(r["toxic"])] += r["count"]
    share = counts[1] / max(1, counts[0] + counts[1])
    texts = C.clean(docs, "doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    # candidates are cut by label before their texts are read; a few more, for those that are too long
    limits = [(F.col("y") > 0, most), (F.col("y") <= 0, 2 * most)]
    rows: list[tuple[str, int]] = []
    for which, n in limits:
        chosen = known.where(which).orderBy("order").limit(2 * n)
        got = texts.join(F.broadcast(chosen), "doc_id").orderBy("order", "text").limit(n).select("text", "y").collect()
        rows += [(x["text"], int(x["y"] > 0)) for x in got]
    y = np.array([t for _, t in rows], np.float32)
    if not len(rows) or y.min() == y.max():
        net = Network()
        net.base = share
        return net
    # one document in five only sets the logistic map: the network has fitted the others too closely
    apart = np.arange(len(rows)) % 5 == 4
    if y[apart].max() == 0 or y[apart].min() == 1:
        apart = np.ones(len(rows), bool)
        learn = apart
    else:
        learn = ~apart
    net = train([rows[i][0] for i in np.flatnonzero(learn)], y[learn])
    check = C.text_buffer(pa.array([rows[i][0] for i in np.flatnonzero(apart)], pa.string()))
    net.scale = _logistic(net.documents(*check), y[apart], share)
    return net


@C.tidy
def _score(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in C.pieces(batch, 1 << 19):
            yield pa.RecordBatch.from_arrays([part["row"], pa.array(net.scores(raw, at), pa.float64())], names=["row", "score"])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """row (all columns of a document) and its score."""
    df = docs.select(F.struct("*").alias("row"))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = df.select("row", F.lit(0.0).alias("score")).schema
    return df.mapInArrow(lambda it: _score(it, shared.value), schema)


def drop_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    return score(docs, net).where(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``score`` over all documents."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return out.select(F.col("row.doc_id").alias("doc_id"), _held_out("row.doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


#: A trained network has no SQL form; held-out accuracy stands in.
SQL = None
