"""Operator 3: a two-state linear-chain conditional random field that tags toxic spans.

Only whole documents carry labels, so token labels are derived from them first: a token of a toxic
document is labelled toxic where its word or one of its prefixes is far more frequent (by documents) in
toxic than in clean documents of the sample. The chain is trained on sentences so labelled; its
forward-backward marginals give the offending offsets, and their maximum, sum and density the document
score through a logistic layer.

Bounds: the model is fitted in one task, on at most ``PER_CLASS`` labelled documents of each class, those of
the smallest hash of doc_id, the longest of them left out where a class would have over ``FIT_BYTES`` of text.
Of their sentences without a toxic token the chain takes ``CLEAN``, or three times the toxic ones if that is
more, in a seeded order. Scoring reads every whole text.

Defined cases: a null or empty text, and one without words, gets the score of no evidence and no spans;
rows that repeat a doc_id are each scored; null labels are not used; without both classes among the
labels every score is 0; extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LETTERS, SLICE_BYTES, U64, Words, mapped, slices, stored, table, text_bytes

PER_CLASS = 1500
FIT_BYTES = 6 << 20
CLEAN = 20_000
SLICE = SLICE_BYTES // 3  # bytes of text whose tokens a worker makes at once
BITS = 18
PREFIXES = (3, 4, 5, 6, 8)
BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".!?\n"]] = True
MASK = U64((1 << BITS) - 1)
SHAPES = 8
LINK = 0.7


class Chains:
    """Tokens of texts, cut into sentences, with the hashed feature numbers of each token."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = Words(data, off, LETTERS, lower=True)
        self.w, n = w, len(w.start)
        doc_start = np.zeros(n + 1, bool)
        doc_start[w.first] = True
        stops = np.concatenate([[0], np.cumsum(BREAK[data])])
        at = stops[w.start] if n else np.zeros(0, np.int64)
        head = doc_start[:n].copy()
        if n:
            head[0] = True
            head[1:] |= at[1:] != at[:-1]
        upper = (data[w.start] >= 65) & (data[w.start] <= 90)
        self.head = head
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(w.first))
        shape = head.astype(np.int64) + 2 * upper
        size = 1 << BITS
        cols = [(w.hash & MASK).astype(np.int32)]
        length = w.end - w.start
        for k in PREFIXES:
            f = (w.hashed(k, seed=k) & MASK).astype(np.int32)
            f[length < k] = size + SHAPES  # no such prefix: a feature whose weight stays 0
            cols.append(f)
        cols.append((size + shape).astype(np.int32))
        self.features = np.stack(cols, axis=1) if n else np.zeros((0, len(cols)), np.int32)

    @classmethod
    def sliced(cls, text: pa.Array) -> Chains:
        """Head, doc and features as of one ``Chains`` over all texts, made slice by slice; without ``w``."""
        parts, docs = [(np.zeros(0, bool), np.zeros(0, np.int64), np.zeros((0, 2 + len(PREFIXES)), np.int32))], 0
        for part in slices([pa.RecordBatch.from_arrays([text], names=["text"])], limit=SLICE):
            c = cls(*text_bytes(part.column(0)))
            parts.append((c.head, c.doc + docs, c.features))
            docs += part.num_rows
        out = cls.__new__(cls)
        out.head, out.doc, out.features = (np.concatenate(x) for x in zip(*parts, strict=True))
        return out


WIDTH = (1 << BITS) + SHAPES + 1


def plan(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sentence starts and lengths, the longest first."""
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(head)))
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


def forward_backward(e: np.ndarray, head: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward ratios r, backward ratios b and x = exp(e) for all tokens; the marginal odds of state 1 are r * b.
    ``a``: the 2 x 2 transition potentials. All sentences advance together, position by position."""
    x = np.exp(np.clip(e, -30, 30))
    r, b = x.copy(), np.ones_like(x)
    if not len(x):
        return r, b, x
    start, length = plan(head)
    live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # sentences with over t tokens
    (a00, a01), (a10, a11) = a
    for t in range(1, length[0]):
        i = start[: live[t]] + t
        p = r[i - 1]
        r[i] = x[i] * (a01 + p * a11) / (a00 + p * a10)
    for t in range(length[0] - 2, -1, -1):
        i = start[: live[t + 1]] + t
        y = x[i + 1] * b[i + 1]
        b[i] = (a10 + a11 * y) / (a00 + a01 * y)
    return r, b, x


class Model:
    def __init__(self, weights: np.ndarray, transitions: np.ndarray, link: np.ndarray | None):
        self.weights, self.transitions, self.link = weights.astype(np.float32), transitions, link

    def marginals(self, c: Chains) -> np.ndarray:
        e = self.weights[c.features].sum(axis=1, dtype=np.float64) if len(c.features) else np.zeros(0)
        r, b, _ = forward_backward(e, c.head, self.transitions)
        odds = r * b
        return odds / (1 + odds)

    def evidence(self, c: Chains, p: np.ndarray, docs: int) -> np.ndarray:
        top, total = np.zeros(docs), np.bincount(c.doc, weights=p, minlength=docs)
        np.maximum.at(top, c.doc, p)
        n = np.bincount(c.doc, minlength=docs)
        return np.stack([np.ones(docs), top, np.log1p(total), total / (n + 1.0) * 10, np.log1p(n) / 10], axis=1)

    def scores(self, c: Chains, p: np.ndarray, docs: int) -> np.ndarray:
        if self.link is None:
            return np.zeros(docs)
        return 1 / (1 + np.exp(-np.clip(self.evidence(c, p, docs) @ self.link, -35, 35)))


def token_labels(c: Chains, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens from labels of documents, by the enrichment of words and prefixes."""
    best = np.full(len(c.doc), -9.0)
    clean_n, toxic_n = (toxic == 0).sum(), (toxic == 1).sum()
    for k in range(1 + len(PREFIXES)):
        f = c.features[:, k]
        pair = np.unique(c.doc.astype(np.int64) * WIDTH + f)
        d, g = pair // WIDTH, pair % WIDTH
        hot = np.bincount(g[toxic[d] == 1], minlength=WIDTH)
        cold = np.bincount(g[toxic[d] == 0], minlength=WIDTH)
        s = np.log((hot + 0.5) / (toxic_n + 1)) - np.log((cold + 0.5) / (clean_n + 1))
        s[hot < 4] = -9
        s[-SHAPES - 1 :] = -9
        best = np.maximum(best, s[f])
    y = (best >= 2.5) & (toxic[c.doc] == 1)
    found = np.zeros(len(toxic), bool)
    found[c.doc[y]] = True
    top = np.full(len(toxic), 1.0)
    np.maximum.at(top, c.doc, best)
    return y | ((toxic[c.doc] == 1) & ~found[c.doc] & (best >= top[c.doc]))


def fit_chain(c: Chains, y: np.ndarray, clean: int, epochs: int = 8, batch: int = 3000, l2: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Conditional likelihood by Adam over batches of sentences; the gradient is observed less expected counts.
    All sentences with a toxic token are used, and ``clean`` others or three times as many, if that is more."""
    sentence = np.cumsum(c.head) - 1
    count = sentence[-1] + 1 if len(sentence) else 0
    hot = np.zeros(count, bool)
    hot[sentence[y]] = True
    rng = np.random.default_rng(3)
    cold = np.flatnonzero(~hot)
    use = np.concatenate([np.flatnonzero(hot), rng.permutation(cold)[: max(clean, 3 * hot.sum())]])
    del sentence
    start = np.flatnonzero(c.head)
    length = np.diff(np.append(start, len(c.head)))
    w, t = np.zeros(WIDTH), np.zeros(4)
    w[(1 << BITS) :] = -1.0
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    step = 0
    for _ in range(epochs):
        use = rng.permutation(use)
        for a in range(0, len(use), batch):
            s = use[a : a + batch]
            n = length[s]
            idx = np.repeat(start[s] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            f, yy = c.features[idx], y[idx].astype(float)
            head = np.zeros(len(idx), bool)
            head[np.concatenate([[0], np.cumsum(n)[:-1]])] = True
            pot = np.exp(t.reshape(2, 2))
            r, b, x = forward_backward(w[f].sum(axis=1), head, pot)
            p = r * b / (1 + r * b)
            g = np.zeros(WIDTH + 4)
            g[:WIDTH] = np.bincount(f.ravel(), weights=np.repeat(yy - p, f.shape[1]), minlength=WIDTH) / len(s)
            j = np.flatnonzero(~head)
            q = np.stack([pot[0, 0] * np.ones(len(j)), pot[0, 1] * x[j] * b[j], r[j - 1] * pot[1, 0], r[j - 1] * pot[1, 1] * x[j] * b[j]], axis=1)
            q /= q.sum(axis=1, keepdims=True)
            seen = np.bincount((2 * yy[j - 1] + yy[j]).astype(int), minlength=4)
            g[WIDTH:] = (seen - q.sum(axis=0)) / len(s)
            g[:WIDTH] -= l2 * w
            g[WIDTH - 1] = 0
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            w += d[:WIDTH]
            t += d[WIDTH:]
    w[WIDTH - 1] = 0
    return w, np.exp(t.reshape(2, 2))


def fit_link(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - l2 * w)
    return w


def fitted(rows: pa.Table, counts: dict[int, int], clean: int) -> Model:
    """The model of sample rows (text, toxic), those of class 0 first; ``counts``: the labels of each class."""
    toxic = rows["toxic"].to_numpy().astype(np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(WIDTH), np.ones((2, 2)), None)
    # A quarter is kept from the chain, so that the link sees marginals as they are on unseen texts.
    aside = np.arange(len(toxic)) % 4 == 3
    text = rows["text"].combine_chunks()
    c, y = Chains.sliced(text.filter(pa.array(~aside))), toxic[~aside]
    model = Model(*fit_chain(c, token_labels(c, y), clean), None)
    del c
    if len(set(toxic[aside])) < 2:  # too few rows to keep any aside
        aside = np.ones(len(toxic), bool)
    y = toxic[aside]
    parts = []
    for batch in pa.Table.from_arrays([text.filter(pa.array(aside))], names=["text"]).to_batches(max_chunksize=200):
        part = Chains(*text_bytes(batch.column(0)))
        parts.append(model.evidence(part, model.marginals(part), batch.num_rows))
    prior = np.array([counts[0], counts[1]]) / (counts[0] + counts[1]) / (np.bincount(y, minlength=2) / len(y))
    model.link = fit_link(np.concatenate(parts), y, prior[y])
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column, per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES, clean: int = CLEAN) -> Model:
    """Fit on a bounded sample of labelled rows; ``learn``: which doc_ids may be learnt from. The sample goes to
    one task, which returns the weights (2 MB): the driver never holds a text."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in given.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model(np.zeros(WIDTH), np.ones((2, 2)), None)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # The ids of a sample number 4 * per_class at most (some may have no text), so they can be broadcast.
    ids = [given.where(F.col("toxic") == k).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class) for k in (0, 1)]
    found = stored(texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id"), "toxic-sample")
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    # Sizes decide first, so that no more than fit_bytes of text are sorted or sent.
    first = found.select("toxic", "doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("size"), F.row_number().over(Window.partitionBy("toxic").orderBy(*order)).alias("place")).where(F.col("place") <= per_class)
    total = F.sum("size").over(Window.partitionBy("toxic").orderBy("size", "place").rowsBetween(Window.unboundedPreceding, 0))
    picked = first.withColumn("total", total).where(F.col("total") <= fit_bytes).groupBy("toxic", "doc_id", "h").agg(F.min("place").alias("place"))  # 2 * per_class rows at most
    one = found.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["toxic", "doc_id", "h"]).dropDuplicates(["toxic", "doc_id", "h"])
    sample = one.select("toxic", "place", "text").repartition(1).sortWithinPartitions("toxic", "place")

    def run(batches):
        got = list(batches)
        rows = pa.Table.from_batches(got) if got else pa.table({"toxic": pa.array([], pa.int32()), "place": pa.array([], pa.int32()), "text": pa.array([], pa.string())})
        m = fitted(rows, counts, clean)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (m.weights.tobytes(), m.transitions.tobytes(), None if m.link is None else m.link.tobytes())], names=["weights", "transitions", "link"])

    got = stored(sample.mapInArrow(run, "weights binary, transitions binary, link binary"), "toxic-model").first()
    if got is None:
        return Model(np.zeros(WIDTH), np.ones((2, 2)), None)
    return Model(np.frombuffer(got["weights"], np.float32), np.frombuffer(got["transitions"]).reshape(2, 2), None if got["link"] is None else np.frombuffer(got["link"]))


def spans_of(c: Chains, p: np.ndarray, docs: int, data: np.ndarray, off: np.ndarray, cut: float) -> pa.Array:
    """Runs of tokens whose marginal is at least ``cut``, as code point offsets with the mean marginal."""
    hit = p >= cut
    if not hit.any():
        return pa.ListArray.from_arrays(pa.array(np.zeros(docs + 1, np.int32)), _structs([], [], []))
    i = np.flatnonzero(hit)
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(i) > 1) | c.head[i[1:]]
    g = np.cumsum(new) - 1
    first, last = i[new], i[np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = points[off[:-1]][c.doc[first]]
    count = np.bincount(c.doc[first], minlength=docs)
    values = _structs(points[c.w.start[first]] - base, points[c.w.end[last]] - base, np.bincount(g, weights=p[i]) / np.bincount(g))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)


def _structs(a, b, s) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.asarray(a, np.int32)), pa.array(np.asarray(b, np.int32)), pa.array(np.asarray(s, np.float64))], names=["start", "end", "score"])


def tag(docs: DataFrame, model: Model, cut: float = 0.5, text: str = "text") -> DataFrame:
    """The documents with ``toxic_score`` and ``toxic_spans`` (start, end in code points, score)."""

    def run(part: pa.RecordBatch):
        data, off = text_bytes(part.column(0))
        c, n = Chains(data, off), part.num_rows
        p = model.marginals(c)
        return [pa.array(model.scores(c, p, n)), spans_of(c, p, n, data, off, cut)]

    return mapped(docs, run, "toxic_score double, toxic_spans array<struct<start: int, end: int, score: double>>", text)


def remainder(n: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    out = tag(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= LINK).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score is below 0.7. Labels are matched to the documents given."""
    model = train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # a struct, as docs may have any columns
    return tag(rows, model, text="row.text").where(F.col("toxic_score") < LINK).select("row.*")
