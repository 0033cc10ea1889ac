"""Operator 7: a quality classifier on random Fourier features of document statistics.

Statistics of whole texts (lengths, character classes, repetition of words and lines) are standardised and
mapped to ``FEATURES`` cosines, which approximate a Gaussian kernel. Each task sums its rows' normal
equations, the sums are added in two smaller rounds of tasks, and ridge weights are solved from the matrix that is
left. Isotonic regression on rows kept from the fit turns the ridge output into a probability.

Bounds: statistics and normal equations use all labelled rows that may be learnt from. Calibration uses at
most ``CALIBRATION`` of the rows kept aside, those of the smallest hash.

Defined cases: null and empty texts have all statistics 0 and are scored; null labels are not used; without
labels of both classes every score is the share of class 1 (0.5 without labels); rows that repeat a doc_id are
each scored; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, Words, slices, stored, table, text_bytes
from .toxicity import remainder

FEATURES, GAMMA, RIDGE, CALIBRATION = 200, 0.05, 1e-3, 20_000
LINK = 0.3
STATS = 16


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, LOWERCASE, DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
SYMBOL, STOP, COMMA, LINE = _class("#$%&*|<>{}[]\\^~=_@/"), _class(".!?"), _class(",;:"), _class("\n")
BANG = _class("!")
WIDE = np.arange(256) >= 128


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    docs = len(n)
    per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data], dtype=np.int64)])[off])
    w = Words(data, off, SPACED, lower=False)
    words = np.diff(w.first)
    doc = np.repeat(np.arange(docs), words)
    order = np.lexsort((w.hash, doc))
    h, d = w.hash[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=docs)
    lead = np.flatnonzero(new)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, d[lead], np.diff(np.append(lead, len(h))))
    again = np.zeros(len(h), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    sizes = (w.end - w.start).astype(float)
    # Lines: their words' hashes added up name them.
    breaks = np.concatenate([[0], np.cumsum(LINE[data], dtype=np.int64)])
    line = breaks[w.start] if len(h) else np.zeros(0, np.int64)
    head = np.ones(len(h), bool)
    head[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    name = np.add.reduceat(w.hash, at) if len(at) else np.zeros(0, np.uint64)
    o = np.lexsort((name, doc[at]))
    name, ld = name[o], doc[at][o]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (ld[1:] != ld[:-1])
    lines, unique = np.bincount(ld, minlength=docs), np.bincount(ld[fresh], minlength=docs)
    up, low, sym, stop = per(UPPER), per(LOWERCASE), per(SYMBOL), per(STOP)
    over = lambda a, b: a / np.maximum(b, 1)
    return np.stack([
        np.log1p(n), np.log1p(words), over(np.bincount(doc, weights=sizes, minlength=docs), words), over(up, up + low), over(per(DIGIT), n), over(sym, n), over(sym, words),
        over(stop, words), over(per(COMMA), words), over(per(BANG), words), over(distinct, words), over(top, words), over(np.bincount(doc[again], minlength=docs), words),
        over(unique, lines), np.log1p(over(words, lines)), over(per(WIDE), n),
    ], axis=1).astype(float)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        for part in slices(batches):
            x = statistics(*text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), STATS).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Standardisation, Fourier features, ridge weights and the calibration's steps."""

    def __init__(self, mean, scale, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = rng.normal(size=(STATS, FEATURES)) * np.sqrt(2 * GAMMA)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta, self.steps = np.zeros(FEATURES + 1), (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw output keeps the order within a step."""
        raw = self.raw(x)
        return np.clip(0.999 * np.interp(raw, *self.steps) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; (mean score, mean label) of the pools."""
    pools: list[list[float]] = []
    order = np.argsort(score, kind="stable")
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([s, v, 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    s, v, n = np.array(pools).T
    # One pseudo-label of each class keeps end pools off 0 and 1.
    return s / n, (v + 0.5) / (n + 1)


def stacked(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def train(x: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """``x``: what ``measured`` returns; ``learn``: which doc_ids may be learnt from."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where(learn & F.col("y").isin(0.0, 1.0)).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stored(x.join(given, "doc_id"), "quality-rows")
    k = [F.get("x", F.lit(i)) for i in range(STATS)]
    at = rows.agg(*[F.avg(c) for c in k], *[F.stddev_pop(c) for c in k], F.avg("y"), F.count("*"), F.count_distinct("y")).first()
    if at[2 * STATS + 2] < 2:
        model = Model(np.zeros(STATS), np.ones(STATS))
        if at[2 * STATS + 1]:
            model.steps = (np.array([0.0]), np.array([at[2 * STATS]]))
        return model
    model = Model(at[:STATS], np.maximum(np.array(at[STATS : 2 * STATS]), 1e-3))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(4))

    def sums(batches):
        a, n = np.zeros((FEATURES + 2, FEATURES + 2)), 0
        for batch in batches:
            if batch.num_rows:
                z = np.hstack([model.features(stacked(batch, 0)), batch.column(1).to_numpy()[:, None]])
                a += z.T @ z
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["a", "n"])

    def added(batches):
        a, n = np.zeros((FEATURES + 2) ** 2), 0
        for batch in batches:
            for v, m in zip(batch.column(0), batch.column(1), strict=True):
                a += np.frombuffer(v.as_buffer(), float)
                n += m.as_py()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["a", "n"])

    parts = rows.where(fold != 0).select("x", "y").mapInArrow(sums, "a binary, n long")
    for left in (64, 4):  # sums of sums: no task adds more than a 64th of the matrices of all tasks
        parts = parts.repartition(left).mapInArrow(added, "a binary, n long").where("n > 0")
    parts = parts.collect()  # 4 matrices
    a = sum((np.frombuffer(p["a"], float).reshape(FEATURES + 2, -1) for p in parts), np.zeros((FEATURES + 2, FEATURES + 2)))
    n = sum(p["n"] for p in parts)
    lhs = a[:-1, :-1] + RIDGE * n * np.eye(FEATURES + 1)
    lhs[0, 0] -= RIDGE * n
    model.beta = np.linalg.solve(lhs + 1e-9 * np.eye(FEATURES + 1), a[:-1, -1])
    kept = rows.where(fold == 0).orderBy(F.xxhash64("doc_id", F.lit(1))).limit(CALIBRATION).select("x", "y").toArrow()
    if kept.num_rows >= 20:
        y = kept["y"].to_numpy()
        model.steps = isotonic(model.raw(np.array(kept["x"].to_pylist())), y)
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def scored(x: DataFrame, model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            s = model.score(stacked(batch, 1)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    return x.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stored(measured(table(spark, sf_dir, "documents")), "quality-statistics")
    model = train(x, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return scored(x, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= LINK).cast("int").alias("predicted"))
