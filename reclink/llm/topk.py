"""Operator 9: exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors are quantised to integers; a dimension is a term and a vector's non-zero components are its weighted
postings. Candidates are cut into blocks with one posting list a dimension. For each query block and
candidate block, every query's non-zero terms scatter weight * posting into a dense row of scores; partition
selection keeps each row's k best, and a window merges the blocks' winners (k rows a query and block, cut
again before the shuffle).

Query and candidate blocks are bounded (``QUERIES``, ``BLOCK`` vectors). All query blocks meet all candidate
blocks, which is the stated query set against all rows, in the cells of a grid: candidate blocks are dealt to the
grid's rows, query blocks to its columns, and a cell gets some ``side`` of each. Every candidate block is sent once
for each column and every query block once for each row; the side grows with the root of the number of meetings
(from 1 to ``SIDE``), so there are many even cells for many machines and the copies stay few.

Defined cases: a vector that is null or holds null or non-finite components takes no part; vectors of other
lengths meet in the dimensions they share; empty vectors score 0; ties go to the smaller vec_id; a query is
not its own candidate; rows that repeat a vec_id are candidates each, apart from the query's own id; a null
vec_id takes no part; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import int64, stored, table

SCALE = 256
BLOCK, QUERIES = 2048, 2048
CELLS, SIDE = 10_000, 32


def quantised(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(scale).cast("double") * x))
    bad = F.exists(F.col(vector).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    return good.select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<long>").alias("q"))


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of at most ``size`` vectors: ids and, by (dimension, vector), the non-zero components as binaries."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                q = part.column(1)
                row = np.repeat(np.arange(len(q)), np.diff(q.offsets.to_numpy()))
                value = q.flatten().to_numpy(zero_copy_only=False)
                begin = q.offsets.to_numpy()[:-1] - q.offsets.to_numpy()[0]
                term = np.arange(len(value)) - begin[row]
                order = np.lexsort((row, term))
                order = order[value[order] != 0]
                parts = [part.column(0).to_numpy(), term[order].astype(np.int32), row[order].astype(np.int32), value[order].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["ids", "terms", "rows", "weights"])

    return vectors.mapInArrow(run, "ids binary, terms binary, rows binary, weights binary")


def score_block(queries: list, candidates: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query id, candidate id, score) of each query of one block against one block."""
    qid, qterm, qrow, qw = [np.frombuffer(x, t) for x, t in zip(queries, (np.int64, np.int32, np.int32, np.int64), strict=True)]
    cid, cterm, crow, cw = [np.frombuffer(x, t) for x, t in zip(candidates, (np.int64, np.int32, np.int32, np.int64), strict=True)]
    scores = np.zeros((len(qid), len(cid)), np.int64)
    terms = np.unique(qterm)
    for t in terms:
        a, b = np.searchsorted(cterm, [t, t + 1])
        c, d = np.searchsorted(qterm, [t, t + 1])
        if a == b:
            continue
        if b - a == len(cid):  # a posting of every row: no gather is needed
            scores[qrow[c:d]] += qw[c:d, None] * cw[None, a:b]
        else:
            scores[qrow[c:d, None], crow[None, a:b]] += qw[c:d, None] * cw[None, a:b]
    own = qid[:, None] == cid[None, :]
    scores[own] = np.iinfo(np.int64).min
    order = np.argsort(cid, kind="stable")  # columns by id: equal scores then stand by id
    scores, cid, own = scores[:, order], cid[order], own[:, order]
    n = min(k, len(cid))
    kth = np.partition(scores, len(cid) - n, axis=1)[:, len(cid) - n] if n else np.zeros(len(qid), np.int64)
    r, c = np.nonzero((scores >= kth[:, None]) & ~own)
    best = np.lexsort((cid[c], -scores[r, c], r))
    r, c = r[best], c[best]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    r, c = r[keep], c[keep]
    return qid[r], cid[c], scores[r, c]


def top_k(queries: DataFrame, candidates: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score."""
    asked = quantised(queries, vec_id, vector, scale)
    q = blocks(asked.repartition(max(1, -(-asked.count() // QUERIES))), QUERIES)  # full blocks: each costs a copy of the candidates
    c = blocks(quantised(candidates, vec_id, vector, scale), BLOCK)
    q, c = stored(q, "query-blocks"), stored(c, "candidate-blocks")
    m, n = c.count(), q.count()
    side = min(SIDE, max(1, int((m * n / CELLS) ** 0.5)))
    rows, columns = max(1, -(-m // side)), max(1, -(-n // side))
    cell = lambda own, k: F.pmod(F.xxhash64("ids"), F.lit(k)).cast("int").alias(own)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = c.select("*", cell("g", rows), every(columns).alias("h"))
    right = q.select(*[F.col(x).alias(f"q_{x}") for x in q.columns], cell("h", columns), every(rows).alias("g"))
    both = left.join(right.hint("merge"), ["g", "h"]).drop("g", "h")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = [batch.column(j)[i].as_buffer() for j in range(8)]
                a, b, s = score_block(x[4:], x[:4], k)
                yield pa.RecordBatch.from_arrays([int64(a), int64(b), int64(s)], names=["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
