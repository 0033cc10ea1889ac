"""Operator 8: removal of repeated word windows by recompression.

Recompression names runs of equal tokens, then pairs of neighbours whose coins read left-right, and repeats
this on the names. A name is a hash of what it stands for, so names are global without a dictionary, and a
name's place depends only on a known stretch of words around it. In equal substrings the names inside are
therefore equal. Each window takes as its anchor the highest, then longest name whose whole stretch lies in
the window; equal windows have equal anchors at equal offsets. (A word is a name of level 0, so every window
has one.) Windows that share an anchor form one stretch of about ten windows, and only stretches are shuffled:

1. Stretches with equal text are grouped; all but the first are repeated as a whole.
2. First stretches whose anchor name also occurs with another text are looked at window by window: windows
   are compared by 128-bit digests of their words, and all but the first of equal ones are repeated.
3. Repeated stretches and windows are united for each document, and the words they cover are removed.

Equal stretches within a slice are combined before the shuffle, so a stretch in a third of all documents
arrives with one row a slice. The names and windows that are frequent even so (in a sixteenth of the documents;
HEAVY bounds their number) are judged by sums that combine before the shuffle, and their rows are dealt out by
salts; how they are judged changes no result. All others are shuffled once. A step is stored, and the driver then
lets go of the shuffle files of those before it. Documents that need no second look are never shuffled; a bitmap
of fixed size keeps most of them back, and the joins are exact.

Names stand in for the dictionaries of Spark rounds: one round that names all pairs of a corpus by a shuffled
dictionary and joins the names back costs more than this operator's whole budget (README).

Defined cases: null texts and texts without words have no words; documents of fewer than 20 words lose
nothing, and neither do rows without a doc_id, which others are not compared with. Each row is a document: rows
that repeat a doc_id are judged each by its own text (rows are told apart by a 64-bit hash of doc_id and text),
and are not earlier than one another; other columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED, U64, Words, bloom_bitmap, bloom_column, bloom_test, hot_keys, int64, mix, salted_join, settled, slices, table, text_bytes

WINDOW, LEVELS = 20, 3
FAR = 1 << 40
SPAN = 64  # a stretch is shorter than two windows: its place and length fit one number
_A, _B, _C = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def named_runs(sym, start, end, left, right, doc):
    """Runs of equal names become one name. Each name's stretch grows by a neighbour on either side."""
    n = len(sym)
    head = np.ones(n, bool)
    head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    size = np.diff(np.append(at, n))
    last = at + size - 1
    name = np.where(size > 1, mix(sym[at] + size.astype(U64) * _C), sym[at])
    d = doc[at]
    lo = np.where(np.append(False, d[1:] == d[:-1]), left[np.maximum(at - 1, 0)], -FAR)
    hi = np.where(np.append(d[1:] == d[:-1], False), right[np.minimum(last + 1, n - 1)], FAR)
    return name, start[at], end[last], lo, hi, d


def named_pairs(sym, start, end, left, right, doc, level: int):
    """Neighbours whose coins read 0, 1 become one name; a name that stays depends on the neighbour it looked at."""
    n = len(sym)
    coin = (mix(sym + U64(level) * _A) >> U64(17)) & U64(1) == 1
    joins = np.zeros(n, bool)
    joins[:-1] = ~coin[:-1] & coin[1:] & (doc[1:] == doc[:-1])
    second = np.append(False, joins[:-1])
    prev, nxt = np.maximum(np.arange(n) - 1, 0), np.minimum(np.arange(n) + 1, n - 1)
    has_prev, has_next = np.append(False, doc[1:] == doc[:-1]), np.append(doc[1:] == doc[:-1], False)
    other = np.where(coin, prev, nxt)
    known = np.where(coin, has_prev, has_next)
    lo = np.where(known, np.minimum(left, left[other]), np.where(coin, -FAR, left))
    hi = np.where(known, np.maximum(right, right[other]), np.where(coin, right, FAR))
    keep = ~second
    name = np.where(joins, mix(sym * _A + sym[nxt] * _B + U64(level)), sym)
    return name[keep], start[keep], np.where(joins, end[nxt], end)[keep], lo[keep], hi[keep], doc[keep]


def least(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where ``rank`` is smallest in each range [a, b), the first of equal ones: a sparse table of powers of two."""
    best, place, size = np.arange(len(rank)), a.copy(), b - a
    k = 1
    while True:
        now = (size >= k) & (size < 2 * k)
        x, y = best[a[now]], best[b[now] - k]
        place[now] = np.where(rank[x] <= rank[y], x, y)
        if not (size >= 2 * k).any():
            return place
        x, y = best[:-k], best[k:]
        best = np.where(rank[x] <= rank[y], x, y)
        k *= 2


def anchors(h: np.ndarray, doc: np.ndarray, first: np.ndarray, window: int = WINDOW, levels: int = LEVELS):
    """For each window start: (level, name, phrase start) of its anchor; valid marks the window starts."""
    n = len(h)
    i = np.arange(n)
    valid = i + window <= first[1:][doc]
    layers = [(h, i, i + 1, i, i + 1, doc)]
    layers.append(named_runs(*layers[0]))
    for k in range(1, levels + 1):
        layers.append(named_pairs(*layers[-1], k))
    open_ = valid.copy()
    name, phrase, level = np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(len(layers) - 1, -1, -1):
        if not open_.any():
            break
        sym, start, end, left, right, _ = layers[k]
        fits = (right - left <= window) & (left >= 0)
        j = np.flatnonzero(fits)
        # Both ends of the names' stretches rise, so the names that fit into a window are neighbours in ``j``.
        low = np.concatenate([[0], np.cumsum(np.bincount(left[j], minlength=n))])
        high = np.cumsum(np.bincount(right[j], minlength=n + 1))
        s = np.flatnonzero(open_)
        a, b = low[s], high[s + window]
        s, a, b = s[b > a], a[b > a], b[b > a]
        if not len(s):
            continue
        # The longest name first, then the smallest hash: one number, the smaller the better.
        rank = ((U64(255) - np.minimum(end[j] - start[j], 255).astype(U64)) << U64(56)) | (mix(sym[j]) >> U64(8))
        w = j[least(rank, a, b)]
        name[s], phrase[s], level[s] = mix(sym[w] + U64(k) * _B), start[w], k
        open_[s] = False
    return valid, level, name, phrase


class Digests:
    """128-bit digests of word ranges, from prefix sums of h[i] * base**i."""

    def __init__(self, h: np.ndarray):
        n, self.sums, self.back = len(h), [], []
        for base in BASES:
            up = np.full(n + 1, U64(base))
            up[0] = 1
            down = np.full(n + 1, U64(pow(base, -1, 1 << 64)))
            down[0] = 1
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(h * np.cumprod(up)[:n], dtype=U64)]))
            self.back.append(np.cumprod(down))

    def of(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        return [mix((s[b] - s[a]) * r[a] + (b - a).astype(U64) * _C) for s, r in zip(self.sums, self.back, strict=True)]


def firsts(u1: np.ndarray, u2: np.ndarray, doc: np.ndarray, name: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows repeat none before them: those with equal digests have no smaller doc, nor an earlier place in
    the same row of the table (``name``)."""
    order = np.lexsort((at, name, doc, u2, u1))
    a, b, d, n = u1[order], u2[order], doc[order], name[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    lead = np.flatnonzero(head)
    of = lead[np.cumsum(head) - 1] if len(lead) else lead
    own = head.copy()
    own[1:] |= n[1:] != n[:-1]
    out = np.zeros(len(order), bool)
    out[order[own & (d == d[of])]] = True
    return out


def _stretches(part: pa.RecordBatch) -> pa.RecordBatch:
    w = Words(*text_bytes(part.column(1)), SPACED, lower=False)
    docs = part.num_rows
    doc = np.repeat(np.arange(docs), np.diff(w.first))
    ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = np.asarray(part.column(0).is_null().to_numpy(zero_copy_only=False))
    names = part.column(2).to_numpy().astype(np.int64)
    cols = [np.zeros(0, U64)] * 2 + [np.zeros(0, np.int64)] * 4
    again = np.zeros(0, bool)
    if len(w.hash):
        valid, level, name, phrase = anchors(w.hash, doc, w.first)
        valid &= ~null[doc]
        s = np.flatnonzero(valid)
        if len(s):
            mark = phrase[s] * 16 + level[s]
            head = np.ones(len(s), bool)
            head[1:] = (mark[1:] != mark[:-1]) | (np.diff(s) > 1) | (doc[s[1:]] != doc[s[:-1]])
            a = s[head]
            b = s[np.append(np.flatnonzero(head)[1:] - 1, len(s) - 1)] + WINDOW
            digest = Digests(w.hash).of(a, b)
            # Two digests of the stretch, the anchor's name and place mixed into them, name it in 128 bits.
            key, u = name[a], mix(digest[0] + mix(digest[1] + (phrase[a] - a).astype(U64) * _A + level[a].astype(U64)))
            at, did, own = a - w.first[doc[a]], ids[doc[a]], names[doc[a]]
            again = ~firsts(key, u, did, own, at)
            cols = [key, u, did, at * SPAN + (b - a), np.where(again, 2, 1), own]
    raw, off = text_bytes(part.column(1))
    raw = raw.tobytes()
    shas = [hashlib.sha256(b" ".join(raw[off[i] : off[i + 1]].split())).hexdigest() for i in range(docs)]
    n = len(cols[0])
    none = pa.nulls(docs, pa.int64())
    # What repeats within the slice is settled here and needs no name any more.
    named = lambda x: pa.concat_arrays([none, pa.array(x.view(np.int64), mask=again)])
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array(np.zeros(docs, np.int64)), int64(cols[4])]), named(cols[0]), named(cols[1]), pa.concat_arrays([part.column(0), int64(cols[2])]),
        pa.concat_arrays([part.column(2), int64(cols[5])]), pa.concat_arrays([int64(np.diff(w.first)), int64(cols[3])]), pa.array(shas + [None] * n, pa.string()),
    ], names=["kind", "key", "u", "doc_id", "name", "span", "sha"])


def _windows(part: pa.RecordBatch) -> pa.RecordBatch:
    """Windows of the given stretches (column 3: list of (at, size)) of each text."""
    w = Words(*text_bytes(part.column(1)), SPACED, lower=False)
    spans = part.column(3)
    n = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten()
    at, size = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    row = np.repeat(np.arange(part.num_rows), n)
    count = size - WINDOW + 1
    base = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else count
    a = np.repeat(w.first[row] + at - base, count) + np.arange(count.sum())
    row = np.repeat(row, count)
    u1, u2 = Digests(w.hash).of(a, a + WINDOW)
    did, name = part.column(0).to_numpy()[row], part.column(2).to_numpy()[row]
    at = a - w.first[row]
    top = firsts(u1, u2, did, name, at)
    return pa.RecordBatch.from_arrays([int64(np.where(top, 1, 2)), int64(u1), int64(u2), int64(did), int64(name), int64(at)], names=["kind", "u1", "u2", "doc_id", "name", "at"])


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and the name of the row."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.withColumn("name", F.xxhash64("doc_id", "text"))


def _needed(docs: DataFrame, given: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts joined with ``given`` (name, spans), the others dropped early by a bitmap of fixed size."""
    bitmap = bloom_bitmap(given, "name")

    def run(batches):
        for batch in batches:
            yield batch.select(["doc_id", "text", "name"]).filter(pa.array(bloom_test(bitmap, batch.column(3).to_numpy(zero_copy_only=False))))

    rows = named(docs, doc_id, text).where("doc_id is not null and text is not null").withColumn("bit", bloom_column("name"))
    few = rows.mapInArrow(run, "doc_id long, text string, name long")
    return few.join(given, "name").select("doc_id", "text", "name", "spans")


def _parted(rows: DataFrame, key: list[str], total: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the keys that are not frequent, and of those that are, by the rows of a sixteenth of the documents."""
    share = 16
    some = rows.where(F.pmod(F.xxhash64("name"), F.lit(share)) == 0).groupBy(*key).agg(F.count("*").alias("c"))
    marked = rows.join(F.broadcast(settled(hot_keys(some, max(1, total // share)), name)), key, "left")
    return marked.where("salts is null").drop("salts"), marked.where("salts is not null").drop("salts")


def judged_stretches(rows: DataFrame, documents: int) -> DataFrame:
    """(doc_id, name, span, later) of the stretches (key, u, doc_id, name, span) that come later than an equal
    one, and of the first ones whose anchor name ``key`` occurs with more than one text ``u``."""
    few, many = _parted(rows, ["key"], documents, "stretch-frequent")
    by_text, by_name = Window.partitionBy("key", "u"), Window.partitionBy("key")
    few = few.repartition("key")
    few = few.withColumn("d", F.min("doc_id").over(by_text)).withColumn("texts", F.min("u").over(by_name) != F.max("u").over(by_name))
    texts = many.groupBy("key", "u").agg(F.min("doc_id").alias("d"), F.count("*").alias("c"))
    names = texts.groupBy("key").agg((F.min("u") != F.max("u")).alias("texts"))  # 2 * HEAVY rows at most
    many = salted_join(many, texts.join(F.broadcast(names), "key"), ["key", "u"], max(1, documents), ["name", "span"])
    return few.unionByName(many.select(few.columns)).where("doc_id > d or texts").select("doc_id", "name", "span", (F.col("doc_id") > F.col("d")).alias("later"))


def judged_windows(rows: DataFrame) -> DataFrame:
    """(name, at) of the windows (u1, u2, doc_id, name, at) that come later than an equal one. A slice sends equal
    windows once but for rows of one doc_id, so frequent ones are rare."""
    total = max(1, rows.count())
    few, many = _parted(rows, ["u1", "u2"], total, "window-frequent")
    few = few.withColumn("d", F.min("doc_id").over(Window.partitionBy("u1", "u2")))
    sums = many.groupBy("u1", "u2").agg(F.min("doc_id").alias("d"), F.count("*").alias("c"))
    many = salted_join(many, sums, ["u1", "u2"], total, ["name", "at"])
    return few.unionByName(many.select(few.columns)).where("doc_id > d").select("name", "at")


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row a document: doc_id, name, n_words, sha of all words; repeated word ranges: name, at, size)."""
    at, size = F.floor(F.col("span") / SPAN).alias("at"), (F.col("span") % SPAN).alias("size")
    parts = settled(named(docs, doc_id, text).mapInArrow(lambda batches: (_stretches(p) for p in slices(batches)), "kind long, key long, u long, doc_id long, name long, span long, sha string"), "stretches")
    every = parts.where("kind = 0").select("doc_id", "name", F.col("span").alias("n_words"), "sha")
    judged = settled(judged_stretches(parts.where("kind = 1").select("key", "u", "doc_id", "name", "span"), every.count()), "stretch-judged")
    later = judged.where("later").select("name", at, size)
    unsure = judged.where("not later").select("name", F.struct(at, size).alias("x")).groupBy("name").agg(F.collect_set("x").alias("spans"))  # as long as the document at most
    unsure = settled(unsure, "stretch-unsure")
    wins = settled(_needed(docs, unsure, doc_id, text).mapInArrow(lambda batches: (_windows(p) for p in slices(batches)), "kind long, u1 long, u2 long, doc_id long, name long, at long"), "stretch-windows")
    again = judged_windows(wins.where("kind = 1").select("u1", "u2", "doc_id", "name", "at")).unionByName(wins.where("kind = 2").select("name", "at"))
    ranges = parts.where("kind = 2").select("name", at, size).unionByName(later).unionByName(again.withColumn("size", F.lit(WINDOW).cast("long")))
    return every, ranges


def _cut(part: pa.RecordBatch):
    """For each text with its ranges: the words that stay."""
    w = Words(*text_bytes(part.column(1)), SPACED, lower=False, hashed=False)
    raw = w.data.tobytes()
    for i, spans in enumerate(part.column(3).to_pylist()):
        n = int(w.first[i + 1] - w.first[i])
        cover = np.zeros(n + 1, np.int64)
        for r in spans:
            cover[min(r["at"], n)] += 1
            cover[min(r["at"] + r["size"], n)] -= 1
        stay = np.flatnonzero(np.cumsum(cover)[:n] == 0) + w.first[i]
        yield n - len(stay), b" ".join(raw[w.start[k] : w.end[k]] for k in stay)


def cut_texts(docs: DataFrame, ranges: DataFrame, doc_id: str, text: str, whole: bool) -> DataFrame:
    """doc_id, name, n_removed, and the text that stays (``whole``) or its digest, of documents with ranges."""
    own = settled(ranges.groupBy("name").agg(F.collect_set(F.struct("at", "size")).alias("spans")), "stretch-ranges")  # as long as the document at most

    def run(batches):
        for part in slices(batches):
            got = list(_cut(part))
            values = [t.decode("utf-8") if whole else hashlib.sha256(t).hexdigest() for _, t in got]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([n for n, _ in got], pa.int64()), pa.array(values, pa.string())], names=["doc_id", "name", "n_removed", "kept"])

    return _needed(docs, own, doc_id, text).mapInArrow(run, "doc_id long, name long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that lose words, with the text that stays: doc_id, n_removed, kept."""
    _, ranges = repeated_ranges(docs, doc_id, text)
    return cut_texts(docs, ranges, doc_id, text, whole=True).drop("name")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    every, ranges = repeated_ranges(docs)
    cut = cut_texts(docs, ranges, "doc_id", "text", whole=False).drop("doc_id").dropDuplicates(["name"])
    return every.join(cut, "name", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(t[i : i + 19], ' ')) AS h FROM (SELECT doc_id, t, unnest(range(1, greatest(1, len(t) - 18))) AS i FROM w)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE k > 1),
x AS (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS j FROM w),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS s, count(*) AS n FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j WHERE c.j IS NULL GROUP BY x.doc_id)
SELECT w.doc_id, len(t)::BIGINT AS n_words, (len(t) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
