"""Operator 4: benchmark decontamination by a positional inverted index that is kept as segments.

``build_index`` cuts the documents into segments of a few megabytes and stores, for each segment, its terms
(64-bit word hashes, sorted), their posting lists (word positions in the segment, rising) and the positions
where its documents begin. ``search`` reads segments and, for each test phrase, starts from the lists of the
rarest terms of the segment, shifts them by the terms' offsets in the phrase and intersects them, the rarest
first, which leaves the exact occurrences. Segments hold whole documents, so nothing is shuffled.

Test phrases are cut into a stored table of blocks of at most ``BLOCK`` phrases (88 bytes each). One block after
the other is read and searched, and what it finds is stored, so the driver holds one block at a time whatever the
benchmark. What the blocks find is united by segment and place in it, not by doc_id, in one way for any number
of blocks.

``proximity`` returns places where all distinct words of a phrase stand within a given span, in any order.

Defined cases: null and empty texts have no words and are not contaminated; items without words or without an
item_id match nothing; an item that repeats an item_id counts once under that id; rows that repeat a doc_id, and
rows without one, are each judged; other columns do not matter. The stage judges texts: rows of equal texts
(by their 64-bit hash) have one verdict, whatever their doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, U64, Words, int64, slices, stored, table, text_bytes

WINDOW = 10
BLOCK = 100_000
PIECE = 2_000_000
SEGMENT = "terms binary, lists binary, positions binary, begins binary, doc_ids binary, known binary"


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: one row a segment, by number. ``lists`` holds where each term's postings start."""

    def run(batches):
        for part in slices(batches):
            w = Words(*text_bytes(part.column(1)), ALNUM, lower=True)
            order = np.argsort(w.hash, kind="stable")
            h = w.hash[order]
            lead = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            ids = part.column(0)
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False))
            cols = [h[lead], np.append(lead, len(h)).astype(np.uint32), order.astype(np.uint32), w.first.astype(np.uint32), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in cols], names=["terms", "lists", "positions", "begins", "doc_ids", "known"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stored(given.mapInArrow(run, SEGMENT).withColumn("segment", F.monotonically_increasing_id()), "postings")


class Segment:
    def __init__(self, terms: bytes, lists: bytes, positions: bytes, begins: bytes):
        self.terms = np.frombuffer(terms, U64)
        self.lists = np.frombuffer(lists, np.uint32).astype(np.int64)
        self.positions = np.frombuffer(positions, np.uint32).astype(np.int64)
        self.begins = np.frombuffer(begins, np.uint32).astype(np.int64)

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, side="right") - 1

    def find(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences of phrases: (phrase, position of its first word). ``words``: phrases x width."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(words):
            return none, none
        width = words.shape[1]
        inside = np.arange(width) < size[:, None]
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = (self.terms[at] == words) | ~inside
        rows = np.flatnonzero(known.all(axis=1))
        if not len(rows):
            return none, none
        at, inside = at[rows], inside[rows]
        count = np.where(inside, self.lists[at + 1] - self.lists[at], np.iinfo(np.int64).max)
        rank = np.argsort(count, axis=1, kind="stable")  # the rarest term first
        # Phrases go in pieces whose rarest lists hold PIECE positions in all (or one phrase's).
        piece = np.cumsum(count[np.arange(len(rows)), rank[:, 0]]) // PIECE
        cuts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        found = [self._intersect(at[a:b], inside[a:b], count[a:b], rank[a:b], size[rows[a:b]]) for a, b in zip(cuts, np.append(cuts[1:], len(rows)), strict=True)]
        return np.concatenate([rows[a:][p] for a, (p, _) in zip(cuts, found, strict=True)]), np.concatenate([x for _, x in found])

    def _intersect(self, at, inside, count, rank, size):
        """Occurrences (phrase, position) of phrases whose terms have the lists ``at``, by rising ``rank``."""
        width = at.shape[1]
        pick = np.arange(len(at))
        n = count[pick, rank[:, 0]]
        phrase = np.repeat(pick, n)
        base = np.concatenate([[0], np.cumsum(n)[:-1]])
        place = self.positions[self.lists[at[pick, rank[:, 0]]][phrase] + np.arange(n.sum()) - base[phrase]] - rank[phrase, 0]
        total = int(self.begins[-1])
        # The i-th rank of a term names its list; (list, position) pairs are met with the lists as sorted keys.
        keyed = self.keys(np.unique(at[inside]), total)
        for k in range(1, width):
            if not len(phrase):
                break
            slot = rank[phrase, k]
            used = inside[phrase, slot]
            want = at[phrase, slot] * (total + 1) + place + slot
            i = np.minimum(np.searchsorted(keyed, want), len(keyed) - 1)
            good = ~used | ((keyed[i] == want) & (place + slot >= 0))
            phrase, place = phrase[good], place[good]
        good = place >= 0
        phrase, place = phrase[good], place[good]
        last = place + size[phrase] - 1
        same = (last < total) & (self.doc_of(place) == self.doc_of(np.minimum(last, max(total - 1, 0))))
        return phrase[same], place[same]

    def keys(self, lists: np.ndarray, total: int) -> np.ndarray:
        """The postings of the given lists as sorted (list, position) keys."""
        n = self.lists[lists + 1] - self.lists[lists]
        which = np.repeat(lists, n)
        base = np.concatenate([[0], np.cumsum(n)[:-1]])
        return which * (total + 1) + self.positions[np.repeat(self.lists[lists] - base, n) + np.arange(n.sum())]

    def near(self, words: np.ndarray, span: int) -> np.ndarray:
        """Positions from which all the distinct words stand within ``span`` words of one document: a list of
        the rarest word's postings, narrowed by the next occurrence of every other word."""
        words = np.unique(words)
        at = np.minimum(np.searchsorted(self.terms, words), max(len(self.terms) - 1, 0))
        if not len(self.terms) or (self.terms[at] != words).any():
            return np.zeros(0, np.int64)
        lists = [self.positions[self.lists[i] : self.lists[i + 1]] for i in at]
        starts = np.unique(np.concatenate(lists))
        last = starts.copy()
        for x in sorted(lists, key=len):
            i = np.searchsorted(x, starts)
            last = np.maximum(last, np.where(i < len(x), x[np.minimum(i, len(x) - 1)], np.iinfo(np.int64).max))
        good = last < starts + span
        starts, last = starts[good], last[good]
        return starts[self.doc_of(starts) == self.doc_of(last)]


def phrases(texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the items: words (phrases x window), sizes, and the number of the item of each."""
    w = Words(*text_bytes(texts), ALNUM, lower=True)
    n = np.diff(w.first)
    per = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(n)), per)
    size = np.minimum(n, window)[item]
    begin = np.concatenate([[0], np.cumsum(per)])
    at = w.first[:-1][item] + np.arange(begin[-1]) - begin[item]
    place = at[:, None] + np.arange(window)
    words = np.where(np.arange(window) < size[:, None], w.hash[np.minimum(place, max(len(w.hash) - 1, 0))], U64(0)) if len(at) else np.zeros((0, window), U64)
    return words, size, item


def window_blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """The stored test phrases: one row for at most BLOCK of them, with the item of each by its number in names."""
    given = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).cast("string").alias("text")).where("text is not null and name is not null")
    chars = given.agg(F.sum(F.char_length("text"))).first()[0] or 0

    def run(batches):
        for part in slices(batches, limit=6 * BLOCK):
            words, size, item = phrases(part.column(1), window)
            for a in range(0, len(words), BLOCK):
                cols = [words[a : a + BLOCK], size[a : a + BLOCK].astype(np.int32), item[a : a + BLOCK].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in cols], pa.array([part.column(0).to_pylist()], pa.list_(pa.string()))], names=["words", "sizes", "items", "names"])

    blocks = given.repartition(1 + chars // (6 * BLOCK)).mapInArrow(run, "words binary, sizes binary, items binary, names array<string>")
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()), "windows")


def search_block(index: DataFrame, block, window: int) -> DataFrame:
    """What one block of phrases finds: (segment, number) of the documents hit, their items and covered runs."""
    size = np.frombuffer(block["sizes"], np.int32).astype(np.int64)
    words = np.frombuffer(block["words"], U64).reshape(-1, window)
    names = np.array(block["names"], dtype=object)[np.frombuffer(block["items"], np.int32)]
    distinct, back = np.unique(np.column_stack([words, size.astype(U64)]), axis=0, return_inverse=True)
    order = np.argsort(back.ravel(), kind="stable")
    owner = names[order]
    lead = np.searchsorted(back.ravel()[order], np.arange(len(distinct) + 1))
    w, n = np.ascontiguousarray(distinct[:, :-1]), distinct[:, -1].astype(np.int64)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(*[c[row].as_buffer() for c in batch.columns[1:]])
                phrase, place = s.find(w, n)
                if not len(phrase):
                    continue
                total, docs = int(s.begins[-1]), len(s.begins) - 1
                cover = np.zeros(total + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + n[phrase], -1)
                items: list[set] = [set() for _ in range(docs)]
                for d, p in np.unique(np.column_stack([s.doc_of(place), phrase]), axis=0):
                    items[d].update(owner[lead[p] : lead[p + 1]])
                flag = np.cumsum(cover)[:total] > 0
                edge = np.zeros(total + 1, bool)
                edge[s.begins] = True  # a run ends with its document
                a = np.flatnonzero(flag & (np.append(True, ~flag[:-1])[:total] | edge[:total]))
                b = np.flatnonzero(flag & (np.append(~flag[1:], True)[:total] | edge[1:])) + 1
                of = s.doc_of(a)
                ends = np.searchsorted(of, np.arange(docs + 1)).astype(np.int32)
                runs = [pa.ListArray.from_arrays(pa.array(ends), int64(x - s.begins[of])) for x in (a, b)]
                part = pa.RecordBatch.from_arrays([pa.array(np.full(docs, batch.column(0)[row].as_py())), int64(np.arange(docs)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *runs], names=["segment", "number", "items", "first", "last"])
                yield part.filter(pa.array(np.diff(ends) > 0))

    return index.select("segment", "terms", "lists", "positions", "begins").mapInArrow(run, "segment long, number long, items array<string>, first array<long>, last array<long>")


def documents_of(index: DataFrame) -> DataFrame:
    """(segment, number, doc_id, n_words) of every document of the index; its postings are not read."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                segment, begins, ids, known = (c[row] for c in batch.columns)
                n = np.diff(np.frombuffer(begins.as_buffer(), np.uint32).astype(np.int64))
                name = pa.array(np.frombuffer(ids.as_buffer(), np.int64), mask=~np.frombuffer(known.as_buffer(), bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), segment.as_py())), int64(np.arange(len(n))), name, int64(n)], names=["segment", "number", "doc_id", "n_words"])

    return index.select("segment", "begins", "doc_ids", "known").mapInArrow(run, "segment long, number long, doc_id long, n_words long")


def hits(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(segment, number, n_hit, items) of the contaminated documents: blocks can hit the same word, so their
    covered runs are united."""
    blocks = window_blocks(benchmark, item_id, text, window)
    found = None
    for number in blocks.select("block").orderBy("block").toLocalIterator():
        part = stored(search_block(index, blocks.where(F.col("block") == number["block"]).first(), window), "block-hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], "segment long, number long, items array<string>, first array<long>, last array<long>")
    runs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("first", "last")))).alias("r")  # as long as the document at most, for each block
    united = found.groupBy("segment", "number").agg(runs, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["last"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(s["end"], x["first"]))).alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return united.select("segment", "number", F.aggregate("r", start, step, lambda s: s["n"]).alias("n_hit"), "items")


def search(index: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of a window), items (ids, sorted as strings)."""
    joined = documents_of(index).join(hits(index, benchmark, item_id, text, window), ["segment", "number"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def proximity(index: DataFrame, words: str, span: int) -> DataFrame:
    """(doc_id, first): places from which all words of ``words`` stand within ``span`` words."""
    h = Words(*text_bytes(pa.array([words])), ALNUM, lower=True).hash

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                s = Segment(*[c[row].as_buffer() for c in batch.columns[1:5]])
                p = s.near(h, span) if len(h) else np.zeros(0, np.int64)
                d = s.doc_of(p)
                names = pa.array(np.frombuffer(batch.column(5)[row].as_buffer(), np.int64)[d], mask=~np.frombuffer(batch.column(6)[row].as_buffer(), bool)[d])
                yield pa.RecordBatch.from_arrays([names, int64(p - s.begins[d])], names=["doc_id", "first"])

    return index.select("segment", "terms", "lists", "positions", "begins", "doc_ids", "known").mapInArrow(run, "doc_id long, first long")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window stay; their texts are indexed under their hashes."""
    name = F.xxhash64(F.col("text"))
    index = build_index(docs.select(name.alias("doc_id"), "text"))
    hit = documents_of(index).join(hits(index, table(spark, sf_dir, "benchmark")), ["segment", "number"], "left_semi").select("doc_id").distinct()
    hit = hit.select(F.struct("doc_id").alias("hit"))  # a struct, as docs may have any columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(name.alias("doc_id")).alias("name"))
    return rows.join(hit, F.col("name") == F.col("hit"), "left_anti").select("row.*")


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(t), 10) AS n, array_to_string(t[i : i + 9], ' ') AS g FROM (SELECT item_id, t, unnest(range(1, greatest(2, len(t) - 8))) AS i FROM b WHERE len(t) > 0)),
k AS (SELECT DISTINCT n FROM w),
o AS (SELECT doc_id, i, x.n, w.item_id FROM (SELECT doc_id, i, n, array_to_string(t[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, t, n, unnest(range(1, greatest(1, len(t) - n + 2))) AS i FROM d, k)) x JOIN w ON w.g = x.g AND w.n = x.n),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
