"""Operator 5: MinHash near-duplicates by an inverted join of signature coordinates.

Each distinct shingle set gets a signature of ``COORDS`` minima. It is posted under its (coordinate, value)
pairs, and two sets are candidates if at least ``MATCHES`` coordinates agree. By the pigeonhole principle
such sets share a pair among the COORDS - MATCHES + 1 pairs of each that come first in one global order, so
only these prefixes are merged; the order is by rising frequency, which leaves the pairs of common passages
out of the prefixes. The remaining coordinates are skipped in the merge and counted on the signatures of the
candidates, and those that agree often enough are confirmed on the full sets.

A set of Jaccard similarity 0.85 misses the threshold with probability 1.2e-6 (``miss_probability``).

Groups are never expanded into pairs. Equal sets form one class. In a posting list, members are compared
with one centre a round (the most typical member first, then others) and lists whose members are all connected are
left. What the star rounds leave is compared across components only, block by block and without a cap, so no
link that joins two components is lost. Long lists, centres of many pairs and classes of many rows are dealt out
by salts.

Defined cases: null texts and texts without words have no shingles, are linked with nothing and stay; texts
of fewer words than a shingle have one; rows that repeat a doc_id count as one document and each returns
its row (``dedup`` keeps one of them); a null doc_id is linked with nothing and stays; other columns pass.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED, U64, Words, bloom_bitmap, bloom_column, bloom_test, int64, mix, salted_join, settled, slices, table, text_bytes

COORDS, MATCHES = 40, 22
SHINGLE = 3
PERCENT = 85
#: The pipeline's stage: five words and 80 %, with matches for that similarity (missed with probability 1.1e-6).
STAGE = {"size": 5, "percent": 80, "matches": 19}
ROUNDS = 1
MEMBERS, SHINGLES, TILE = 2048, 400_000, 512
_SEED = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))


def miss_probability(similarity: float, coords: int = COORDS, matches: int = MATCHES) -> float:
    return sum(comb(coords, k) * similarity**k * (1 - similarity) ** (coords - k) for k in range(matches))


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted, and the offsets of the texts' sets."""
    w = Words(data, off, SPACED, lower=True)
    n, docs = np.diff(w.first), len(off) - 1
    per = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(docs), per)
    begin = np.concatenate([[0], np.cumsum(per)])
    at = w.first[:-1][doc] + np.arange(begin[-1]) - begin[doc]
    h = np.zeros(len(at), U64)
    width = np.minimum(n, size)[doc]
    for k in range(size):
        live = width > k
        h[live] += mix(w.hash[at[live] + k] + _SEED[k]) * (_SEED[16 + k] | U64(1))
    h = mix(h + width.astype(U64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=docs))])


def set_names(h: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """128 bits that name each set, 0 for an empty one."""
    n = np.diff(begin)
    some = np.flatnonzero(n)
    s = [np.zeros(len(n), U64), np.zeros(len(n), U64)]
    for k in range(2 if len(some) else 0):
        s[k][some] = np.add.reduceat(mix(h ^ _SEED[200 + k]), begin[:-1][some])
    return s


def signatures(docs: DataFrame, doc_id: str, text: str, coords: int, size: int) -> DataFrame:
    """doc_id, n (set size), s1, s2 (the set's name), sig (null for an empty set)."""

    def run(batches):
        for part in slices(batches):
            data, off = text_bytes(part.column(1))
            h, begin = shingle_sets(data, off, size)
            n = np.diff(begin)
            some = np.flatnonzero(n)
            sig = np.zeros((len(some), coords), U64)
            for k in range(coords if len(some) else 0):
                sig[:, k] = np.minimum.reduceat((h ^ _SEED[k]) * (_SEED[64 + k] | U64(1)), begin[:-1][some])
            ends = np.concatenate([[0], np.cumsum((n > 0) * coords)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), int64(n), *map(int64, set_names(h, begin)), pa.ListArray.from_arrays(pa.array(ends), int64(sig.ravel()))], names=["doc_id", "n", "s1", "s2", "sig"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``wanted`` (doc_id, s1, s2, ...) with the sets' members, by a second pass over the texts. A bitmap of fixed
    size drops most other rows before they are hashed; the join that follows is exact."""
    bitmap = bloom_bitmap(wanted, "doc_id")

    def run(batches):
        for batch in batches:
            hit = bloom_test(bitmap, batch.column(2).to_numpy(zero_copy_only=False))
            for part in slices([batch.filter(pa.array(hit))]):
                data, off = text_bytes(part.column(1))
                h, begin = shingle_sets(data, off, size)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(int64, set_names(h, begin)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), int64(h))], names=["doc_id", "s1", "s2", "members"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    found = given.select("doc_id", "text", bloom_column("doc_id").alias("bit")).mapInArrow(run, "doc_id long, s1 long, s2 long, members array<long>")
    return found.join(wanted.hint("merge"), ["doc_id", "s1", "s2"]).dropDuplicates(["doc_id"])


def both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def hops(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id within two steps. Not yet a component, but ids of one ``comp`` are connected;
    round one of a star needs no more, as all members are two steps apart."""
    e = settled(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "near-hops")
    both = both_ways(e)
    one = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
    total = 2 * edges.count()
    far = salted_join(both, one.withColumnRenamed("u", "v"), ["v"], total, ["u"]).groupBy("u").agg(F.min("m").alias("m"))
    return far.select(F.col("u").alias("id"), F.least("m", "u").alias("comp"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, comp) of the nodes of edges (a, b): comp is the smallest id reachable. Alternating large and small
    stars; each round keeps one edge a node at least, and the rounds needed grow with the logarithm. A hub's
    edges are dealt out by salts."""
    e = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before, n = None, e.count()
    while True:
        both = both_ways(e)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = salted_join(both, least, ["u"], 2 * n, ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = salted_join(large, down, ["u"], 2 * n, ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        e = settled(small, name)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        before, n = now, now[0]


def confirmed(pairs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The links (a, b) among pairs (id, o) of members and centres, which are stored: signatures agree often enough
    and full sets are similar enough. An id has few pairs; a centre can have many, which are dealt out by salts."""
    mine = pairs.join(sets.select(F.col("doc_id").alias("id"), F.col("n").alias("na"), F.col("sig").alias("sa"), F.col("members").alias("ma")).hint("merge"), "id")
    centres = pairs.groupBy("o").agg(F.count("*").alias("c")).join(sets.select(F.col("doc_id").alias("o"), F.col("n").alias("nb"), F.col("sig").alias("sb"), F.col("members").alias("mb")).hint("merge"), "o")
    both = salted_join(mine, centres, ["o"], max(1, pairs.count()), ["id"])
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = both.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (agree >= matches))
    common = F.size(F.array_intersect("ma", "mb")).cast("long")
    linked = near.withColumn("i", common).where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i")))
    return linked.select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b"))


def common_sizes(a: np.ndarray, abegin: np.ndarray, b: np.ndarray, bbegin: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x[i] of one block and y[i] of another (sorted members, offsets)."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    n, m = len(abegin) - 1, len(bbegin) - 1
    if (n + m) * len(names) <= 20_000_000:
        p, q = np.zeros((n, len(names)), np.float32), np.zeros((m, len(names)), np.float32)
        p[np.repeat(np.arange(n), np.diff(abegin)), code[: len(a)]] = 1
        q[np.repeat(np.arange(m), np.diff(bbegin)), code[len(a) :]] = 1
        return (p @ q.T)[x, y].astype(np.int64)
    return np.array([len(np.intersect1d(a[abegin[i] : abegin[i + 1]], b[bbegin[j] : bbegin[j + 1]], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)


def across(members: DataFrame, total: int, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of different components among the members of each list: ``members`` (pair, id, comp,
    c, w) with the list's numbers of members and shingles; ``total``: the number of members of all lists.

    Look-alikes share many pairs, so many lists have the same members; of those, by a 128-bit digest of the
    members, one is compared. A list is cut into blocks of about MEMBERS members and SHINGLES shingles. A list of
    one block meets itself where it was gathered; of B blocks, each meets the B / 2 that follow it in a circle, so
    the meetings of a long list are dealt out evenly by (list, block). Each meeting is one row with both blocks:
    what is shuffled is the members times B / 2, and texts that are alike but not linked never become rows.

    What is read several times is stored first (``members`` too): each use would repeat its whole plan, and the
    driver describes a plan anew whenever one of its stages ends."""
    digest = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"h{k}") for k in (0, 1)]
    one = members.groupBy("pair").agg(F.count("*").alias("c"), F.max("w").alias("w"), *digest).groupBy("c", "h0", "h1").agg(F.min(F.struct("pair", "w")).alias("x"))
    blocks = F.greatest(F.ceil(F.col("c") / MEMBERS), F.ceil(F.col("x.w") / SHINGLES)).cast("int")
    one = settled(one.select("x.pair", "c", blocks.alias("blocks")), "near-open-lists")
    kept = settled(salted_join(members.select("pair", "id", "comp"), one, ["pair"], total, ["id"]), "near-compared")
    whole = kept.join(sets.select(F.col("doc_id").alias("id"), "n", "sig", "members").hint("merge"), "id")
    item = F.collect_list(F.struct("id", "comp", "n", "sig", "members")).alias("x")
    packed = whole.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).groupBy("pair", "block").agg(F.max("blocks").alias("blocks"), item)
    alone = packed.where("blocks = 1").select("x", F.col("x").alias("y"))
    steps = F.filter(F.sequence(F.lit(0), F.floor(F.col("blocks") / 2).cast("int")), lambda k: (2 * k < F.col("blocks")) | (F.col("block") < k))
    left = packed.where("blocks > 1").withColumn("other", F.explode(F.transform(steps, lambda k: F.pmod(F.col("block") + k, F.col("blocks")))))
    met = left.join(packed.select("pair", F.col("block").alias("other"), F.col("x").alias("y")).hint("merge"), ["pair", "other"]).select("x", "y").unionByName(alone)

    def unpacked(cell):
        v = cell.values
        whole = lambda k: v.field(k).to_numpy(zero_copy_only=False)
        lists = v.field(4)
        return whole(0), whole(1), whole(2), v.field(3).flatten().to_numpy().reshape(len(v), -1), lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()

    def meet(x, y):
        """Links between tiles of two blocks; a tile is small enough for dense tables."""
        for i in range(0, len(x[0]), TILE):
            a, ca, na, sa = (v[i : i + TILE] for v in x[:4])
            for j in range(0, len(y[0]), TILE):
                b, cb, nb, sb = (v[j : j + TILE] for v in y[:4])
                good = (ca[:, None] != cb[None, :]) & (100 * np.minimum(na[:, None], nb[None, :]) >= percent * np.maximum(na[:, None], nb[None, :]))
                if not good.any():
                    continue
                agree = np.zeros(good.shape, np.int16)
                for k in range(sa.shape[1]):
                    agree += sa[:, k, None] == sb[None, :, k]
                p, q = np.nonzero(good & (agree >= matches))
                if len(p):
                    ba, bb = x[5][i : i + len(a) + 1], y[5][j : j + len(b) + 1]
                    c = common_sizes(x[4][ba[0] : ba[-1]], ba - ba[0], y[4][bb[0] : bb[-1]], bb - bb[0], p, q)
                    linked = 100 * c >= percent * (na[p] + nb[q] - c)
                    p, q = p[linked], q[linked]
                    yield pa.RecordBatch.from_arrays([int64(np.minimum(a[p], b[q])), int64(np.maximum(a[p], b[q]))], names=["a", "b"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from meet(unpacked(batch.column(0)[i]), unpacked(batch.column(1)[i]))

    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coords: int = COORDS, matches: int = MATCHES, percent: int = PERCENT, rounds: int = ROUNDS, size: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = settled(signatures(docs, doc_id, text, coords, size), "near-signatures")
    classes = rows.where(F.col("n").cast("boolean") & F.col("doc_id").isNotNull()).groupBy("s1", "s2", "n")
    classes = settled(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"), F.any_value("sig").alias("sig")), "near-classes")
    # One row for each smallest id. Classes can share one only where rows repeat an id with other texts.
    sigs = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min(F.struct("n", "s1", "s2", "sig")).alias("x")).select("doc_id", "x.*")
    posted = sigs.select("doc_id", "n", F.posexplode("sig").alias("coord", "value")).select("doc_id", "n", F.xxhash64("coord", "value").alias("pair"))
    common = posted.groupBy("pair").agg(F.count("*").alias("c")).where("c > 1")
    total = coords * classes.count()
    known = salted_join(posted, common.withColumn("df", F.col("c")), ["pair"], total, ["doc_id"])
    listed = known.groupBy("doc_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "pair"))).alias("p"))  # coords entries at most
    # Pairs of frequency 1 come first in the order; they use up places of the prefix and lead nowhere.
    places = F.greatest(F.lit(0), F.lit(coords - matches + 1) - (F.lit(coords) - F.size("p")))
    # How typical a set is: the postings that its pairs have in all. The most typical member of a list is near
    # the text that the others were copied from, and most of them link to it at once.
    typical = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("typical")
    lists = settled(listed.select(F.col("doc_id").alias("id"), "n", typical, F.explode(F.slice("p", F.lit(1), places)).alias("x")).select("id", "n", "typical", F.col("x.pair").alias("pair")), "near-postings")
    sizes = lists.groupBy("pair").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1")
    lists = settled(salted_join(lists, sizes.withColumn("size", F.col("c")), ["pair"], lists.count(), ["id"]).withColumnRenamed("size", "c").drop("n"), "near-lists")
    total = lists.count()
    wanted = settled(sigs.join(lists.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "near-candidates")
    sets = settled(full_sets(docs, wanted, doc_id, text, size), "near-sets")
    labels = None

    def open_lists(r: int) -> DataFrame:
        """Members (pair, id, c, w, comp) of the lists that are not yet one component, with a centre (o, co)."""
        at = lists.withColumn("comp", F.col("id")) if labels is None else lists.join(labels.hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        rank = (-F.col("typical") if r == 0 else F.xxhash64("pair", "id", F.lit(r))).alias("rank")
        mixed = at.groupBy("pair").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("c").alias("c"), F.min(F.struct(rank, "id", "comp")).alias("centre")).where("lo <> hi")
        return salted_join(at, mixed.select("pair", "c", F.col("centre.id").alias("o"), F.col("centre.comp").alias("co")), ["pair"], total, ["id"])

    def with_labels(links: DataFrame) -> DataFrame:
        return links if labels is None else links.unionByName(labels.select(F.col("id").alias("a"), F.col("comp").alias("b")))

    for r in range(rounds):
        pairs = settled(open_lists(r).where("comp <> co").select("id", "o").distinct(), "near-pairs")
        links = settled(confirmed(pairs, sets, matches, percent), "near-links")
        if not links.isEmpty():  # else this round's centres link to none, which says nothing of the other members
            labels = settled(hops(with_labels(links)), "near-labels")
    left = settled(open_lists(rounds).select("pair", "id", "comp", "w"), "near-open")
    rest = settled(across(left, total, sets, matches, percent), "near-rest")
    edges = with_labels(rest)
    named = classes.drop("sig")
    if edges.isEmpty():
        named = named.withColumn("comp", F.lit(None).cast("long"))
    else:
        named = named.join(settled(components(edges), "near-components").withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    # Rows of a class of equal sets come under its component; a class of one row and one component is left out.
    named = named.select("s1", "s2", "n", "c", F.coalesce("comp", "rep").alias("comp"), "rep").where("c > 1 or comp <> rep").drop("rep")
    out = salted_join(rows.drop("sig"), named, ["s1", "s2", "n"], max(1, rows.count()), ["doc_id"], "left")
    comp = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The documents without near-duplicates: the one of smallest doc_id of each group stays, once."""
    found = settled(near_duplicates(docs, doc_id, text, **kw), "near-result")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("doc_id"))  # a struct, as docs may have any columns
    left = rows.join(gone, "doc_id", "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.isEmpty():
        left = left.where(F.col("doc_id").isNull()).unionByName(left.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]))
    return left.select("row.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup(docs, **STAGE)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
        ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS h FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e2.b FROM reach r JOIN both_ways e2 ON r.b = e2.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c USING (doc_id)
"""
