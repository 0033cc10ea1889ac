"""Operators on candidate pairs: edit features, scoring, reranking, pools, choice of thresholds, samples and reports.

A pair is a row (q, rid, ...); what belongs to one query is found by windows and grouped sums, never collected. Only
the edit and soft-token features run in Python, in Arrow batches over the pairs that are left by then.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similarity as S

EDITED = ("name_sorted", "name_nospace", "name_cons", "name_phon", "addr_norm")
GATES = (0.00001, 0.00003, 0.0001, 0.0003, 0.001, 0.003, 0.01, 0.03, 0.05, 0.1, 0.2)


def _added(columns) -> Column:
    return reduce(lambda x, y: x + y, columns)


# Features ------------------------------------------------------------------------------------------------------


def edit_features(pairs: DataFrame, first: int = 107) -> DataFrame:
    """The 22 edit features of fields q_* and r_*: edit similarity, Jaro-Winkler and ratio of five fields and of the sorted
    address, then token-set and weighted ratios of name and address. 0 where a side is empty."""
    ordered = lambda c: F.array_join(F.array_sort(F.filter(F.split(c, " "), lambda w: w != "")), " ")
    sides = [(F.col(f"q_{f}"), F.col(f"r_{f}")) for f in EDITED] + [(ordered("q_addr_norm"), ordered("r_addr_norm"))]
    out = []
    for a, b in sides:
        some = (a != "") & (b != "")
        out.append(F.when(some, 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))).otherwise(0.0))
        out += [F.when(some, S.pairwise(fn, a, b) / k).otherwise(0.0) for fn, k in ((S.jaro_winkler_of, 1), (S.indel_ratio_of, 100))]
    for a, b in (sides[0], sides[4]):
        out += [F.when((a != "") & (b != ""), S.pairwise(fn, a, b) / 100).otherwise(0.0) for fn in (S.token_set_ratio_of, S.weighted_ratio_of)]
    return pairs.select("*", *[x.cast("double").alias(f"f{first + i}") for i, x in enumerate(out)])


def idf_table(queries: DataFrame, column: str) -> DataFrame:
    """(token, idf) over the distinct tokens of the rows: ln((N + 1) / (n + 1)) + 1. A token not in it has
    ``idf_default``."""
    n = queries.count()
    tokens = queries.select(F.explode(F.array_distinct(F.filter(F.split(column, " "), lambda w: w != ""))).alias("token"))
    return tokens.groupBy("token").agg((F.log((F.lit(n) + 1.0) / (F.count("*") + 1)) + 1).alias("idf"))


def idf_default(n: int) -> float:
    import math

    return math.log(n + 1) + 1


def with_idf(pairs: DataFrame, column: str, idf: DataFrame, default: float, into: str) -> DataFrame:
    """Adds ``q_<into>`` and ``r_<into>``: arrays of (token, weight) of both sides' distinct words, by a join on tokens.
    ``pairs`` needs q and rid."""
    for side, key in (("q", "q"), ("r", "rid")):
        words = F.array_distinct(F.filter(F.split(f"{side}_{column}", " "), lambda w: w != ""))
        each = pairs.select(key, F.explode(words).alias("token")).distinct().join(idf, "token", "left")
        own = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", F.coalesce("idf", F.lit(default)).alias("w")))).alias(f"{side}_{into}"))
        none = F.array().cast("array<struct<token: string, w: double>>")
        pairs = pairs.join(own, key, "left").withColumn(f"{side}_{into}", F.coalesce(f"{side}_{into}", none))
    return pairs


def idf_similarity(into: str) -> list[Column]:
    """Weighted cosine and weighted overlap of two (token, weight) arrays."""
    a, b = F.col(f"q_{into}"), F.col(f"r_{into}")
    both = F.array_intersect(a, b)
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x["w"]))
    norm = F.sqrt(total(a, lambda w: w * w) * total(b, lambda w: w * w))
    least = F.least(total(a, lambda w: w), total(b, lambda w: w))
    return [F.when(norm > 0, total(both, lambda w: w * w) / norm).otherwise(0.0), F.when((F.size(a) > 0) & (F.size(b) > 0), total(both, lambda w: w) / least).otherwise(0.0)]


def number_features(q: str = "q_addr_norm", r: str = "r_addr_norm") -> list[Column]:
    """Counts of numbers only here, only there and common, equality as a sequence and as a multiset, and the gap."""
    a, b = (F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)) for x in (q, r))
    x, y = F.array_distinct(a), F.array_distinct(b)
    some = F.size(a) > 0
    return [F.size(F.array_except(x, y)), F.size(F.array_except(y, x)), F.size(F.array_intersect(x, y)), (some & (a == b)).cast("int"), (some & (F.array_sort(a) == F.array_sort(b))).cast("int"), F.abs(F.size(a) - F.size(b))]


def soft_tokens(a: list, b: list) -> tuple[float, float, float]:
    """How well ``b`` covers ``a`` (lists of (token, weight)): the best ratio of its longest token, of its rarest one,
    and the weighted mean over all."""
    if not a or not b:
        return 0.0, 0.0, 0.0
    best = {t: max(S.indel_ratio_of(t, u) for u, _ in b) for t, _ in a}
    longest = max(a, key=lambda x: (len(x[0]), x[0]))[0]
    rarest = max(a, key=lambda x: (x[1], len(x[0]), x[0]))[0]
    return best[longest] / 100, best[rarest] / 100, sum(w * best[t] for t, w in a) / (100 * sum(w for _, w in a))


def soft_features(into: str) -> Column:
    """The six soft-token features as one array: the record for the query, then the query for the record."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        lists = lambda v: [(t["token"], t["w"]) for t in v]
        return pd.Series([[*soft_tokens(lists(p), lists(q)), *soft_tokens(lists(q), lists(p))] for p, q in zip(x, y, strict=True)])

    return run(F.col(f"q_{into}"), F.col(f"r_{into}"))


def late_features(pairs: DataFrame, idf: dict[str, tuple[DataFrame, float]], first: int = 129) -> DataFrame:
    """The last 24 features: weighted token similarities of name and address, lengths and counts, numbers, edit distance
    of the joined names, ratio of the houses, soft tokens. ``idf``: (table, default) of name and of address."""
    pairs = with_idf(with_idf(pairs, "name_sorted", *idf["name"], into="names"), "addr_norm", *idf["address"], into="addresses")
    n = lambda c: F.char_length(c)
    out = [*idf_similarity("names"), *idf_similarity("addresses")]
    out += [F.least(n("q_name_nospace"), n("r_name_nospace")) / 40, F.greatest(n("q_name_nospace"), n("r_name_nospace")) / 40, F.size("q_names") / 10, F.size("r_names") / 10, n("q_addr_norm") / 150, n("r_addr_norm") / 150]
    out += number_features()
    out.append(F.levenshtein("q_name_nospace", "r_name_nospace") / 20)
    out.append(F.when((F.col("q_addr_house") != "") & (F.col("r_addr_house") != ""), S.pairwise(S.indel_ratio_of, F.col("q_addr_house"), F.col("r_addr_house")) / 100).otherwise(0.0))
    pairs = pairs.withColumn("soft", soft_features("names"))
    out += [F.get("soft", F.lit(i)) for i in range(6)]
    return pairs.select("*", *[x.cast("double").alias(f"f{first + i}") for i, x in enumerate(out)]).drop("soft", "q_names", "r_names", "q_addresses", "r_addresses")


def moments(df: DataFrame, columns: list[str], floor: float = 0.05) -> tuple[list[float], list[float]]:
    """Means and population deviations of feature columns; a deviation under the floor counts as 1."""
    row = df.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    n = len(columns)
    return [row[i] or 0.0 for i in range(n)], [1.0 if (row[n + i] or 0.0) < floor else row[n + i] for i in range(n)]


# Prediction ----------------------------------------------------------------------------------------------------


def predict_scores(pairs: DataFrame, columns: list[str], model: dict) -> DataFrame:
    """Adds ``score`` of a logistic model (mean, scale, weights with the bias first), its sum clipped at 35."""
    if len(model["weights"]) != len(columns) + 1 or len(model["mean"]) != len(columns):
        raise ValueError("the model is incompatible with these features")
    z = F.lit(float(model["weights"][0])) + _added([(F.col(c).cast("double") - float(m)) / float(s) * float(w) for c, m, s, w in zip(columns, model["mean"], model["scale"], model["weights"][1:], strict=True)])
    return pairs.withColumn("score", 1 / (1 + F.exp(-F.least(F.lit(35.0), F.greatest(F.lit(-35.0), z)))))


def matches(scored: DataFrame, queries: DataFrame, threshold: float, relative: float = 0.0) -> DataFrame:
    """(q, candidates, matches): one row for every query, also without any; matches reach the threshold and, with
    ``relative``, that share of the query's best score. A list is as long as one query's candidates."""
    best = F.max("score").over(Window.partitionBy("q"))
    good = F.col("score") >= F.greatest(F.lit(threshold), relative * best)
    ids = lambda c: F.array_sort(F.collect_list(c))
    found = scored.withColumn("good", good).groupBy("q").agg(ids(F.col("rid")).alias("candidates"), ids(F.when(F.col("good"), F.col("rid"))).alias("matches"))
    none = F.array().cast("array<string>")
    return queries.select("q").join(found, "q", "left").select("q", F.coalesce("candidates", none).alias("candidates"), F.coalesce("matches", none).alias("matches"))


def choose_gate(pairs: DataFrame, threshold: float, grid=GATES) -> tuple[float, list[dict]]:
    """The largest gate of the grid that loses neither a true pair nor one that the full model accepts; ``pairs``: gate,
    full, label. One pass; returns the gate (0 if none is safe) and what each loses."""
    under = lambda t, c: F.count_if((F.col("gate") < t) & c)
    true, kept = F.col("label") == 1, F.col("full") >= threshold
    row = pairs.agg(F.count("*"), *[x for t in grid for x in (under(t, F.lit(True)), under(t, true), under(t, kept))]).first()
    trials = [{"threshold": t, "full_model_fraction": 1 - row[1 + 3 * i] / row[0] if row[0] else 0.0, "true_pairs_lost": row[2 + 3 * i], "positives_lost": row[3 + 3 * i]} for i, t in enumerate(grid)]
    return max((x["threshold"] for x in trials if not x["true_pairs_lost"] and not x["positives_lost"]), default=0.0), trials


def cascade(pairs: DataFrame, gate: float, full) -> DataFrame:
    """Pairs below the gate get no full score: ``full`` is applied to the rest only."""
    return full(pairs.where(F.col("gate") >= gate))


# Pools and reranking -------------------------------------------------------------------------------------------


def rarity(queries: DataFrame, bands: DataFrame, limit: int) -> DataFrame:
    """(q, rid, votes, rarity) of query keys (q, key) against band postings (key, rid): votes count shared keys, rarity
    adds 1 / sqrt(bucket size). Buckets over the limit take no part (the configured limit of the index)."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= limit)
    return queries.join(sizes, "key").join(bands, "key").groupBy("q", "rid").agg(F.count("*").alias("votes"), F.sum(1 / F.sqrt("n")).alias("rarity"))


def pool(votes: DataFrame, size: int) -> DataFrame:
    """The best by votes together with the best by rarity, each ``size`` of a query."""
    own = Window.partitionBy("q")
    first = F.row_number().over(own.orderBy(F.desc("votes"), "rid"))
    second = F.row_number().over(own.orderBy(F.desc("rarity"), F.desc("votes"), "rid"))
    return votes.withColumn("a", first).withColumn("b", second).where((F.col("a") <= size) | (F.col("b") <= size)).drop("a", "b")


def rerank(pairs: DataFrame, view: str, k: int) -> DataFrame:
    """The k best of a query's pool by text, in ``rank``; votes stay as they are. A pool of at most k is not compared: it
    keeps the order of votes. Views: address, skeleton, or name (also for other countries)."""
    ratio = lambda f, fn=S.indel_ratio_of: S.pairwise(fn, F.col(f"q_{f}"), F.col(f"r_{f}"))
    if view == "address":
        score = 0.75 * F.greatest(ratio("addr_norm"), ratio("addr_norm", S.token_sort_ratio_of)) + 0.25 * ratio("name_sorted")
    elif view == "skeleton":
        score = 0.75 * ratio("name_cons") + 0.25 * ratio("addr_norm")
    else:
        score = 0.75 * F.greatest(ratio("name_sorted"), ratio("name_nospace")) + 0.25 * ratio("addr_norm")
    sized = pairs.withColumn("n", F.count("*").over(Window.partitionBy("q")))
    large = sized.where(F.col("n") > k).withColumn("text", score)
    both = large.unionByName(sized.where(F.col("n") <= k).withColumn("text", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("text"), F.desc("votes"), "rid"))
    return both.withColumn("rank", place).where(F.col("rank") <= k).drop("n", "text")


# Samples and splits --------------------------------------------------------------------------------------------


def _drawn(seed: int, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key).cast("string"))


def sample(truth: DataFrame, size: int, seed: int = 17, key: str = "q", exclude: DataFrame | None = None) -> DataFrame:
    """``size`` rows by a seeded hash, the same on every run; rows whose key is in ``exclude`` take no part."""
    left = truth if exclude is None else truth.join(exclude.select(key), key, "left_anti")
    return left.orderBy(_drawn(seed, key), key).limit(size)


def check_coverage(one: DataFrame, other: DataFrame, key: str = "q") -> None:
    """Both must hold each key once, and the same keys."""
    for df in (one, other):
        twice = df.groupBy(key).count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"{twice[0][0]} occurs more than once")
    for a, b in ((one, other), (other, one)):
        missing = a.join(b.select(key), key, "left_anti").head(1)
        if missing:
            raise ValueError(f"{missing[0][key]} is missing on one side")


def split(ids: DataFrame, shares: dict[str, float], seed: int = 41, key: str = "q") -> DataFrame:
    """Adds ``part``: exact shares (or whole numbers) of the rows in a seeded order; the last part takes what is left."""
    from reclink.sources.stores import dense_ids

    placed = dense_ids(ids.withColumn("_h", _drawn(seed, key)), "_h", key, name="_n").drop("_h")
    total, end, part = placed.count(), 0, F.lit(list(shares)[-1])
    bounds = []
    for name, share in list(shares.items())[:-1]:
        end += int(share * total) if share <= 1 else int(share)
        bounds.append((name, end))
    for name, last in reversed(bounds):
        part = F.when(F.col("_n") <= last, name).otherwise(part)
    return placed.withColumn("part", part).drop("_n")


# Reports -------------------------------------------------------------------------------------------------------


def recall_report(truth: DataFrame, candidates: DataFrame, queries: DataFrame, pool_size: int) -> dict:
    """Blocking quality: ``truth`` and ``candidates`` are pairs (q, rid), ``queries`` all q. Queries that match nothing
    count in the ceiling; candidates of queries that match nothing are counted, not judged."""
    hit = truth.join(candidates.withColumn("hit", F.lit(1)), ["q", "rid"], "left")
    true = hit.groupBy("q").agg(F.count("*").alias("n"), F.count("hit").alias("h"))
    asked = queries.join(true, "q", "left").join(candidates.groupBy("q").agg(F.count("*").alias("k")), "q", "left").fillna(0, ["n", "h", "k"])
    some = F.col("n") > 0
    row = asked.agg(
        F.count("*").alias("query_count"), F.sum("n").alias("true_links"), F.sum("h").alias("retrieved_true_links"), F.sum("k").alias("candidate_pairs"), F.avg("k").alias("mean_candidates"), F.max("k").alias("max_candidates"),
        F.expr("percentile_disc(0.95) within group (order by k)").alias("p95_candidates"), F.expr("percentile_disc(0.99) within group (order by k)").alias("p99_candidates"), F.count_if(F.col("k") == 0).alias("zero_candidate_queries"),
        F.avg(F.when(some, F.col("h") / F.col("n"))).alias("macro_recall"), F.avg(F.when(some, (F.col("h") == F.col("n")).cast("int"))).alias("complete"),
        F.avg(F.when(some, 1.25 * F.col("h") / (F.col("h") + 0.25 * F.col("n"))).otherwise(1.0)).alias("oracle_f05"),
        F.count_if(~some).alias("singletons"), F.count_if(~some & (F.col("k") > 0)).alias("singletons_with_candidates"),
    ).first().asDict()
    links, pairs, n = row["true_links"], row["candidate_pairs"], row["query_count"]
    return row | {"pair_recall": row["retrieved_true_links"] / links if links else None, "reduction_ratio": 1 - pairs / (n * pool_size) if n and pool_size else None}


def recall_slices(truth: DataFrame, candidates: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """(slice, total, retrieved, recall) of true pairs; ``slices`` name columns of ``truth``. One pass for all."""
    hit = truth.join(candidates.select("q", "rid").withColumn("hit", F.lit(1)), ["q", "rid"], "left")
    labels = F.array(*[F.concat(F.lit(f"{name}:"), F.coalesce(c.cast("string"), F.lit("missing"))) for name, c in slices.items()])
    out = hit.select("hit", F.explode(labels).alias("slice")).groupBy("slice").agg(F.count("*").alias("total"), F.count("hit").alias("retrieved"))
    return out.withColumn("recall", F.col("retrieved") / F.col("total"))


def lift(pairs: DataFrame, keys: tuple) -> DataFrame:
    """(key, hit_pct, fp_pct) of fields q_* and r_* on pairs with ``true``: how often true pairs, and others, agree. A key
    can be two fields joined by +."""
    side = lambda p, k: F.concat_ws("|", *[F.col(p + f) for f in k.split("+")]) if "+" in k else F.col(p + k)
    agree = lambda k: (side("q_", k) != "") & (side("q_", k) == side("r_", k))
    sums = pairs.agg(F.count_if("true").alias("t"), F.count_if(~F.col("true")).alias("o"), *[x for i, k in enumerate(keys) for x in (F.count_if(F.col("true") & agree(k)).alias(f"h{i}"), F.count_if(~F.col("true") & agree(k)).alias(f"f{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.round(100 * F.col(f"h{i}") / F.greatest("t", F.lit(1)), 3).alias("hit_pct"), F.round(100 * F.col(f"f{i}") / F.greatest("o", F.lit(1)), 4).alias("fp_pct")) for i, k in enumerate(keys)]))
    return sums.select(rows.alias("x")).select("x.*")


def script_report(records: DataFrame, script: str = "name_script") -> DataFrame:
    """(source, country, script, n, pct) with country null for a source as a whole, and ``warning`` where over 95 % are
    'other': then the column is not a raw name."""
    counts = records.groupingSets([["source", script], ["source", "country", script]], "source", "country", script).agg(F.count("*").alias("n"))
    own = Window.partitionBy("source", "country")
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(own), 4)).withColumn("warning", (F.col(script) == "other") & (F.col("pct") > 95)).withColumnRenamed(script, "script")


def validate_lists(lists: DataFrame, required: DataFrame, known: DataFrame | None = None, key: str = "q", ids: str = "ids") -> DataFrame:
    """(rule, n, examples) of lists (key, ids): repeated rows, repeated ids in a list, ids of source 1, other prefixes,
    ids that are not known (if given), required keys without a row and rows without a required key. Five examples each,
    the smallest."""
    each = lists.select(F.col(key).alias("q"), F.explode(ids).alias("id"))
    asked = required.select(F.col(key).alias("x"))
    found = {
        "duplicate row": lists.groupBy(key).count().where("count > 1").select(F.col(key).alias("x")),
        "repeated id": lists.where(F.size(F.array_distinct(ids)) < F.size(ids)).select(F.col(key).alias("x")),
        "source 1 id": each.where("id like 'S1-%'").select(F.col("id").alias("x")),
        "other prefix": each.where("not id rlike '^S[123]-'").select(F.col("id").alias("x")),
        "required missing": asked.join(lists.select(F.col(key).alias("x")), "x", "left_anti"),
        "not required": lists.select(F.col(key).alias("x")).join(asked, "x", "left_anti"),
    }
    if known is not None:
        found["unknown id"] = each.where("id rlike '^S[23]-'").select(F.col("id").alias("x")).join(known.select(F.col("entity_id").alias("x")), "x", "left_anti")
    rows = reduce(DataFrame.unionByName, [df.distinct().withColumn("rule", F.lit(rule)) for rule, df in found.items()])
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("rule").orderBy("x")))
    some = ranked.where("k <= 5").groupBy("rule").agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return rows.groupBy("rule").agg(F.count("*").alias("n")).join(some, "rule")


def outside_candidates(matched: DataFrame, candidates: DataFrame, key: str = "q", ids: str = "ids") -> DataFrame:
    """Matches (key, id) that are not among the key's candidates: a warning, as the lists are valid without."""
    each = lambda df: df.select(key, F.explode(ids).alias("id"))
    return each(matched).join(each(candidates), [key, "id"], "left_anti")


def evidence_of(routes: DataFrame, cap: int = 0) -> DataFrame:
    """(q, rid, routes, fusion, place) of route rows (q, rid, route, rank, score): fusion adds 1 / (60 + rank); with a cap
    a query keeps its best."""
    out = routes.groupBy("q", "rid").agg(F.map_from_entries(F.collect_list(F.struct("route", F.struct(F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"))))).alias("routes"), F.sum(1 / (60 + F.col("rank"))).alias("fusion"))
    out = out.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("fusion"), "rid")))
    return out.where(F.col("place") <= cap) if cap else out


def voting_keys(queries: DataFrame, countries: DataFrame) -> DataFrame:
    """Band keys (q, country, ...) of queries without a country are asked in every country that the records have; the
    countries are few and counted."""
    blank = queries.where(F.col("country") == "").drop("country")
    names = F.array_sort(F.collect_set("country"))
    every = countries.agg(names.alias("countries")).withColumn("one", F.lit(1))
    spread = blank.withColumn("one", F.lit(1)).join(every, "one").withColumn("country", F.explode("countries")).drop("countries", "one")
    return queries.where(F.col("country") != "").unionByName(spread)


def hex_token(value: Column) -> Column:
    """A text as letters and digits only, for indexes whose query language reads punctuation."""
    return F.concat(F.lit("x"), F.lower(F.hex(F.encode(F.lower(value), "UTF-8"))))


