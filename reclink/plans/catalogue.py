"""The registered queries of the engine and the SQL they are checked with.

``documents`` plays the table of dirty records (see ``Dialect.party``), ``part`` the table with many equal
keys. Joins are equi-joins on keys whose buckets are counted first; nothing is collected or broadcast by hand.
"""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from reclink.functions import records
from reclink.functions import vocabulary as V
from reclink.functions.dialect import DUCK, SPARK
from reclink.operators import scoring, similarity
from reclink.plans import counted, features
from reclink.sources import scratch
from reclink.streaming import resume

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def clean_text(d):
    return f"SELECT doc_id, {d.clean('text')} AS cleaned FROM documents"


def fold_accents(d):
    return f"SELECT doc_id, {d.fold('text')} AS folded FROM documents"


def script_tags(d):
    s = d.scripts("text")
    return f"SELECT doc_id, {d.join('s', ',')} AS scripts, CASE {d.size('s')} WHEN 0 THEN 'other' WHEN 1 THEN {d.join('s', ',')} ELSE 'mixed' END AS script FROM (SELECT doc_id, {s} AS s FROM documents) x"


def script_distribution(d):
    return f"""SELECT source, lang, script, count(*) AS n FROM (SELECT source, lang, CASE {d.size('s')} WHEN 0 THEN 'other' WHEN 1 THEN {d.join('s', ',')} ELSE 'mixed' END AS script
      FROM (SELECT source, lang, {d.scripts('text')} AS s FROM documents) x) y GROUP BY GROUPING SETS ((source, script), (source, lang, script))"""


def phonetic_key(d):
    return f"SELECT p_partkey, {d.phonetic('p_name')} AS phon FROM part"


def consonant_skeleton(d):
    return f"SELECT p_partkey, {d.skeleton('p_name')} AS cons FROM part"


def sorted_tokens(d):
    return f"SELECT p_partkey, {d.sorted_words('p_name')} AS sorted_name FROM part"


def number_tokens(d):
    return f"SELECT c_custkey, {d.join(d.sort(d.distinct(d.all('c_name', '[0-9]+'))))} AS nums FROM customer"


def acronym(d):
    return f"SELECT p_partkey, {d.join(d.map(d.words(d.clean('p_name')), 'w', 'substring(w, 1, 1)'), '')} AS acronym FROM part"


def domain_names(d):
    host = d.extract("url", "^[a-z]+://([^/?#]*)")
    name = d.extract("host", rf"^(?:www\.)?([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*)\.(?:{'|'.join(V.DOMAINS)})$")
    return f"SELECT page_id, replace({name}, '.', ' ') AS name, {name} <> '' AS is_domain FROM (SELECT page_id, {host} AS host FROM pages) x"


def country_alias(d):
    return f"SELECT n_nationkey, {d.country('n_name')} AS country FROM nation"


def legal_forms(d):
    return f"WITH {d.party()}, c AS (SELECT entity_id, {d.legal(d.clean('name'))} AS n FROM party) SELECT entity_id, n AS name_norm, {d.core('n')} AS name_core FROM c"


def normalized_names(d):
    core = f"SELECT entity_id, country, {d.core('n')} AS core FROM (SELECT entity_id, country, {d.legal(d.clean('name'))} AS n FROM party) y"
    return f"""WITH {d.party()} SELECT entity_id, country, core AS name_core, {d.sorted_words('core')} AS name_sorted, replace(core, ' ', '') AS name_nospace,
      {d.join(d.map(d.words('core'), 'w', 'substring(w, 1, 1)'), '')} AS name_acronym, {d.join(d.sort(d.distinct(d.all('core', '[0-9]+'))))} AS name_nums FROM ({core}) x"""


def normalized_records(d):
    """The 24 fields of whole documents as records: the name goes to the first period, the address is all the rest,
    and the language stands for a spelling of a country."""
    cut = "strpos(text, '.')" if d.name == "duck" else "instr(text, '.')"
    countries = "CASE lang WHEN 'en' THEN 'U.S.A.' WHEN 'fr' THEN 'République Française' WHEN 'de' THEN 'bharat' ELSE ' Peru ' END"
    rec = f"""rec AS (SELECT concat('S', CAST(1 + doc_id % 3 AS VARCHAR(20)), '-', CAST(doc_id AS VARCHAR(20))) AS entity_id, {countries} AS country,
      CASE WHEN {cut} > 0 THEN substring(text, 1, {cut} - 1) ELSE text END AS name, CASE WHEN {cut} > 0 THEN substring(text, {cut} + 1) ELSE '' END AS address FROM documents WHERE text IS NOT NULL)"""
    return records.normalized(d, rec)


def expanded_addresses(d):
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.ABBREVIATIONS.items())
    dropped = ", ".join(f"'{t}'" for t in V.STREET_WORDS + V.UNIT_WORDS)
    return f"""WITH {d.party()}, e AS (SELECT entity_id, {d.map(d.words(d.clean('address')), 'w', f'CASE w {cases} ELSE w END')} AS t FROM party)
      SELECT entity_id, {d.join('t')} AS addr_norm, {d.join(d.keep('t', 'w', f'w NOT IN ({dropped})'))} AS addr_core, {d.join(d.sort(d.distinct(d.keep('t', 'w', d.like('w', '^[0-9]+$')))))} AS addr_nums FROM e"""


def trigram_df(d):
    return f"SELECT g AS term, count(DISTINCT p_partkey) AS df FROM part{d.explode(d.grams('p_name'), 't', 'g')} GROUP BY g"


def rare_terms(d):
    return f"""WITH g AS (SELECT item_id, w AS term FROM benchmark{d.explode(d.distinct(d.words(d.clean('text'))), 't', 'w')}), f AS (SELECT term, count(*) AS df FROM g GROUP BY term)
      SELECT item_id, term, df, rk FROM (SELECT item_id, g.term, df, CAST(row_number() OVER (PARTITION BY item_id ORDER BY df, g.term) AS BIGINT) AS rk FROM g JOIN f ON g.term = f.term) x WHERE rk <= 16"""


def _pairs(columns):
    return f"SELECT a.p_partkey AS a, b.p_partkey AS b, {columns} FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey"


def bigram_jaccard_pairs(d):
    return f"SELECT a, b, {d.jaccard('x', 'y')} AS jaccard FROM ({_pairs(d.bigrams('a.p_name') + ' AS x, ' + d.bigrams('b.p_name') + ' AS y')}) z"


def levenshtein_pairs(d):
    return _pairs("CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS distance, round(1.0 - CAST(levenshtein(a.p_name, b.p_name) AS DOUBLE) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity")


def length_ratio_pairs(d):
    return _pairs("round(CAST(least(length(a.p_name), length(b.p_name)) AS DOUBLE) / greatest(length(a.p_name), length(b.p_name)), 6) AS ratio")


def exact_key_join(d):
    return f"""WITH {d.party()}, k AS (SELECT entity_id, source, country, {d.sorted_words(d.clean('name'))} AS key FROM party), n AS (SELECT source, country, key, count(*) AS c FROM k WHERE source > 1 AND key <> '' GROUP BY source, country, key)
      SELECT q.entity_id AS query, r.entity_id AS candidate, n.c AS bucket FROM k q JOIN n ON q.country = n.country AND q.key = n.key JOIN k r ON r.source = n.source AND r.country = n.country AND r.key = n.key WHERE q.source = 1 AND n.c <= 100"""


def capped_bucket_join(d):
    return """WITH n AS (SELECT p_name, p_brand, count(*) AS c FROM part GROUP BY p_name, p_brand HAVING count(*) <= 3)
      SELECT a.p_partkey AS a, b.p_partkey AS b, c FROM part a JOIN n ON a.p_name = n.p_name AND a.p_brand = n.p_brand JOIN part b ON b.p_name = n.p_name AND b.p_brand = n.p_brand WHERE a.p_partkey < b.p_partkey"""


def refined_bucket_join(d):
    """Buckets over the cap are probed again with the house-like and, apart from it, the locality-like column."""
    return """WITH n AS (SELECT p_name, p_brand FROM part GROUP BY p_name, p_brand HAVING count(*) > 3), big AS (SELECT part.* FROM part JOIN n ON part.p_name = n.p_name AND part.p_brand = n.p_brand),
      h AS (SELECT p_name, p_brand, p_size FROM big GROUP BY p_name, p_brand, p_size HAVING count(*) <= 3), l AS (SELECT p_name, p_brand, p_type FROM big GROUP BY p_name, p_brand, p_type HAVING count(*) <= 3)
      SELECT a.p_partkey AS a, b.p_partkey AS b, 'house' AS route FROM big a JOIN h ON a.p_name = h.p_name AND a.p_brand = h.p_brand AND a.p_size = h.p_size JOIN big b ON b.p_name = h.p_name AND b.p_brand = h.p_brand AND b.p_size = h.p_size WHERE a.p_partkey < b.p_partkey
      UNION ALL SELECT a.p_partkey, b.p_partkey, 'locality' FROM big a JOIN l ON a.p_name = l.p_name AND a.p_brand = l.p_brand AND a.p_type = l.p_type JOIN big b ON b.p_name = l.p_name AND b.p_brand = l.p_brand AND b.p_type = l.p_type WHERE a.p_partkey < b.p_partkey"""


def bm25_topk(d):
    """Ten documents a benchmark item by BM25 (k1 1.2, b 0.75, tf 1) over the item's 16 rarest words."""
    return f"""WITH t AS (SELECT doc_id, w AS term FROM documents{d.explode(d.distinct(d.words(d.clean('text'))), 'e', 'w')}){stored('t')}, f AS (SELECT term, count(*) AS df FROM t GROUP BY term), l AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY doc_id),
      s AS (SELECT count(*) AS n, avg(dl) AS al FROM l), q AS (SELECT item_id, w AS term FROM benchmark{d.explode(d.distinct(d.words(d.clean('text'))), 'e', 'w')}),
      r AS (SELECT item_id, term, df FROM (SELECT item_id, q.term, df, row_number() OVER (PARTITION BY item_id ORDER BY df, q.term) AS k FROM q JOIN f ON q.term = f.term) x WHERE k <= 16),
      m AS (SELECT item_id, t.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0.000001) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS score FROM r JOIN t ON r.term = t.term JOIN l ON l.doc_id = t.doc_id CROSS JOIN s GROUP BY item_id, t.doc_id)
      SELECT item_id, doc_id, score, CAST(k AS BIGINT) AS rk FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM m) y WHERE k <= 10"""


def stored(name):
    """A mark behind a table of a WITH list: Spark writes the table once and goes on from what it wrote."""
    return f"/* stored: {name} */"


def _signatures(d, bands=8):
    mins = ", ".join(f"min({d.hash32(f"""concat('{i}:', g)""")}) AS m{i}" for i in range(2 * bands))
    return f"{d.party()}, m AS (SELECT doc_id, source, country, {mins} FROM party{d.explode(d.grams(d.clean('name')), 't', 'g')} GROUP BY doc_id, source, country){stored('m')}"


def _bands(d, bands=8):
    """b: one row for each record and band, from one pass over the signatures."""
    each = d.array(*[d.struct(band=i, h1=f"m{2 * i}", h2=f"m{2 * i + 1}") for i in range(bands)])
    return f"{_signatures(d, bands)}, b AS (SELECT doc_id, source, country, e.band AS band, e.h1 AS h1, e.h2 AS h2 FROM m{d.explode(each, 'x', 'e')})"


def minhash_bands(d):
    return f"WITH {_bands(d)} SELECT doc_id, CAST(band AS BIGINT) AS band, h1, h2 FROM b"


def lsh_vote_topk(d):
    """Votes are shared bands; keys with over 200 postings are left out whole."""
    return f"""WITH {_bands(d)}, n AS (SELECT source, country, band, h1, h2 FROM b WHERE source > 1 GROUP BY source, country, band, h1, h2 HAVING count(*) <= 200),
      v AS (SELECT q.doc_id AS q, r.source, r.doc_id AS rid, count(*) AS votes FROM b q JOIN n ON q.country = n.country AND q.band = n.band AND q.h1 = n.h1 AND q.h2 = n.h2 JOIN b r ON r.source = n.source AND r.country = n.country AND r.band = n.band AND r.h1 = n.h1 AND r.h2 = n.h2 WHERE q.source = 1 GROUP BY q.doc_id, r.source, r.doc_id)
      SELECT q, source, rid, votes, CAST(k AS BIGINT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY votes DESC, rid) AS k FROM v) x WHERE k <= 30"""


def cross_country_rescue(d):
    return f"""WITH {_bands(d)}, n AS (SELECT band, h1, h2 FROM b WHERE source > 1 GROUP BY band, h1, h2 HAVING count(*) <= 200), v AS (SELECT q.doc_id AS q, r.doc_id AS rid, count(*) AS votes FROM b q JOIN n ON q.band = n.band AND q.h1 = n.h1 AND q.h2 = n.h2 JOIN b r ON r.band = n.band AND r.h1 = n.h1 AND r.h2 = n.h2 WHERE q.source = 1 AND r.source > 1 AND q.country <> r.country GROUP BY q.doc_id, r.doc_id)
      SELECT q, rid, votes FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY votes DESC, rid) AS k FROM v) x WHERE k <= 5"""


def exact_key_join_whole(d):
    """``exact_key_join`` with the buckets of any size: the SQL it is checked with leaves out those over 100."""
    return f"""WITH {d.party()}, k AS (SELECT entity_id, source, country, {d.sorted_words(d.clean('name'))} AS key FROM party), n AS (SELECT source, country, key, count(*) AS c FROM k WHERE source > 1 AND key <> '' GROUP BY source, country, key)
      SELECT q.entity_id AS query, r.entity_id AS candidate, n.c AS bucket FROM k q JOIN n ON q.country = n.country AND q.key = n.key JOIN k r ON r.source = n.source AND r.country = n.country AND r.key = n.key WHERE q.source = 1"""


def _classes(d, of, most, bands=8):
    """Band keys of all sizes, one posting for a class of records that agree in all bands: the records of a class
    have the same votes and go by its smallest id. ``of`` names the classes of candidates; only the ``most``
    smallest ids of one can be among the ``most`` best of a query: x holds those, xb and yb the classes' keys."""
    class_ = f"PARTITION BY {of}, keys"
    keys = ", ".join(f"concat_ws(':', {i}, m{2 * i}, m{2 * i + 1})" for i in range(bands))
    return f"""{_signatures(d, bands)}, c AS (SELECT doc_id, source, country, array({keys}) AS keys FROM m),
      x AS (SELECT doc_id AS rid, {of}, keys, rc, i FROM (SELECT *, row_number() OVER ({class_} ORDER BY doc_id) AS i, min(doc_id) OVER ({class_} ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc FROM c WHERE source > 1) z WHERE i <= {most}),
      yc AS (SELECT country, keys, min(doc_id) AS qc FROM c WHERE source = 1 GROUP BY country, keys), y AS (SELECT doc_id AS q, c.country, qc FROM c JOIN yc ON yc.country = c.country AND yc.keys = c.keys WHERE source = 1),
      xb AS (SELECT {of}, rc, key FROM x{d.explode('keys', 'e', 'key')} WHERE i = 1), yb AS (SELECT country, qc, key FROM yc{d.explode('keys', 'e', 'key')})"""


def lsh_vote_topk_whole(d):
    """``lsh_vote_topk`` with the keys of any size: the SQL it is checked with leaves out those over 200 postings."""
    return f"""WITH {_classes(d, 'source, country', 30)}, v AS (SELECT yb.country, qc, source, rc, count(*) AS votes FROM yb JOIN xb ON yb.country = xb.country AND yb.key = xb.key GROUP BY yb.country, qc, source, rc),
      t AS (SELECT * FROM (SELECT v.country, qc, v.source, rid, votes, row_number() OVER (PARTITION BY v.country, qc, v.source ORDER BY votes DESC, rid) AS k FROM v JOIN x ON x.source = v.source AND x.country = v.country AND x.rc = v.rc) z WHERE k <= 30)
      SELECT q, source, rid, votes, CAST(k AS BIGINT) AS rk FROM t JOIN y ON y.country = t.country AND y.qc = t.qc"""


def cross_country_rescue_whole(d):
    """``cross_country_rescue`` with the keys of any size: the SQL it is checked with leaves out those over 200 postings."""
    return f"""WITH {_classes(d, 'country', 5)}, v AS (SELECT yb.country, qc, xb.country AS other, rc, count(*) AS votes FROM yb JOIN xb ON yb.key = xb.key WHERE yb.country <> xb.country GROUP BY yb.country, qc, xb.country, rc),
      t AS (SELECT * FROM (SELECT v.country, qc, rid, votes, row_number() OVER (PARTITION BY v.country, qc ORDER BY votes DESC, rid) AS k FROM v JOIN x ON x.country = v.other AND x.rc = v.rc) z WHERE k <= 5)
      SELECT q, rid, votes FROM t JOIN y ON y.country = t.country AND y.qc = t.qc"""


def _routes(d):
    return f"""{d.party()}, k AS (SELECT doc_id, source, country, {d.clean('name')} AS name, {d.clean('address')} AS address FROM party),
      e AS (SELECT q.doc_id AS q, r.doc_id AS rid, 'exact_name' AS route, 1 AS rk FROM k q JOIN k r ON q.country = r.country AND q.name = r.name WHERE q.source = 1 AND r.source > 1 AND q.name <> ''),
      a AS (SELECT q.doc_id AS q, r.doc_id AS rid, 'address' AS route, CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY r.doc_id) AS INT) AS rk FROM k q JOIN k r ON q.country = r.country AND q.address = r.address WHERE q.source = 1 AND r.source > 1 AND q.address <> ''),
      u AS (SELECT * FROM e UNION ALL SELECT * FROM a)"""


def rank_fusion(d):
    return f"WITH {_routes(d)} SELECT q, rid, fusion, CAST(row_number() OVER (PARTITION BY q ORDER BY fusion DESC, rid) AS BIGINT) AS rk FROM (SELECT q, rid, round(sum(CAST(1 AS DOUBLE) / (60 + rk)), 8) AS fusion FROM u GROUP BY q, rid) f"


def route_counts(d):
    return f"WITH {_routes(d)}, c AS (SELECT q, rid, count(*) AS n FROM u GROUP BY q, rid) SELECT route, count(*) AS hits, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_here FROM u JOIN c ON u.q = c.q AND u.rid = c.rid GROUP BY route"


def evidence_json(d):
    return f"SELECT event_id, {d.json('props', 'page')} AS page, {d.json('props', 'ref')} AS ref FROM events"


def _core(d, pairs):
    w = lambda s: d.distinct(d.words(f"{s}.p_name"))
    cols = f"""CASE WHEN a.p_name <> '' AND a.p_name = b.p_name THEN 1.0 ELSE 0.0 END AS f_equal, {w('a')} AS x, {w('b')} AS y, {d.bigrams("replace(a.p_name, ' ', '')")} AS p, {d.bigrams("replace(b.p_name, ' ', '')")} AS r,
      round(CAST(least(length(replace(a.p_name, ' ', '')), length(replace(b.p_name, ' ', ''))) AS DOUBLE) / greatest(length(replace(a.p_name, ' ', '')), length(replace(b.p_name, ' ', ''))), 6) AS f_length"""
    return f"SELECT a, b, CAST(f_equal AS DOUBLE) AS f_equal, {d.jaccard('x', 'y')} AS f_words, {d.jaccard('p', 'r')} AS f_bigrams, round(CAST({d.size(d.intersect('x', 'y'))} AS DOUBLE) / least({d.size('x')}, {d.size('y')}), 6) AS f_overlap, f_length FROM ({pairs(cols)}) z"


def feature_vector_core(d):
    return _core(d, _pairs)


def exact_routes(d):
    """Pairs by three exact name fields, with refinement of buckets over the limit (small here, so that there are some)."""
    return f"WITH {features.party_records(d, stored)}, {features.exact_routes(d, 2)} SELECT q, rid, route FROM x"


def feature_vector(d):
    """The 107 comparison features of all pairs of the exact routes."""
    columns = ", ".join(f"round(f{i}, 6) AS f{i}" for i in range(features.WIDTH))
    return f"WITH {features.party_records(d, stored)}, {features.exact_routes(d, 100)}, {features.evidence(d)}, {features.paired()}, {features.features(d, 'q, rid, ')} SELECT q, rid, {columns} FROM fd"


def _score(core):
    return f"SELECT a, b, round(1 / (1 + exp(-least(35.0, greatest(-35.0, 4.0 * f_words + 3.0 * f_bigrams + 2.0 * f_length - 5.0)))), 6) AS score FROM ({core}) s"


def lr_score(d):
    """A literal logistic model over three of the features, with the sum clipped at 35."""
    return _score(feature_vector_core(d))


def threshold_filter(d):
    """Pairs at a threshold, or at nine tenths of their record's best score."""
    return f"SELECT a, b, score FROM (SELECT a, b, score, max(score) OVER (PARTITION BY a) AS best FROM ({lr_score(d)}) s) t WHERE score >= 0.9 OR score >= 0.9 * best"


def _names(d, of=lambda core: core):
    """k: the parts of a brand, size, type and name, with their least and largest key; s: features of two names, computed
    once for all parts of these names that make a pair."""
    core = _core(d, lambda cols: f"SELECT a.p_name AS a, b.p_name AS b, {cols} FROM n")
    return f"""k AS (SELECT p_brand, p_size, p_type, p_name, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY p_brand, p_size, p_type, p_name){stored('k')},
      n AS (SELECT DISTINCT named_struct('p_name', a.p_name) AS a, named_struct('p_name', b.p_name) AS b FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.lo < b.hi), s AS ({of(core)}){stored('s')}"""


def _expanded(columns, more="", left="(SELECT /*+ REPARTITION(p_partkey) */ * FROM part)"):
    """All pairs: few bytes of parts make many, so they are dealt out first."""
    return f"SELECT a.p_partkey AS a, b.p_partkey AS b, {columns} FROM {left} a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey JOIN s ON s.a <=> a.p_name AND s.b <=> b.p_name{more}"


def feature_vector_core_named(d):
    return f"WITH {_names(d)} {_expanded('f_equal, f_words, f_bigrams, f_overlap, f_length')}"


def lr_score_named(d):
    return f"WITH {_names(d, _score)} {_expanded('score')}"


def threshold_filter_named(d):
    """A part's best score, from the names that it meets in a part with a larger key, is known before the pairs are made."""
    return f"""WITH {_names(d, _score)}, m AS (SELECT x.p_brand, x.p_size, x.p_type, x.p_name, y.hi, max(score) AS score FROM k x JOIN k y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_type = y.p_type AND x.lo < y.hi JOIN s ON s.a <=> x.p_name AND s.b <=> y.p_name GROUP BY ALL),
      t AS (SELECT x.p_partkey, max(score) AS best FROM part x JOIN m ON m.p_brand = x.p_brand AND m.p_size = x.p_size AND m.p_type = x.p_type AND m.p_name <=> x.p_name AND x.p_partkey < m.hi GROUP BY x.p_partkey),
      g AS (SELECT x.*, best FROM part x JOIN t ON t.p_partkey = x.p_partkey) {_expanded('score', ' WHERE score >= 0.9 OR score >= 0.9 * best', 'g')}"""


def idf_cosine_pairs(d):
    return f"""WITH t AS (SELECT p_partkey AS id, w FROM part{d.explode(d.distinct(d.words('p_name')), 'e', 'w')}), f AS (SELECT w, ln((s.n + 1.0) / (count(*) + 1)) + 1 AS idf FROM t CROSS JOIN (SELECT count(*) AS n FROM part) s GROUP BY w, s.n),
      v AS (SELECT id, t.w, idf FROM t JOIN f ON t.w = f.w){stored('v')}, m AS (SELECT id, sqrt(sum(idf * idf)) AS norm FROM v GROUP BY id), p AS ({_pairs('1 AS one')})
      SELECT p.a, p.b, round(sum(x.idf * y.idf) / max(m.norm * k.norm), 6) AS cosine FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b AND y.w = x.w JOIN m ON m.id = p.a JOIN m k ON k.id = p.b GROUP BY p.a, p.b"""


def _judged(d):
    """Truth: same name and brand; guesses: same name and size. A query is a part with a small key."""
    return """t AS (SELECT a.p_partkey AS q, b.p_partkey AS c FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey),
      g AS (SELECT a.p_partkey AS q, b.p_partkey AS c, round(1.0 / (1 + abs(a.p_size - b.p_size)), 6) AS s FROM part a JOIN part b ON a.p_name = b.p_name AND abs(a.p_size - b.p_size) <= 5 AND a.p_partkey <> b.p_partkey),
      o AS (SELECT p_partkey AS q, p_brand AS slice FROM part), nt AS (SELECT q, count(*) AS n FROM t GROUP BY q)"""


def _f05(source):
    return f"""SELECT o.q, o.slice, coalesce(n, 0) AS truth, coalesce(k, 0) AS guesses, coalesce(h, 0) AS hits, CAST(CASE WHEN coalesce(n, 0) = 0 THEN CASE WHEN coalesce(k, 0) = 0 THEN 1 ELSE 0 END ELSE CAST(5 * coalesce(h, 0) AS DOUBLE) / (n + 4 * coalesce(k, 0)) END AS DOUBLE) AS f
      FROM o LEFT JOIN nt ON nt.q = o.q LEFT JOIN (SELECT g.q, count(*) AS k, count(t.c) AS h FROM {source} g LEFT JOIN t ON t.q = g.q AND t.c = g.c GROUP BY g.q) x ON x.q = o.q"""


def macro_f05(d):
    return f"WITH {_judged(d)}, r AS ({_f05('g')}) SELECT round(avg(f), 6) AS macro_f05, round(CAST(sum(hits) AS DOUBLE) / sum(guesses), 6) AS micro_precision, round(CAST(sum(hits) AS DOUBLE) / sum(truth), 6) AS micro_recall, count(*) AS queries FROM r"


def country_slices(d):
    return f"WITH {_judged(d)}, r AS ({_f05('g')}) SELECT slice, round(avg(f), 6) AS macro_f05, count(*) AS queries FROM r GROUP BY slice"


def _sweep(d, steps):
    """(i, score): macro F0.5 at the thresholds i / steps, for any grid in one pass over the pairs. A pair counts in
    the cell of the highest threshold that it passes; a query's score changes only at its own cells, and the sum of
    these changes from the top down to a threshold is the score there."""
    return f"""{_judged(d)}, p AS (SELECT g.q, CAST(floor(g.s * {steps} + 0.000001) AS BIGINT) AS i, count(*) AS k, count(t.c) AS h FROM g LEFT JOIN t ON t.q = g.q AND t.c = g.c GROUP BY 1, 2),
      r AS (SELECT q, i, sum(k) OVER (PARTITION BY q ORDER BY i DESC) AS k, sum(h) OVER (PARTITION BY q ORDER BY i DESC) AS h FROM p WHERE i > 0),
      f AS (SELECT r.q, i, CASE WHEN n IS NULL THEN 0.0 ELSE CAST(5 * h AS DOUBLE) / (n + 4 * k) END AS f, CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END AS f0 FROM r LEFT JOIN nt ON nt.q = r.q),
      c AS (SELECT i, CAST(f AS DOUBLE) - coalesce(lag(CAST(f AS DOUBLE)) OVER (PARTITION BY q ORDER BY i DESC), CAST(f0 AS DOUBLE)) AS change FROM f),
      u AS (SELECT i, sum(change) AS change FROM c GROUP BY i),
      e AS (SELECT count(*) AS m, sum(CASE WHEN nt.q IS NULL THEN 1 ELSE 0 END) AS singles FROM o LEFT JOIN nt ON nt.q = o.q),
      w AS (SELECT i FROM (SELECT 1 AS one) z{d.explode(d.span('1', str(steps)), 'y', 'i')}),
      grid AS (SELECT w.i, sum(coalesce(change, 0.0)) OVER (ORDER BY w.i DESC) AS gain, 1 AS one FROM w LEFT JOIN u ON u.i = w.i),
      curve AS (SELECT i, round(CAST((singles + gain) AS DOUBLE) / m, 9) AS score FROM grid JOIN (SELECT 1 AS one, m, singles FROM e) e1 ON e1.one = grid.one)"""


def threshold_sweep(d):
    return f"WITH {_sweep(d, 20)} SELECT round(CAST(i AS DOUBLE) / 20, 2) AS threshold, round(score, 6) AS macro_f05 FROM curve"


def threshold_choice(d):
    """The threshold of the best macro F0.5 among 200, of equal ones the highest."""
    return f"WITH {_sweep(d, 200)} SELECT round(CAST(i AS DOUBLE) / 200, 3) AS threshold, round(score, 6) AS macro_f05 FROM (SELECT i, score, row_number() OVER (ORDER BY score DESC, i DESC) AS k FROM curve) x WHERE k = 1"


def recall_report(d):
    return f"""WITH {_judged(d)}, r AS (SELECT nt.q, n, count(g.c) AS h FROM nt JOIN t ON t.q = nt.q LEFT JOIN g ON g.q = t.q AND g.c = t.c GROUP BY nt.q, n)
      SELECT round(CAST(sum(h) AS DOUBLE) / sum(n), 6) AS pair_recall, round(avg(CAST(h AS DOUBLE) / n), 6) AS macro_recall, round(avg(CAST(CASE WHEN h = n THEN 1 ELSE 0 END AS DOUBLE)), 6) AS complete, round(avg(CAST(5 * h AS DOUBLE) / (4 * h + n)), 6) AS oracle_f05 FROM r"""


def candidate_percentiles(d):
    return f"SELECT round(avg(n), 6) AS mean, CAST({d.quantile(0.5, 'n')} AS BIGINT) AS p50, CAST({d.quantile(0.95, 'n')} AS BIGINT) AS p95, CAST({d.quantile(0.99, 'n')} AS BIGINT) AS p99, max(n) AS most FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) x"


def lift_report(d):
    """How often keys agree on true pairs (equal first twelve words) and on shifted ones."""
    return f"""WITH {d.party()}, k AS (SELECT doc_id, {d.clean('name')} AS name, {d.sorted_words(d.clean('name'))} AS sorted_name, {d.clean('address')} AS address FROM party),
      p AS (SELECT 'true' AS kind, a.name AS n1, b.name AS n2, a.sorted_name AS s1, b.sorted_name AS s2 FROM k a JOIN k b ON a.address = b.address AND a.doc_id < b.doc_id AND a.address <> ''
        UNION ALL SELECT 'random', a.name, b.name, a.sorted_name, b.sorted_name FROM k a JOIN k b ON b.doc_id = a.doc_id + 1)
      SELECT kind, count(*) AS pairs, CAST(sum(CASE WHEN n1 <> '' AND n1 = n2 THEN 1 ELSE 0 END) AS BIGINT) AS name_hits, CAST(sum(CASE WHEN s1 <> '' AND s1 = s2 THEN 1 ELSE 0 END) AS BIGINT) AS sorted_hits FROM p GROUP BY kind"""


def trailing_component_mining(d):
    return f"SELECT tail, count(*) AS n FROM (SELECT {d.extract('url', '/([a-z]+)/[^/]*/?$')} AS tail FROM pages) x WHERE tail <> '' GROUP BY tail HAVING count(*) >= 5"


def seeded_sample(d):
    return f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS k FROM (SELECT doc_id, h FROM (SELECT doc_id, {d.hash32(_salted('17', 'doc_id'))} AS h FROM documents) y ORDER BY h, doc_id LIMIT 100) z) x WHERE k <= 100"


def _salted(seed, col):
    return f"concat('{seed}:', CAST({col} AS VARCHAR(20)))"


def stratified_negatives(d):
    return f"SELECT toxic, doc_id FROM (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY {d.hash32(_salted('5', 'doc_id'))}, doc_id) AS k FROM labels) x WHERE k <= 30"


def split_70_15_15(d):
    h = f"{d.hash32(_salted('41', 'doc_id'))} % 100"
    return f"SELECT doc_id, CASE WHEN {h} < 70 THEN 'fit' WHEN {h} < 85 THEN 'calibrate' ELSE 'audit' END AS part FROM documents"


def semi_reduce(d):
    return "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"


def missing_truth_left_join(d):
    return "SELECT d.lang, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE CAST(l.toxic AS VARCHAR(9)) END AS bucket, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2"


def coverage_anti(d):
    return "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')"


def zip_full_outer(d):
    return "SELECT coalesce(d.doc_id, l.doc_id) AS id, d.doc_id IS NULL AS no_document, l.doc_id IS NULL AS no_label FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id"


def set_operations(d):
    return "SELECT 'both' AS part, o_custkey AS k FROM orders INTERSECT SELECT 'both', c_custkey FROM customer UNION (SELECT 'never', c_custkey FROM customer EXCEPT SELECT 'never', o_custkey FROM orders)"


def validator_violations(d):
    return f"""WITH {d.party()}, x AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS q, concat('S', CAST(1 + p_size % 4 AS VARCHAR(9)), '-', CAST(p_partkey % 1500 AS VARCHAR(9))) AS c FROM part)
      SELECT 'duplicate' AS rule, CAST(q AS VARCHAR(20)) AS row_id, c AS id FROM x GROUP BY q, c HAVING count(*) > 1 UNION ALL SELECT 'prefix', CAST(q AS VARCHAR(20)), c FROM x WHERE c NOT LIKE 'S2-%' AND c NOT LIKE 'S3-%'
      UNION ALL SELECT 'unknown', CAST(q AS VARCHAR(20)), c FROM x WHERE (c LIKE 'S2-%' OR c LIKE 'S3-%') AND NOT EXISTS (SELECT 1 FROM party WHERE entity_id = c) UNION ALL SELECT 'missing', entity_id, '' FROM party WHERE source = 1 AND NOT EXISTS (SELECT 1 FROM x WHERE x.q = doc_id)"""


def country_histogram(d):
    return "SELECT lang AS country, source, count(*) AS n FROM documents GROUP BY lang, source"


def conversation_turns(d):
    return "SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS place, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


PLANS = [clean_text, fold_accents, script_tags, script_distribution, phonetic_key, consonant_skeleton, sorted_tokens, number_tokens, acronym, domain_names, country_alias, legal_forms, normalized_names, normalized_records, expanded_addresses, trigram_df, rare_terms, bigram_jaccard_pairs, levenshtein_pairs, length_ratio_pairs, exact_key_join, capped_bucket_join, refined_bucket_join, bm25_topk, minhash_bands, lsh_vote_topk, cross_country_rescue, rank_fusion, route_counts, evidence_json, exact_routes, feature_vector, feature_vector_core, lr_score, threshold_filter, idf_cosine_pairs, macro_f05, country_slices, threshold_sweep, threshold_choice, recall_report, candidate_percentiles, lift_report, trailing_component_mining, seeded_sample, stratified_negatives, split_70_15_15, semi_reduce, missing_truth_left_join, coverage_anti, zip_full_outer, set_operations, validator_violations, country_histogram, conversation_turns]


def over(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over frames by name, after FROM or JOIN; the session's views are neither read nor replaced."""
    text = text.replace("{", "{{").replace("}", "}}")
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b(?= (?:AS )?[a-z])", r"\1 {\2}", text)  # an alias follows
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b", r"\1 {\2} AS \2", text), **frames)


def run(plan, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a plan's Spark form over the tables of a folder; only the tables it reads are opened."""
    *steps, text = re.split(r"/\* stored: ([a-z]+) \*/,?", plan(SPARK))
    frames = {}

    def answer(sql):
        for t in set(re.findall(rf"\b(?:FROM|JOIN) ({'|'.join(TABLES)})\b", sql)):
            frames.setdefault(t, spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet"))
        return over(spark, sql, **frames)

    opened = lambda sql: sql if sql.lstrip().startswith(("WITH", "SELECT")) else f"WITH {sql}"
    for before, name in zip(steps[::2], steps[1::2], strict=True):
        frames[name] = scratch.stored(answer(f"{opened(before)} SELECT * FROM {name}"), f"plan-{name}")
    return answer(opened(text))


QUERIES = {p.__name__: partial(run, p) for p in PLANS}
QUERIES |= {p.__name__.removesuffix("_whole"): partial(run, p) for p in (exact_key_join_whole, lsh_vote_topk_whole, cross_country_rescue_whole)}
QUERIES |= {p.__name__.removesuffix("_named"): partial(run, p) for p in (feature_vector_core_named, lr_score_named, threshold_filter_named)}
QUERIES |= {p.__name__: partial(run, partial(p, stored=stored)) for p in (counted.threshold_choice, counted.country_slices, counted.recall_report, counted.macro_f05, counted.threshold_sweep)}
QUERIES |= {"jaro_winkler_pairs": similarity.jaro_winkler_pairs, "fuzzy_ratio_pairs": similarity.fuzzy_ratio_pairs, "trained_lr_score": scoring.trained_lr_score, "trained_tree_score": scoring.trained_tree_score, "stream_resume": resume.event_totals}
ORACLES = {p.__name__: p(DUCK) for p in PLANS}
ORACLES |= {
    "jaro_winkler_pairs": _pairs("round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS jaro_winkler"),
    "stream_resume": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
}
