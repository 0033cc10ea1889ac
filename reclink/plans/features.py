"""Exact routes over three name fields, and the 107 comparison features of a pair, as SQL of a dialect."""

from __future__ import annotations

from reclink.functions import records

EXACT = ("name_sorted", "name_nospace", "name_cons")
ROUTES = ("name", "address", "skeleton", "global_name")
CUTS = (0.25, 0.5, 0.75, 0.9)
WIDTH = 107


def exact_routes(d, limit: int) -> str:
    """Tables xa to x over nr (entity_id, source, country_norm and the fields): x has (q, rid, route). A bucket (country,
    source, key) of at most ``limit`` records gives its records; a larger one is asked again with the house and, apart
    from it, with the locality. Records without a country have no exact route."""
    each = d.array(*[d.struct(field=f"'{f}'", key=f) for f in EXACT])
    keyed = f"xk AS (SELECT entity_id, source, lower(trim(country_norm)) AS country, addr_house AS house, addr_locality AS locality, e.field AS field, e.key AS key FROM nr{d.explode(each, 'l', 'e')})"
    bucket = "country, source, field, key"
    same = "q.country = r.country AND q.field = r.field AND q.key = r.key"

    def probe(column):
        sized = f"SELECT {bucket}, {column} FROM xr WHERE n > {limit} AND {column} <> '' GROUP BY {bucket}, {column} HAVING count(*) <= {limit}"
        return f"""SELECT q.entity_id AS q, r.entity_id AS rid, concat('exact_', r.field, '_{column}') AS route FROM xq q JOIN ({sized}) b ON q.country = b.country AND q.field = b.field AND q.key = b.key AND q.{column} = b.{column}
        JOIN xr r ON r.country = b.country AND r.source = b.source AND r.field = b.field AND r.key = b.key AND r.{column} = b.{column}"""

    return f"""{keyed}, xq AS (SELECT * FROM xk WHERE source = 1 AND country <> '' AND key <> ''),
      xr AS (SELECT *, count(*) OVER (PARTITION BY {bucket}) AS n FROM xk WHERE source > 1 AND country <> '' AND key <> ''),
      x AS (SELECT q.entity_id AS q, r.entity_id AS rid, concat('exact_', r.field) AS route FROM xq q JOIN xr r ON {same} WHERE r.n <= {limit} UNION ALL {probe('house')} UNION ALL {probe('locality')})"""


def evidence(d) -> str:
    """v over x: one row a pair, with its exact routes and, as votes of the name route, their number."""
    return """xs AS (SELECT q, rid, count(*) AS exact_n, max(CASE WHEN route LIKE '%_house' THEN 1 ELSE 0 END) AS exact_house, max(CASE WHEN route LIKE '%_locality' THEN 1 ELSE 0 END) AS exact_locality FROM x GROUP BY q, rid),
      xv AS (SELECT *, row_number() OVER (PARTITION BY q, substring(rid, 1, 2) ORDER BY exact_n DESC, rid) AS place FROM xs),
      v AS (SELECT q, rid, exact_n, exact_house, exact_locality, place AS name_rank, CAST(exact_n AS DOUBLE) AS name_score, CAST(exact_n AS DOUBLE) / 61 + CAST(1 AS DOUBLE) / (60 + place) AS fusion FROM xv)"""


def _sets(d) -> dict[str, tuple[str, str]]:
    """Name of a pair of sets, and their expressions over the fields with prefixes q_ and r_."""
    words = lambda f: lambda p: d.distinct(d.words(p + f))
    pairs = lambda f, cut="": lambda p: d.keep(d.bigrams(f"replace({p}{f}, ' ', '')" if cut else p + f), "b", "b <> ''")
    numbers = lambda f: lambda p: d.distinct(d.all(p + f, "[0-9]+"))
    of = {
        "w": words("name_sorted"), "c": pairs("name_nospace"), "k": pairs("name_cons", "x"), "l": pairs("addr_locality"), "n": numbers("name_sorted"), "ac": pairs("addr_norm"),
        "aw": words("addr_norm"), "an": numbers("addr_norm"), "p": pairs("name_phon"), "s": words("addr_street"),
    }
    return {k: (f("q_"), f("r_")) for k, f in of.items()}


def features(d, columns: str = "") -> str:
    """Tables fa to fd over pairs fp (the fields with prefixes q_ and r_, route columns, fusion): fd has f0 to f106 as
    doubles. ``columns``: further columns of fp to keep, each with a comma behind it."""
    sets = _sets(d)
    size = d.size
    jac = lambda k: f"CASE WHEN {size('q' + k)} = 0 OR {size('r' + k)} = 0 THEN 0.0 ELSE CAST({size(d.intersect('q' + k, 'r' + k))} AS DOUBLE) / {size(d.distinct(d.concat('q' + k, 'r' + k)))} END"
    over = lambda k: f"CASE WHEN {size('q' + k)} = 0 OR {size('r' + k)} = 0 THEN 0.0 ELSE CAST({size(d.intersect('q' + k, 'r' + k))} AS DOUBLE) / least({size('q' + k)}, {size('r' + k)}) END"
    flag = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
    equal = lambda f: flag(f"q_{f} <> '' AND q_{f} = r_{f}")
    differ = lambda f: flag(f"q_{f} <> '' AND r_{f} <> '' AND q_{f} <> r_{f}")
    ratio = lambda f: f"CASE WHEN q_{f} = '' OR r_{f} = '' THEN 0.0 ELSE CAST(least(length(q_{f}), length(r_{f})) AS DOUBLE) / greatest(length(q_{f}), length(r_{f})) END"
    hinges = lambda names: [f"greatest(0.0, {n} - {c})" for n in names for c in CUTS]
    named = {
        "word": jac("w"), "chars": jac("c"), "cons": jac("k"), "local": jac("l"), "house": equal("addr_house"), "achar": jac("ac"), "aword": jac("aw"), "anum": jac("an"), "phon": jac("p"), "street": jac("s"),
    } | {f"{r}_vote": f"coalesce({r}_score, 0.0) / 8" for r in ROUTES}
    first = [
        equal("name_sorted"), equal("name_nospace"), equal("name_cons"), "word", "chars", "cons", over("w"), ratio("name_nospace"), "house", differ("addr_house"),
        flag("q_addr_house <> ''"), flag("r_addr_house <> ''"), "local", equal("addr_locality"), flag("q_country_norm <> '' AND lower(trim(q_country_norm)) = lower(trim(r_country_norm))"), jac("n"),
        flag(f"{size('qn')} > 0 AND {size('rn')} > 0 AND {size(d.intersect('qn', 'rn'))} = 0"), flag("q_name_nospace = ''"), flag("r_name_nospace = ''"), flag("q_addr_norm = ''"), flag("r_entity_id LIKE 'S3-%'"),
    ]
    for r in ROUTES:
        first += [flag(f"{r}_rank IS NOT NULL"), f"{r}_vote", f"CASE WHEN {r}_rank IS NULL THEN 0.0 ELSE 1 / sqrt(CAST({r}_rank AS DOUBLE)) END"]
    first += ["CAST(exact_n AS DOUBLE) / 3", flag("exact_house > 0"), flag("exact_locality > 0"), "fusion * 10"]
    address = "address_vote"
    products = [("chars", address), ("word", address), ("cons", address), ("chars", "house"), ("cons", "house"), ("chars", "local"), ("cons", "local"), ("name_vote", address), ("skeleton_vote", address), ("house", "local")]
    second = [f"{a} * {b}" for a, b in products] + hinges(("chars", "word", "cons", "local", address))
    third = ["achar", "aword", over("aw"), "anum", "phon", "street", equal("addr_postcode"), differ("addr_postcode"), equal("addr_region"), equal("name_legal"), flag("r_addr_norm = ''"), ratio("addr_norm")]
    third += [f"{a} * {b}" for a, b in (("chars", "achar"), ("cons", "achar"), ("phon", "achar"), ("word", "aword"), ("house", "achar"), ("chars", "anum"), ("cons", "anum"), ("phon", "anum"))]
    third += hinges(("achar", "aword", "anum", "phon", "street"))
    every = [*first, *second, *third]
    assert len(every) == WIDTH
    return f"""fa AS (SELECT *, {', '.join(f'{q} AS q{k}, {r} AS r{k}' for k, (q, r) in sets.items())} FROM fp),
      fb AS (SELECT *, {', '.join(f'CAST({x} AS DOUBLE) AS {n}' for n, x in named.items())} FROM fa),
      fd AS (SELECT {columns}{', '.join(f'CAST({x} AS DOUBLE) AS f{i}' for i, x in enumerate(every))} FROM fb)"""


FIELDS = ("entity_id", "country_norm", "name_sorted", "name_nospace", "name_cons", "name_phon", "name_legal", "addr_norm", "addr_house", "addr_locality", "addr_postcode", "addr_region", "addr_street")


def paired(fields=FIELDS) -> str:
    """fp: the pairs of v with both records' fields; routes without evidence are null."""
    sides = ", ".join(f"{a}.{f} AS {p}_{f}" for a, p in (("a", "q"), ("b", "r")) for f in fields)
    none = ", ".join(f"CAST(NULL AS INT) AS {r}_rank, CAST(NULL AS DOUBLE) AS {r}_score" for r in ROUTES[1:])
    return f"fp AS (SELECT v.*, {none}, {sides} FROM v JOIN nr a ON a.entity_id = v.q JOIN nr b ON b.entity_id = v.rid)"


def party_records(d, mark) -> str:
    """nr: the fields of the party's records, written once."""
    rec = f"{d.party()}, rec AS (SELECT entity_id, country, name, address FROM party)"
    text = records.normalized(d, rec)
    steps, select = text.removeprefix("WITH ").rsplit(" SELECT entity_id, ", 1)
    return f"{steps}, nr AS (SELECT CAST(substring(entity_id, 2, 1) AS INT) AS source, entity_id, {select}){mark('nr')}"
