"""The 24 derived fields of a record (entity_id, name, address, country), as common table expressions of a dialect.

Each step is a table of its own, so that a step is computed once however many fields use it.
"""

from __future__ import annotations

from functools import cache

from . import vocabulary as V

NAME_FIELDS = ("name_norm", "name_core", "name_sorted", "name_nospace", "name_acronym", "name_translit", "name_phon", "name_cons", "name_legal", "name_nums", "name_script", "name_is_domain")
ADDRESS_FIELDS = ("addr_norm", "addr_core", "addr_sorted", "addr_cons", "addr_nums", "addr_house", "addr_postcode", "addr_region", "addr_locality", "addr_landmark", "addr_street")
FIELDS = ("country_norm", *NAME_FIELDS, *ADDRESS_FIELDS)


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def by_country(d, tables: dict, key: str, default: dict | None = None) -> str:
    """A lookup in the table of the row's country; null where there is none."""
    cases = " ".join(f"WHEN '{c}' THEN {d.lookup(t, key)}" for c, t in tables.items())
    return f"CASE country_norm {cases} {f'ELSE {d.lookup(default, key)} ' if default else ''}END"


def regions(derived: dict[str, dict[str, str]] | None = None) -> dict[str, dict[str, str]]:
    """Names and codes of divisions by country; ``derived`` adds mined ones, which never replace a known name."""
    out = {}
    for country in [*V.REGIONS, *(c for c in derived or {} if c not in V.REGIONS)]:
        own = V.REGIONS.get(country, {})
        out[country] = {c: c for c in own.values()} | own
        for name, code in (derived or {}).get(country, {}).items():
            out[country].setdefault(name.strip().lower(), (code or name).strip().lower())
    return out


@cache
def _sounds() -> dict[int, str]:
    return {ord(a): b for a, b in V.SINGLES}


def skeleton_key(name: str) -> str:
    """The skeleton of a name of the tables, without spaces: for tables that are built with the plan."""
    out = []
    for word in name.lower().split():
        for a, b in V.DIGRAPHS:
            word = word.replace(a, b)
        word = "".join("s" if c == "c" and n in "eiy" and n else "k" if c == "c" else c for c, n in zip(word, [*word[1:], ""], strict=True))
        word = word.translate(_sounds()).replace("\x01", "c")
        kept = ["a" if word[0] in "aeiou" else word[0]] + [c for c in word[1:] if c not in "aeiou"]
        out += [c for c, before in zip(kept, ["", *kept[:-1]], strict=True) if c != before]
    return "".join(out)


def region_sounds(table: dict[str, str]) -> dict[str, str]:
    """Codes by the skeletons of division names, also with d read as t."""
    out: dict[str, str] = {}
    for name, code in table.items():
        if len(name) >= 4 and len(skeleton_key(name)) >= 3:
            out.setdefault(skeleton_key(name), code)
            out.setdefault(skeleton_key(name).replace("d", "t"), code)
    return out


def name_steps(d) -> str:
    """Tables n1 to n5 over ``rec`` (entity_id, name, address, country)."""
    host = d.extract("lower(trim(name))", rf"^\s*(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*)\.(?:{'|'.join(V.DOMAINS)})\s*$")
    spelt = f"CASE WHEN t IN ({listed(V.LEGAL_TOKENS)}) OR length(t) < 4 THEN t ELSE coalesce({d.lookup(V.RESPELT, d.skeleton('t'))}, t) END"
    return f"""n1 AS (SELECT *, {d.country('country')} AS country_norm, {d.scripts('name')} AS scripts, {host} AS host FROM rec),
      n2 AS (SELECT *, {d.translit(d.compose(d.fold("CASE WHEN host <> '' THEN replace(host, '.', ' ') ELSE name END")))} AS translit FROM n1),
      n3 AS (SELECT *, {d.clean('translit')} AS cleaned, CASE {d.size('scripts')} WHEN 0 THEN 'other' WHEN 1 THEN {d.join('scripts', ',')} ELSE 'mixed' END AS name_script FROM n2),
      n4 AS (SELECT *, {d.words(d.legal(d.join(d.map(d.words('cleaned'), 't', spelt))))} AS w FROM n3),
      n5 AS (SELECT *, {d.core_words('w', listed(V.LEGAL_TOKENS))} AS core FROM n4)"""


def name_columns(d) -> dict[str, str]:
    core = d.join("core")
    return {
        "name_norm": d.join("w"), "name_core": core, "name_sorted": d.join(d.sort(d.distinct("core"))), "name_nospace": d.join("core", ""),
        "name_acronym": d.join(d.map("core", "t", "substring(t, 1, 1)"), ""), "name_translit": "CASE WHEN name_script = 'latin' THEN '' ELSE translit END",
        "name_phon": d.phonetic(core), "name_cons": d.skeleton(core), "name_legal": d.join(d.sort(d.distinct(d.keep("w", "t", f"t IN ({listed(V.LEGAL_TOKENS)})")))),
        "name_nums": d.join(d.sort(d.distinct(d.all("cleaned", "[0-9]+")))), "name_script": "name_script", "name_is_domain": "CASE WHEN host <> '' THEN '1' ELSE '0' END",
    }


def address_steps(d, derived=None) -> str:
    """Tables a1 to a7 over n5: parts, their region codes, landmarks, cleaned parts, locality, tokens, core."""
    tables = regions(derived)
    known = by_country(d, tables, "c")
    near = by_country(d, tables, "replace(c, ' ', '')")
    skel = f"replace({d.skeleton(d.translit('p'))}, ' ', '')"
    sounds = {c: region_sounds(t) for c, t in tables.items()}
    heard = f"coalesce({by_country(d, sounds, skel)}, {by_country(d, sounds, f'''replace({skel}, 'd', 't')''')})"
    code = f"CASE WHEN {d.let(d.clean('p'), 'c', f'coalesce({known}, {near})')} IS NOT NULL THEN {d.let(d.clean('p'), 'c', f'coalesce({known}, {near})')} WHEN {d.like('p', '[^\\x00-\\x7F]')} AND length({skel}) >= 3 THEN {heard} END"
    parts = d.keep(d.map(d.split(d.compose(d.fold("address")), ","), "p", "trim(p)"), "p", f"p <> '' AND NOT {d.like('lower(p)', f'^(?:{V.NULLS})$')}")
    land = d.like("lower(p)", rf"\b(?:{'|'.join(V.LANDMARKS)})\b")
    place = f"{d.like('p', '[0-9]')} = false AND p <> '' AND {d.size(d.keep(d.words('p'), 't', f't NOT IN ({listed(V.STREET_WORDS + V.UNIT_WORDS)})'))} > 0"
    place = place.replace(d.like("p", "[0-9]") + " = false", f"{d.size(d.keep(d.words('p'), 't', d.like('t', '^[0-9]+$')))} = 0")
    null = d.rx("norm", rf"\b(?:{V.NULLS})\b", " ")
    runs = " ".join(f"WHEN '{c}' THEN {d.last(d.keep(d.all('norm', '[0-9]+'), 't', f'length(t) = {n}'))}" for c, n in V.POSTCODE.items())
    expand = f"coalesce({by_country(d, {c: V.ABBREVIATIONS | t for c, t in V.COUNTRY_ABBREVIATIONS.items()}, 't', V.ABBREVIATIONS)}, t)"
    dropped = listed(V.STREET_WORDS + V.UNIT_WORDS)
    return f"""a0 AS (SELECT *, {parts} AS parts FROM n5),
      a1 AS (SELECT *, {d.map('parts', 'p', code)} AS codes FROM a0),
      a2 AS (SELECT *, coalesce({d.last(d.keep('codes', 'c', 'c IS NOT NULL'))}, '') AS addr_region, {d.last(d.places('codes', 'c', 'c IS NOT NULL'))} AS region_at FROM a1),
      a3 AS (SELECT *, {d.without('parts', 'region_at')} AS rest FROM a2),
      a4 AS (SELECT *, {d.keep('rest', 'p', f'NOT {land}')} AS kept, {d.join(d.keep('rest', 'p', land))} AS landmark FROM a3),
      a5 AS (SELECT *, {d.map('kept', 'p', d.clean(d.translit('p')))} AS clean_parts, {d.clean(d.translit(d.join('kept', ' , ')))} AS norm FROM a4),
      a6 AS (SELECT *, coalesce({d.last(d.keep('clean_parts', 'p', place))}, {d.last('clean_parts')}, '') AS addr_locality, trim({d.rx(null, r'\s+', ' ')}) AS norm0 FROM a5),
      a7 AS (SELECT *, coalesce(CASE country_norm {runs.replace('norm', 'norm0').replace('country_norm0', 'country_norm')} END, '') AS addr_postcode, {d.map(d.words('norm0'), 't', expand)} AS tokens FROM a6),
      a8 AS (SELECT *, {d.keep('tokens', 't', f't NOT IN ({dropped}) AND t <> addr_postcode')} AS body FROM a7),
      a9 AS (SELECT *, CASE WHEN addr_region <> '' AND NOT {d.has('body', 'addr_region')} THEN {d.concat('body', d.array('addr_region'))} ELSE body END AS ac FROM a8)"""


def address_columns(d) -> dict[str, str]:
    number = d.like("t", "^[0-9]+$")
    return {
        "addr_norm": d.join("tokens"), "addr_core": d.join("ac"), "addr_sorted": d.join(d.sort(d.distinct("ac"))), "addr_cons": d.skeleton(d.join(d.keep("ac", "t", d.letter("t")))),
        "addr_nums": d.join(d.sort(d.distinct(d.keep("ac", "t", number)))), "addr_house": f"coalesce({d.first(d.keep('tokens', 't', number))}, '')", "addr_postcode": "addr_postcode",
        "addr_region": "addr_region", "addr_locality": "addr_locality", "addr_landmark": d.clean(d.translit("landmark")), "addr_street": d.join(d.keep("ac", "t", f"NOT {number} AND t <> addr_locality")),
    }


def normalized(d, rec: str, derived=None) -> str:
    """A query for entity_id, country and the 24 fields; ``rec``: tables, the last of them named rec."""
    columns = {"country_norm": "country_norm"} | name_columns(d) | address_columns(d)
    return f"WITH {rec}, {name_steps(d)}, {address_steps(d, derived)} SELECT entity_id, country, {', '.join(f'{x} AS {c}' for c, x in columns.items())} FROM a9"
