"""Queries over places: whole texts, phrase windows, names and regions, with the whole table of spellings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from seine.functions import places
from seine.operators import gazetteer
from seine.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Cities that the queries add to the table, as a caller would.
CITIES = {"houston": "usa", "são paulo": "brazil", "oslo": "norway", "cairo": "egypt", "stavanger": "norway", "abu dhabi": "united arab emirates", "st. petersburg": "russia"}
_ROWS = gazetteer.default_rows() + [(s, c, False) for s, c in CITIES.items()]
_SPELLED = sorted({s for s, _, _ in _ROWS})
_quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _gazetteer(spark) -> gazetteer.Gazetteer:
    return gazetteer.Gazetteer(spark, gazetteer.table_of(spark, spark.createDataFrame(list(CITIES.items()), "spelling string, country string")))


def _planted(id_column: str, text: str, form: str) -> F.Column:
    """The text, and a sentence with a spelling that goes by the row's number."""
    chosen = F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col(id_column) % len(_SPELLED) + 1).cast("int"))
    return F.concat(F.coalesce(F.col(text), F.lit("")), F.format_string(form, chosen))


def _planted_sql(id_column: str, text: str, form: str) -> str:
    before, after = form.replace("'", "''").split("%s")
    return f"(coalesce({text}, '') || '{before}' || {_quoted(_SPELLED)}[{id_column} % {len(_SPELLED)} + 1] || '{after}')"


def _pattern(spelling: str, strict: bool) -> str:
    body = re.sub(r"([.()\-])", r"[\1]", spelling).replace("'", "''")
    if strict:
        return f"(?:^|[^a-zA-Z]){body}(?:$|[^a-zA-Z])"
    word, other = r"[\pL\pN_]", r"[^\pL\pN_]"
    before = f"(?:^|{other})" if re.match(r"\w", spelling[0]) else word
    after = f"(?:$|{other})" if re.match(r"\w", spelling[-1]) else word
    return before + body + after


def _found_sql(t: str) -> str:
    """Sorted countries of a normalised text t, by one pattern a country."""
    by: dict[str, list[str]] = {}
    for s, country, strict in _ROWS:
        by.setdefault(country, []).append(_pattern(s, strict))
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({t}, '{'|'.join(by[c])}') THEN {_quoted([c])[1:-1]} END" for c in sorted(by)) + "], lambda x: x IS NOT NULL)"




def _normal(text: str) -> str:
    return rf"lower(trim(regexp_replace({text}, '\s+', ' ', 'g')))"


_FORM = ". We moved from %s in 2019."

_add(
    "geo_places", lambda spark, d: table(spark, d, "documents").select("doc_id", F.array_join(_gazetteer(spark).countries(_planted("doc_id", "text", _FORM)), ",").alias("countries")),
    f"SELECT doc_id, array_to_string({_found_sql('t')}, ',') AS countries FROM (SELECT doc_id, {_normal(_planted_sql('doc_id', 'text', _FORM))} AS t FROM documents)",
)
_add(
    "geo_places_in_pages", lambda spark, d: table(spark, d, "pages").select("page_id", _gazetteer(spark).first(_planted("page_id", "html", "<p>%s</p>")).alias("first_country")),
    f"SELECT page_id, coalesce(({_found_sql('t')})[1], '') AS first_country FROM (SELECT page_id, {_normal(_planted_sql('page_id', 'html', '<p>%s</p>'))} AS t FROM pages)",
)

# --- windows after phrases -------------------------------------------------------------------------------------------------

_SEATS = (" Global headquarters of the firm are in %s.", " Head office: %s; regional offices elsewhere.", " We operate in %s and more.", " Active in many fields, %s too.")


def _seated(id_column: str, text: str):
    kinds = [_planted(id_column, text, s) for s in _SEATS]
    out = kinds[0]
    for k in range(1, len(kinds)):
        out = F.when(F.col(id_column) % len(kinds) == k, kinds[k]).otherwise(out)
    return out


_SEATED_SQL = "CASE " + " ".join(f"WHEN doc_id % {len(_SEATS)} = {k} THEN {_planted_sql('doc_id', 'text', s)}" for k, s in enumerate(_SEATS)) + " END"


def _windows_sql(phrases: tuple[str, ...], width: int) -> str:
    """(doc_id, k, found): the countries of the window after the first place of phrase k."""
    return f"""SELECT doc_id, k, {_found_sql('w')} AS found FROM (SELECT doc_id, k, {_normal(f't[i:i + {width - 1}]')} AS w
      FROM (SELECT doc_id, t, k, instr(lower(t), {_quoted(phrases)}[k]) AS i FROM (SELECT doc_id, {_SEATED_SQL} AS t FROM documents), range(1, {len(phrases) + 1}) r(k)) WHERE i > 0)"""


def _windows(spark, d):
    g = _gazetteer(spark)
    body = table(spark, d, "documents").select("doc_id", _seated("doc_id", "text").alias("body"))
    return body.select("doc_id", g.headquarters(F.col("body")).alias("hq"), F.array_join(F.array_sort(g.presence(F.col("body"))), ",").alias("presence"))


_add(
    "geo_seats_and_presence", _windows,
    f"""WITH h AS ({_windows_sql(gazetteer.HEADQUARTERS, 300)}), p AS ({_windows_sql(gazetteer.PRESENCE, 500)}),
  a AS (SELECT doc_id, arg_min(found[1], k) AS hq FROM h WHERE len(found) > 0 GROUP BY doc_id), b AS (SELECT doc_id, string_agg(DISTINCT c, ',' ORDER BY c) AS presence FROM (SELECT doc_id, unnest(found) AS c FROM p) GROUP BY doc_id)
  SELECT doc_id, coalesce(hq, '') AS hq, coalesce(presence, '') AS presence FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""",
)

# --- names and regions -----------------------------------------------------------------------------------------------------

_ASKED = [*_SPELLED, "Atlantis", "  ", "U.S.A.", "New  York"]
_ASK = f"{_quoted(_ASKED)}[o_orderkey % {len(_ASKED)} + 1]"


def _named(spark, d):
    asked = table(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("o_orderkey") % len(_ASKED) + 1).cast("int")).alias("name"))
    cities = spark.createDataFrame(list(CITIES.items()), "spelling string, country string")
    return gazetteer.resolved(asked, "name", gazetteer.table_of(spark, cities)).select("o_orderkey", "country")


def _names_sql() -> str:
    first: dict[str, str] = {}
    for s, country, _ in _ROWS:
        if s not in places.REGIONS:
            first.setdefault(s, country)
    return f"SELECT o_orderkey, coalesce(c, n) AS country FROM (SELECT o_orderkey, {_normal(_ASK)} AS n FROM orders) LEFT JOIN (SELECT unnest({_quoted(first)}) AS s, unnest({_quoted(first.values())}) AS c) ON s = n"


_add("geo_place_names", _named, _names_sql())
_REGION = f"{_quoted(places.REGIONS)}[doc_id % {len(places.REGIONS) + 1} + 1]"
_add(
    "geo_region_members", lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(gazetteer.members(F.get(F.array(*map(F.lit, places.REGIONS)), (F.col("doc_id") % (len(places.REGIONS) + 1)).cast("int")))).alias("place", "country")),
    f"SELECT doc_id, (unnest(range(len(m))))::INTEGER AS place, unnest(m) AS country FROM (SELECT doc_id, MAP {{{', '.join(f'{_quoted([r])[1:-1]}: {_quoted(m)}' for r, m in places.REGIONS.items())}}}[{_REGION}] AS m FROM documents) WHERE m IS NOT NULL",
)
