"""Searches for people: titles by level, and queries of titles, places and providers.

Defined results: null levels and places count as none; without a level that is known some titles of engineers, managers and
recruiters are asked for; without places queries name none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import labels
from seine.functions.text import bound, first_of_each, text_of

# Titles by level, in the order in which levels are tried, and how countries are named in queries.
TITLES = {
    "engineer": ("Petroleum Engineer", "Reservoir Engineer", "Drilling Engineer", "Production Engineer"),
    "manager": ("Operations Manager", "Project Manager", "Engineering Manager", "Maintenance Manager"),
    "director": ("Director", "Technical Director", "Operations Director", "Managing Director"),
    "hr": ("HR Manager", "Human Resources Manager", "Talent Acquisition Manager", "Recruitment Manager"),
    "executive": ("CEO", "Chief Executive Officer", "COO", "Chief Operating Officer"),
    "research": ("Research Scientist", "Research Engineer", "Principal Scientist", "Professor"),
    "sales": ("Sales Manager", "Sales Director", "Business Development Director", "Regional Sales Manager"),
}
USUAL = (*TITLES["engineer"][:3], *TITLES["manager"][:3], *TITLES["hr"][:2])
PLACES = {
    "egypt": ("Egypt", "Cairo"), "saudi arabia": ("Saudi Arabia", "Riyadh"), "united arab emirates": ("UAE", "Dubai"), "qatar": ("Qatar", "Doha"), "oman": ("Oman", "Muscat"), "kuwait": ("Kuwait", "الكويت"),
    "bahrain": ("Bahrain", "البحرين"), "iraq": ("Iraq", "Basra"), "norway": ("Norway", "Stavanger"), "united kingdom": ("United Kingdom", "Aberdeen"), "united states": ("United States", "Houston"),
    "canada": ("Canada", "Calgary"), "australia": ("Australia", "Perth"), "india": ("India", "Mumbai"), "germany": ("Germany", "Berlin"), "netherlands": ("Netherlands", "Amsterdam"),
    "france": ("France", "Paris"), "brazil": ("Brazil", "Rio de Janeiro"), "nigeria": ("Nigeria", "Lagos"), "angola": ("Angola", "Luanda"), "indonesia": ("Indonesia", "Jakarta"), "malaysia": ("Malaysia", "Kuala Lumpur"),
}


def _table(rows: dict[str, tuple[str, ...]]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).alias("of")) for k, v in rows.items()])


def titles(levels: Column) -> Column:
    """Titles of levels, four of each level that is part of an asked one or has it as a part, each title once."""
    none = F.array().cast("array<string>")
    of = lambda level: F.coalesce(F.get(F.filter(_table(TITLES), lambda t: level.contains(t["key"]) | t["key"].contains(level)), F.lit(0))["of"], none)
    found = F.flatten(F.transform(F.coalesce(levels, none), lambda x: bound(F.lower(x), of)))
    return bound(found, lambda f: F.when(F.size(f) == 0, F.array(*map(F.lit, USUAL))).otherwise(first_of_each(f)))


def places(countries: Column) -> Column:
    """Two names of the places asked for; an unknown country by its own name."""
    none = F.array().cast("array<string>")
    of = lambda c: F.coalesce(F.get(F.filter(_table(PLACES), lambda t: t["key"] == F.lower(c)), F.lit(0))["of"], F.array(F.initcap(c)))
    return F.slice(F.flatten(F.transform(F.coalesce(countries, none), of)), 1, 2)


def queries(tasks: DataFrame, key: str, with_search: Column) -> DataFrame:
    """(key, provider, priority, query) of tasks (key, topic, levels, countries, max_results): titles by places for a semantic
    search, levels by places after them, profiles for a search engine where `with_search`, and some for another."""
    t = tasks.select(
        F.col(key), text_of(F.col("topic")).alias("topic"), F.coalesce("levels", F.array().cast("array<string>")).alias("levels"), places(F.col("countries")).alias("geo"),
        F.slice(titles(F.col("levels")), F.lit(1), F.greatest(F.lit(3), F.floor(F.col("max_results") / 8).cast("int"))).alias("titles"), with_search.alias("search"),
    )
    geo = F.when(F.size("geo") == 0, F.array(F.lit(""))).otherwise(F.col("geo"))
    topic = F.col("topic")
    inside = lambda g: F.when(g == "", "").otherwise(F.concat(F.lit(" in "), g))
    quoted = lambda g: F.when(g == "", "").otherwise(F.concat(F.lit(' "'), g, F.lit('"')))
    site = lambda x, g: F.concat(F.lit('site:linkedin.com/in "'), x, F.lit('" "'), topic, F.lit('"'), quoted(g))
    each = lambda array, make: F.flatten(F.transform(array, lambda x: F.transform(geo, lambda g: make(x, g))))
    by = lambda provider, array: F.transform(array, lambda q: F.struct(F.lit(provider).alias("provider"), q.alias("query")))
    named = each(F.col("titles"), lambda x, g: F.concat(x, F.lit(" working at "), topic, F.lit(" company"), inside(g)))
    ranked = each(F.slice("levels", 1, 3), lambda x, g: F.concat(labels.level(x), F.lit(" professional with experience in "), topic, inside(g)))
    searched = F.when(F.col("search"), each(F.slice("titles", 1, 8), site)).otherwise(F.array().cast("array<string>"))
    plain = F.transform(F.slice("titles", 1, 4), lambda x: site(x, F.get(geo, F.lit(0))))
    every = F.concat(by("exa", named), by("exa", ranked), by("serpapi", searched), by("ddg", plain))
    return t.select(key, F.posexplode(every).alias("n", "q")).select(key, "q.provider", (F.col("n") + 1).alias("priority"), "q.query")
