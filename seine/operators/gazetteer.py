"""Places found in texts by one pass over each, whatever the number of spellings.

The spellings are a table (spelling, country, strict); the default one holds countries, states, provinces and regions, and
callers add cities or take a table of their own. Up to MOST rows they are built into an automaton (Aho-Corasick) that goes to
the tasks once; every hit is then held against its surroundings. Larger tables are joined with the phrases of the texts
instead, which gives the same for spellings of up to PHRASE words without signs inside them.

A spelling stands for itself as `\\b...\\b` does: where it begins or ends with a letter, digit or underscore, none may stand
before or after it. Strict spellings, codes of two letters, need only lack letters a-z around them.

Defined results: null and empty texts have no places; repeated spellings add up; a text of any length is searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seine.functions import places
from seine.functions.text import bound, text_of

#: Rows of a table of spellings that are broadcast, and words of a phrase beyond that.
MOST, PHRASE = 200_000, 4
SCHEMA = "spelling string, country string, strict boolean"
FOUND = T.ArrayType(T.StringType())
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"\w")


def normal(c: Column) -> Column:
    """Lower case and single blanks; an Arabic name of a region by its English one."""
    plain = F.lower(F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " ")))
    known = F.create_map(*[F.lit(x) for pair in places.ARABIC_REGIONS.items() for x in pair])
    return bound(plain, lambda t: F.coalesce(F.try_element_at(known, t), t))


def default_rows() -> list[tuple[str, str, bool]]:
    """Rows of the default table, in the order in which names are looked up: countries, states and provinces, regions."""
    countries = [(s, country, False) for country, names in places.COUNTRY_ALIASES.items() for s in dict.fromkeys((country, *names))]
    parts = [(s, country, len(s) <= 2) for country, names in (("usa", places.US_STATES), ("canada", places.CANADIAN_PROVINCES), ("australia", places.AUSTRALIAN_STATES)) for s in names]
    return countries + parts + [(region, country, False) for region, members in places.REGIONS.items() for country in members]


def table_of(spark: SparkSession, cities: DataFrame | None = None) -> DataFrame:
    """The default table, with a table of cities (spelling, country) if there is one."""
    own = spark.createDataFrame(default_rows(), SCHEMA)
    return own if cities is None else own.unionByName(cities.select(normal(F.col("spelling")).alias("spelling"), "country", F.lit(False).alias("strict")))


class Matcher:
    """Countries by spellings; built once for each Python worker."""

    def __init__(self, rows: list[tuple[str, str, bool]]):
        members: dict[tuple[str, bool], set[str]] = {}
        for spelling, country, strict in rows:
            if spelling:
                members.setdefault((spelling, strict), set()).add(country)
        self.codes = {s: c for (s, strict), c in members.items() if strict}
        self.automaton = ahocorasick.Automaton()
        for (spelling, strict), countries in members.items():
            if not strict:
                self.automaton.add_word(spelling, (spelling, frozenset(countries), bool(_WORD.match(spelling[0])), bool(_WORD.match(spelling[-1]))))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> set[str]:
        """Countries of a normalised text."""
        if not text:
            return set()
        found: set[str] = set()
        if self.codes:
            for word in set(re.findall("[a-z]+", text)) & self.codes.keys():
                found |= self.codes[word]
        if len(self.automaton):
            for last, (spelling, countries, opens, closes) in self.automaton.iter(text):
                first = last - len(spelling) + 1
                before, after = text[first - 1] if first else "", text[last + 1 : last + 2]
                if not countries <= found and bool(before and _WORD.match(before)) != opens and bool(after and _WORD.match(after)) != closes:
                    found |= countries
        return found


_matchers: dict[int, Matcher] = {}


def _shared(spark: SparkSession, spellings: DataFrame) -> Callable[[], Matcher]:
    rows = [tuple(r) for r in spellings.select("spelling", "country", "strict").distinct().limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} spellings: find places by find_by_phrases")
    sent = spark.sparkContext.broadcast(sorted(rows))

    def matcher() -> Matcher:
        key = hash(tuple(sent.value))
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(sent.value)
        return _matchers[key]

    return matcher


class Gazetteer:
    """Column functions over one table of spellings."""

    def __init__(self, spark: SparkSession, spellings: DataFrame | None = None):
        matcher = _shared(spark, table_of(spark) if spellings is None else spellings)

        @F.pandas_udf(FOUND)
        def found(text: pd.Series) -> pd.Series:
            return text.map(lambda t: sorted(matcher()(t)))

        @F.pandas_udf(T.ArrayType(FOUND))
        def found_in_each(texts: pd.Series) -> pd.Series:
            return texts.map(lambda ts: None if ts is None else [sorted(matcher()(t)) for t in ts])

        self._found, self._each = found, found_in_each

    def countries(self, c: Column) -> Column:
        """Sorted countries that a text speaks of."""
        return self._found(normal(c))

    def first(self, c: Column) -> Column:
        """The alphabetically first of them; empty if none."""
        return F.coalesce(F.get(self.countries(c), F.lit(0)), F.lit(""))

    def in_each(self, texts: Column) -> Column:
        """countries() of each text of an array."""
        return self._each(F.transform(texts, normal))

    def after_phrases(self, c: Column, phrases: tuple[str, ...], width: int) -> Column:
        """For each phrase that a text holds, in the order of phrases, the countries in the `width` characters from where it
        first stands."""
        text = text_of(c)
        at = F.array(*[F.instr(F.lower(text), p) for p in phrases])
        return self.in_each(F.transform(F.filter(at, lambda i: i > 0), lambda i: F.substring(text, i, F.lit(width))))

    def headquarters(self, c: Column) -> Column:
        """The first country after the first phrase of a seat that one follows; empty if none."""
        named = F.filter(self.after_phrases(c, HEADQUARTERS, 300), lambda x: F.size(x) > 0)
        return F.coalesce(F.get(F.get(named, F.lit(0)), F.lit(0)), F.lit(""))

    def presence(self, c: Column) -> Column:
        """Countries after phrases of presence, phrase by phrase, each once."""
        return F.array_distinct(F.flatten(self.after_phrases(c, PRESENCE, 500)))


# Phrases before the country of a seat, and before countries of presence, in the order in which they are tried.
HEADQUARTERS = (
    "headquartered in", "headquartered at", "based in", "our headquarters", "head office", "corporate headquarters",
    "global headquarters", "founded in", "hq in", "hq:",
)
PRESENCE = (
    "offices in", "office locations", "our offices", "global presence", "presence in", "operates in", "serving clients in",
    "regional offices", "our presence", "global offices", "locations worldwide", "we operate in", "active in", "countries we serve",
)


def find_by_phrases(docs: DataFrame, spellings: DataFrame, key: str, text: str, words: int = PHRASE) -> DataFrame:
    """(key, countries) of the rows of docs with any: phrases of up to `words` words joined with a table of any size.

    What travels is a hash join on phrases that occur; a phrase that many texts hold is made distinct in each text first.
    """
    cut = docs.select(F.col(key).alias(key), F.filter(F.split(normal(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("w"))
    held = cut.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col("w")) for n in range(1, words + 1)])).alias("of"))
    runs = F.transform(F.sequence(F.lit(1), F.size("of.w") - F.col("of.n") + 1), lambda i: F.array_join(F.slice(F.col("of.w"), i, F.col("of.n")), " "))
    each = held.filter(F.size("of.w") >= F.col("of.n")).select(key, F.explode(F.array_distinct(runs)).alias("spelling"))
    return each.join(spellings.select("spelling", "country").distinct(), "spelling").groupBy(key).agg(F.array_sort(F.collect_set("country")).alias("countries"))


def resolved(df: DataFrame, column: str, spellings: DataFrame, out: str = "country") -> DataFrame:
    """df with the country that a column names: a spelling's, countries before states before cities; what no spelling fits passes
    as it is, normalised. Regions have several members and name no country."""
    one = spellings.withColumn("seine_order", F.monotonically_increasing_id()).groupBy(F.col("spelling").alias("seine_key")).agg(F.min_by("country", "seine_order").alias("seine_country"), F.countDistinct("country").alias("seine_n"))
    known = one.filter(~F.col("seine_key").isin(*places.REGIONS)).drop("seine_n")
    return df.withColumn("seine_name", normal(F.col(column))).join(known, F.col("seine_name") == F.col("seine_key"), "left").withColumn(out, F.coalesce("seine_country", "seine_name")).drop("seine_key", "seine_name", "seine_country")


def members(c: Column) -> Column:
    """The members of a region, in their order; none for an unknown name."""
    known = F.create_map(*[x for name, of in places.REGIONS.items() for x in (F.lit(name), F.array(*map(F.lit, of)))])
    return F.coalesce(F.try_element_at(known, normal(c)), F.array().cast("array<string>"))
