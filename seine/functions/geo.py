"""Column functions over places, against a table of spellings that callers may replace.

The default table holds names, short forms and main cities of some countries; larger ones come as a DataFrame with the
columns (spelling, country).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions.text import bound, clean, text_of

# Own defaults of an early table: spellings of countries, and members of regions. The whole table is that of `gazetteer`.
SPELLINGS = {
    "usa": ("usa", "u.s.a", "united states", "america", "new york", "houston", "texas", "california", "chicago"),
    "uk": ("uk", "united kingdom", "england", "scotland", "wales", "britain", "london", "aberdeen", "manchester"),
    "egypt": ("egypt", "cairo", "alexandria", "giza", "مصر"),
    "saudi arabia": ("saudi arabia", "ksa", "riyadh", "jeddah", "dammam", "السعودية"),
    "uae": ("uae", "united arab emirates", "emirates", "dubai", "abu dhabi", "sharjah", "الامارات"),
    "qatar": ("qatar", "doha"), "kuwait": ("kuwait",), "oman": ("oman", "muscat"), "bahrain": ("bahrain", "manama"), "iraq": ("iraq", "baghdad", "basra"),
    "norway": ("norway", "oslo", "stavanger", "bergen", "trondheim"), "germany": ("germany", "berlin", "munich", "hamburg", "frankfurt"),
    "france": ("france", "paris", "lyon", "marseille"), "spain": ("spain", "madrid", "barcelona"), "italy": ("italy", "rome", "milan"),
    "netherlands": ("netherlands", "holland", "amsterdam", "rotterdam"), "sweden": ("sweden", "stockholm"), "denmark": ("denmark", "copenhagen"),
    "canada": ("canada", "toronto", "calgary", "alberta", "vancouver"), "australia": ("australia", "sydney", "perth", "melbourne"),
    "india": ("india", "mumbai", "delhi", "bangalore"), "china": ("china", "beijing", "shanghai"), "japan": ("japan", "tokyo"),
    "brazil": ("brazil", "sao paulo", "rio de janeiro"), "mexico": ("mexico",), "nigeria": ("nigeria", "lagos", "abuja"), "south africa": ("south africa", "johannesburg", "cape town"),
    "turkey": ("turkey", "istanbul", "ankara"), "singapore": ("singapore",), "malaysia": ("malaysia", "kuala lumpur"), "indonesia": ("indonesia", "jakarta"), "algeria": ("algeria", "algiers"), "libya": ("libya", "tripoli"), "morocco": ("morocco", "casablanca"),
}
REGIONS = {
    "gulf": ("bahrain", "kuwait", "oman", "qatar", "saudi arabia", "uae"),
    "middle east": ("bahrain", "egypt", "iraq", "kuwait", "oman", "qatar", "saudi arabia", "turkey", "uae"),
    "north africa": ("algeria", "egypt", "libya", "morocco"), "scandinavia": ("denmark", "norway", "sweden"),
    "africa": ("algeria", "egypt", "libya", "morocco", "nigeria", "south africa"),
    "europe": ("denmark", "france", "germany", "italy", "netherlands", "norway", "spain", "sweden", "uk"),
    "asia": ("china", "india", "indonesia", "japan", "malaysia", "singapore"),
}


def _word(s: str) -> str:
    return s.replace(".", "[.]")


def countries_in(c: Column, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> Column:
    """Sorted countries whose spelling stands in a text as words of their own.

    A text is cut into words once; a country's pattern is tried only where a first word of its spellings is among them.
    """
    first = {country: sorted({re.split(r"[^\w]+", n)[0] for n in names}) for country, names in spellings.items()}
    every = F.array(*map(F.lit, sorted({w for words in first.values() for w in words})))

    def of(t: Column) -> Column:
        def tried(there: Column) -> Column:
            found = [
                F.when(F.arrays_overlap(there, F.array(*map(F.lit, first[country]))) & t.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(_word, names)) + r")(?![\p{L}\p{N}])"), country)
                for country, names in spellings.items()
            ]
            return F.when(F.size(there) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.array(*found))))

        return bound(F.array_intersect(every, F.split(t, r"[^\p{L}\p{N}]+")), tried)

    return bound(F.lower(text_of(c)), of)


def contains_country(c: Column, country: str, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> Column:
    """Whether a text speaks of a country, by any of its spellings; of one that the table lacks, by its name."""
    low = country.lower()
    known = next((k for k, names in spellings.items() if low == k or low in names), low)
    return F.array_contains(countries_in(c, {known: spellings.get(known, (known,))}), known)


def all_countries(spark: SparkSession, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> DataFrame:
    return spark.createDataFrame([(k,) for k in sorted(spellings)], "country string")


def first_country(c: Column) -> Column:
    """The alphabetically first country of a text; empty if none."""
    return F.coalesce(F.array_min(countries_in(c)), F.lit(""))


def spelling_table(spark: SparkSession, spellings: dict[str, tuple[str, ...]] = SPELLINGS) -> DataFrame:
    return spark.createDataFrame([(s, country) for country, names in spellings.items() for s in (country, *names)], "spelling string, country string").distinct()


def normal_country(df: DataFrame, column: str, spellings: DataFrame, out: str = "country") -> DataFrame:
    """df with the country that a column spells; what no spelling fits passes as it is, lower-cased."""
    key = F.lower(clean(F.col(column)))
    return df.withColumn("seine_key", key).join(spellings.select(F.col("spelling").alias("seine_key"), F.col("country").alias("seine_country")), "seine_key", "left").withColumn(out, F.coalesce("seine_country", "seine_key")).drop("seine_key", "seine_country")


def expand_region(c: Column, regions: dict[str, tuple[str, ...]] = REGIONS) -> Column:
    """Members of a region; none for an unknown name."""
    known = F.create_map(*[x for name, members in regions.items() for x in (F.lit(name), F.array(*map(F.lit, members)))])
    return F.coalesce(F.try_element_at(known, F.lower(clean(c))), F.array().cast("array<string>"))
