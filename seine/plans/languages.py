"""Terms in both languages, by a table of groups: a glossary, countries with their spellings, cities with their country, and
regions with their first members.

Defined results: a blank term has no variants; a term that no group holds is its only one; variants that differ in case or
Arabic spelling alone count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions import places
from seine.functions.text import bound, clean, normal

# English terms and their Arabic ones.
GLOSSARY = {
    "company": ("شركة", "شركات"), "companies": ("شركات",), "paper": ("بحث", "ورقة علمية"), "papers": ("أبحاث", "ابحاث", "دراسات"), "people": ("أشخاص", "كوادر"), "profile": ("ملف شخصي",),
    "service company": ("شركة خدمات", "شركات خدمات"), "software company": ("شركة برمجيات", "شركة تقنية", "شركة رقمية"), "oil and gas": ("النفط والغاز", "البترول"), "energy": ("الطاقة",),
    "research": ("بحث", "أبحاث", "دراسة"), "find": ("ابحث", "ابحث عن", "اعثر على"), "egypt": ("مصر",), "saudi arabia": ("السعودية", "المملكة العربية السعودية"),
    "united arab emirates": ("الإمارات", "الامارات", "الإمارات العربية المتحدة"), "wireline": ("وايرلاين",), "well logging": ("تسجيل الآبار", "قياسات الآبار"), "machine learning": ("تعلم الآلة",),
    "artificial intelligence": ("ذكاء اصطناعي",),
}
ARAB_MARKETS = ("egypt", "saudi arabia", "united arab emirates", "qatar", "oman", "kuwait", "bahrain", "iraq", "jordan", "lebanon")
#: Members of a region that stand for it.
MEMBERS = 5
SCHEMA = "kind int, number int, cue string, place int, term string"


def default_groups(cities: dict[str, str] | None = None) -> list[tuple[int, int, str, int, str]]:
    """(kind, number, cue, place, term): each cue of a group finds all its terms. An English entry is a cue before the Arabic
    words that several entries share; kinds come in the order in which their variants do."""
    out = []
    for k, (english, arabic) in enumerate(GLOSSARY.items()):
        out += [(0, -1, english, i, t) for i, t in enumerate(arabic)]
        out += [(0, k, cue, i, t) for cue in arabic for i, t in enumerate((english, *arabic))]
    for k, (country, names) in enumerate(places.COUNTRY_ALIASES.items()):
        every = (country, *names)
        out += [(1, k, cue, i, t) for cue in every for i, t in enumerate(every)]
    for k, (city, country) in enumerate((cities or {}).items()):
        out += [(2, k, city, i, t) for i, t in enumerate((city, country))]
    for k, (region, members) in enumerate(places.REGIONS.items()):
        out += [(3, k, region, i, t) for i, t in enumerate((region, *members[:MEMBERS]))]
    return out


def groups(spark: SparkSession, cities: dict[str, str] | None = None) -> DataFrame:
    """The table of groups, by normal cues; of a cue's groups of a kind the first counts."""
    rows = spark.createDataFrame(default_groups(cities), SCHEMA).withColumn("cue", normal(F.col("cue")))
    first = rows.groupBy("cue", "kind").agg(F.min("number").alias("number"))
    return rows.join(first, ["cue", "kind", "number"]).distinct()


def _once(terms: Column) -> Column:
    """Filled terms whose normal form did not come before."""
    filled = F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")
    return bound(filled, lambda ts: bound(F.transform(ts, normal), lambda keys: F.filter(ts, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1)))


def variants(rows: DataFrame, key: str, terms: str, known: DataFrame) -> DataFrame:
    """(key, variants): all variants of a row's terms, an array, in their order, each once."""
    at = rows.select(F.col(key), F.monotonically_increasing_id().alias("seine_row"), terms)
    each = at.select(key, "seine_row", F.posexplode_outer(terms).alias("n", "term")).withColumn("cue", normal(F.col("term")))
    met = each.join(known.withColumnRenamed("term", "other"), "cue", "left")
    own = F.filter(F.array_sort(F.collect_set(F.struct("kind", "place", "other"))), lambda x: x["other"].isNotNull())
    of_term = met.groupBy(key, "seine_row", "n").agg(F.first("term").alias("term"), own.alias("found"))
    flat = of_term.select(key, "seine_row", F.struct("n", F.concat(F.array(clean(F.col("term"))), F.transform("found", lambda x: x["other"])).alias("all")).alias("t"))
    folded = flat.groupBy(key, "seine_row").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return folded.select(key, _once(F.flatten(F.transform("ts", lambda x: x["all"]))).alias("variants"))


def query_languages(spoken: Column, countries: Column) -> Column:
    """Languages to ask in: those of the request, and both where an Arab market is asked for."""
    both = F.when(F.arrays_overlap(F.transform(F.coalesce(countries, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c))), F.array(*map(F.lit, ARAB_MARKETS))), F.array(F.lit("en"), F.lit("ar")))
    return F.array_distinct(F.concat(spoken, F.coalesce(both, F.array().cast("array<string>"))))
