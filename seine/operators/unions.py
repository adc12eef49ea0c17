"""Ordered unions, votes and what is new: over lists in a row, plans of queries, and profiles of people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import names, text, urls
from seine.operators import filters, resolve

# Own defaults for categories, and fixed values for intents: words that speak for them.
CATEGORY_ALIASES = {
    "service_company": ("contractor", "engineering services", "maintenance", "field services"),
    "software_company": ("software", "saas", "platform", "analytics", "automation", "cloud"),
}
INTENT_ALIASES = {
    "agent_or_distributor": ("agent", "agency", "distributor", "distribution", "representative", "representation", "local representative", "وكيل", "توكيل", "موزع", "توزيع", "ممثل محلي"),
    "reseller": ("reseller", "resellers", "إعادة بيع", "ريسيلر"), "partner": ("partner", "partners", "channel partner", "alliance", "شريك", "شراكة"),
    "recruiting": ("hire", "hiring", "recruit", "recruitment", "وظائف", "توظيف"), "competitor_research": ("competitor", "competition", "منافس", "منافسين"),
    "supplier_discovery": ("supplier", "supplier discovery", "مورد", "مورّد"), "academic": ("research", "academic", "literature", "أكاديمي", "بحثي"),
}
SEVERITIES = ("fatal", "major", "minor")


def ordered_union(*lists: Column) -> Column:
    """Stripped, filled items of the lists, the first of equals, in order."""
    whole = F.flatten(F.array_compact(F.array(*lists)))
    return F.array_distinct(F.filter(F.transform(whole, lambda x: F.trim(text.text_of(x))), lambda x: x != ""))


def without_repeats(body: Column) -> Column:
    """A text's sentences without those that equal the one before."""
    return text.bound(text.sentences(body), lambda s: F.array_join(F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))), " "))


def voted(body: Column, aliases: dict[str, tuple[str, ...]], none: str = "general") -> Column:
    """The class with the most aliases in a text, the alphabetically first of equals; `none` where none stands there."""
    low = F.lower(text.text_of(body))
    votes = F.array(*[F.struct((-text.hits(low, list(words))).alias("against"), F.lit(name).alias("name")) for name, words in aliases.items()])
    return text.bound(F.array_min(votes), lambda best: F.when(best["against"] < 0, best["name"]).otherwise(none))


def occurrences(body: Column, words: tuple[str, ...] = SEVERITIES) -> list[Column]:
    """How often each word stands in a text, one column for each."""
    return [F.regexp_count(F.lower(text.text_of(body)), F.lit(w)).cast("long").alias(w) for w in words]


def list_clusters(df: DataFrame, field: Column) -> DataFrame:
    """(cluster, n): a row counts for every item of its list; blank items and empty lists as Unknown."""
    item = df.select(F.explode_outer(field).alias("item"))
    name = F.trim(text.text_of(F.col("item")))
    return item.groupBy(F.when(name == "", "Unknown").otherwise(name).alias("cluster")).agg(F.count("*").alias("n"))


def profile_key(url: Column) -> Column:
    """A profile's address in lower case, without slashes at its end."""
    return F.regexp_replace(F.lower(F.trim(text.text_of(url))), "/+$", "")


def new_profiles(found: DataFrame, known: DataFrame, url: str, name: str, order: list[str]) -> DataFrame:
    """The first row of each profile that is not known by address or by name; rows without an address are dropped."""
    keyed = found.withColumn("seine_url", profile_key(F.col(url))).filter("seine_url <> ''").withColumn("seine_name", names.name_key(F.col(name)))
    first = filters.keep_first(keyed, ["seine_url"], order)
    by_url = known.select(profile_key(F.col(url)).alias("seine_url")).filter("seine_url <> ''").distinct()
    by_name = known.select(names.name_key(F.col(name)).alias("seine_name")).filter("seine_name <> ''").distinct()
    return first.join(by_url, "seine_url", "left_anti").join(by_name, "seine_name", "left_anti").drop("seine_url", "seine_name")


def people(df: DataFrame, employer: Column) -> DataFrame:
    """People as merged records: of rows with one address the first stays, then those with one name and employer merge."""
    site = urls.normal_url(text.first_filled(F.col("linkedin_url"), F.col("website")))
    keyed = df.withColumn("seine_site", F.when(site != "", site).otherwise(F.concat(F.lit("\x00"), F.col("seq").cast("string"))))
    first = filters.keep_first(keyed, ["seine_site"], ["seq"]).drop("seine_site")
    pair = F.concat(names.name_key(F.col("company_name")), F.lit("|"), names.name_key(employer))
    return resolve.merge(first, F.when(pair != "|", pair).otherwise(""))


def new_queries(planned: DataFrame, extra: DataFrame, most: int) -> DataFrame:
    """(provider, seq, text): of extra queries that a provider's plan does not hold, the first of each text, `most` at
    most for each provider. Texts are compared stripped and in lower case; blank ones are dropped."""
    fold = F.lower(F.trim(text.text_of(F.col("text"))))
    fresh = extra.withColumn("seine_key", fold).filter("seine_key <> ''")
    unseen = fresh.join(planned.select("provider", fold.alias("seine_key")).distinct(), ["provider", "seine_key"], "left_anti")
    return filters.capped(filters.keep_first(unseen, ["provider", "seine_key"], ["seq"]), ["provider"], ["seq"], most).select("provider", "seq", "text")


def plan_issues(queries: DataFrame, plan: str, countries: list[str], keywords: list[str]) -> DataFrame:
    """(plan, n, geo_hits, domain_hits, issues) of plans' query texts; an issue is something wanted that no query names."""
    low = F.lower(text.text_of(F.col("text")))
    counted = queries.groupBy(plan).agg(F.count("*").alias("n"), F.count_if(text.contains_any(low, countries)).alias("geo_hits"), F.count_if(text.contains_any(low, keywords)).alias("domain_hits"))
    missing = [F.when(F.lit(bool(wanted)) & (F.col(hits) == 0), name) for wanted, hits, name in ((countries, "geo_hits", "missing_geo_in_queries"), (keywords, "domain_hits", "missing_domain_keywords"))]
    return counted.withColumn("issues", F.concat_ws(",", *missing))


def remaining(asked: DataFrame, calls: DataFrame, by: str, caps: dict[str, int]) -> DataFrame:
    """(by, remaining): calls left to each asked provider; none to those without a cap."""
    used = calls.groupBy(by).agg(F.count("*").alias("used"))
    cap = F.lit(0)
    for name, most in caps.items():
        cap = F.when(F.col(by) == name, most).otherwise(cap)
    return asked.select(by).distinct().join(used, by, "left").select(by, F.greatest(F.lit(0), cap - F.coalesce("used", F.lit(0))).cast("long").alias("remaining"))
