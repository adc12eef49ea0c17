"""Filters over results and records: what is dropped, and for what reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seine.functions import domains
from seine.functions.text import text_of

# Terms that tell what is no organisation's own page, terms of papers, and of events.
JUNK_TERMS = (
    "courier", "shipping services", "job opportunities", "vacancy", "wuzzuf", "stock photo",
    "list of companies", "directory", "ranking", "wikipedia", "amazon", "recruitment",
)
ACADEMIC = ("abstract", "doi", "journal", "conference", "paper", "study", "authors")
EVENTS = ("exhibitor", "exhibition", "conference", "booth", "summit", "expo", "agenda", "register")


def directory_title(title: Column) -> Column:
    return F.lower(F.trim(text_of(title))).rlike("|".join(domains.DIRECTORY_TITLES))


def excluded_domain(domain: Column, sites: tuple[str, ...] = domains.EXCLUDED_DOMAINS) -> Column:
    """The domain itself, or one below it."""
    hit = domain.isin(*sites)
    for d in sites:
        hit = hit | domain.endswith(f".{d}")
    return hit


def blob(*columns: str) -> Column:
    """Columns as one lower-cased text, blanks between."""
    return F.lower(F.concat_ws(" ", *[text_of(F.col(c)) for c in columns]))


def junk(text: Column) -> Column:
    return text.rlike("|".join(JUNK_TERMS))


def junk_record(hay: Column, papers: bool = False) -> Column:
    """A record, by its lower-cased text, that is junk; among papers also one without a term of papers."""
    return (junk(hay) | ~hay.rlike("|".join(ACADEMIC))) if papers else junk(hay)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, by order, of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("seine_n", F.row_number().over(w)).filter("seine_n = 1").drop("seine_n")


def capped(df: DataFrame, group: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows, by order, of each group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("seine_n", F.row_number().over(w)).filter(F.col("seine_n") <= most).drop("seine_n")


def reject_reason(least_score: float, exclude_countries: list[str], require_contact: bool = False) -> Column:
    """The first reason that holds, in this order; null for what is kept."""
    outside = F.col("hq_country").isin(*exclude_countries) | F.col("country").isin(*exclude_countries) if exclude_countries else F.lit(False)
    return (
        F.when((F.col("company_name") == "") & (F.col("website") == ""), "missing_identity")
        .when(F.col("is_directory_or_media"), "directory_or_media")
        .when(F.col("page_type").isin("directory", "media", "blog"), "page_type")
        .when(outside, "excluded_country")
        .when(F.lit(require_contact) & (F.col("email") == "") & (F.col("phone") == ""), "missing_contact")
        .when(F.col("confidence_score") < least_score, "low_score")
    )


def refine(df: DataFrame, keep: Column) -> DataFrame:
    """Rows that pass; where none does, all of them."""
    none = df.agg(F.max(keep.cast("int")).alias("seine_any"))
    return df.withColumn("seine_keep", keep).crossJoin(F.broadcast(none)).filter("seine_keep or coalesce(seine_any, 0) = 0").drop("seine_keep", "seine_any")  # one row on the right


def validated(kind: str) -> Column:
    """struct(accepted, score_delta, reasons) of a record by what its kind needs."""
    lists = {
        "company": ((F.col("company_name") != "") | (F.col("website") != ""), "no_identity", F.when((F.col("email") == "") & (F.col("phone") == ""), -5.0).otherwise(0.0)),
        "paper": ((F.col("company_name") != "") | (F.col("description") != ""), "no_title", F.when(F.col("description") == "", -5.0).otherwise(0.0)),
        "person": (F.col("linkedin_url") != "", "no_profile", F.lit(0.0)),
    }
    ok, reason, delta = lists[kind]
    return F.struct(ok.alias("accepted"), delta.cast("double").alias("score_delta"), F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit(reason))).alias("reasons"))


def outside_geography(include: list[str], exclude: list[str], exclude_presence: list[str], strict: bool, body: Column, countries_in) -> Column:
    """Whether a record breaks a request's rules of place: seat or country excluded, a presence excluded in its text, or
    none of the wanted countries in seat, country or text where the request is strict."""
    seats = F.array(F.col("hq_country"), F.col("country"))
    spoken = countries_in(body)
    listed = lambda names: F.array(*[F.lit(n) for n in names])
    out = F.lit(False)
    if exclude:
        out = out | F.arrays_overlap(seats, listed(exclude))
    if exclude_presence:
        out = out | F.arrays_overlap(F.concat(seats, spoken), listed(exclude_presence))
    if include and strict:
        out = out | ~F.arrays_overlap(F.concat(seats, spoken), listed(include))
    return out


def american_path(url: Column) -> Column:
    """A path for the American market on a .com host without one for the world."""
    return url.rlike(r"[.]com/") & url.rlike(r"/(?:us|usa|en-us|united-states)(?:/|$)") & ~url.rlike(r"/(?:global|international|worldwide)(?:/|$)")
