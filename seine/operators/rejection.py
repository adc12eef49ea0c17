"""Why a record is rejected: the first reason that holds, in the order of the rules; null for what is kept.

Of people only their profiles count. Others go for a low score (unless a reviewer ranks them 8 or more of 10), as a directory
or media (below 7), by a title of a list (below 8), by place, and as known already. Known records are those with the domain of
an indexed one or with a name similar to one's; they are found by joins (`known`), so the rules themselves are one expression.

Defined results: null fields count as blank; a record without a note has rank 0; lists of places are lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import domains, names, urls
from seine.functions.text import text_of
from seine.operators import filters
from seine.operators.namejoin import similar_pairs
from seine.session import scratch, stored


@dataclass
class Wanted:
    """What a request asks for, as far as it rejects."""

    task_type: str = "entity_discovery"
    least_score: int = 35
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    exclude_presence: list[str] = field(default_factory=list)
    strict: bool = False


# Phrases of a seat by country, and paths of an American site.
SEATS = {
    "usa": (
        "headquartered in the usa", "headquartered in the united states", "based in the us", "us-based company", "american company",
        ", texas", "abilene, tx", "houston, tx", "plano, tx", "the woodlands, tx",
    ),
    "egypt": ("headquartered in egypt", "based in egypt", "egyptian company", "cairo-based"),
}
AMERICAN = ("/en-us/", "/us/en/", "/us-en/")


def _any(text: Column, pieces) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | text.contains(p)
    return out


def rank(notes: Column) -> Column:
    """The rank that a reviewer left in the notes; 0 without one."""
    return F.coalesce(F.regexp_extract(text_of(notes), r"llm_rank:(\d+)/10", 1).try_cast("int"), F.lit(0))


def outside(want: Wanted, columns) -> Column:
    """Whether a record breaks the rules of place."""
    low = lambda c: F.lower(F.trim(text_of(F.col(c)))) if c in columns else F.lit("")
    seat, country, domain = low("hq_country"), low("country"), low("domain")
    none = F.array().cast("array<string>")
    presence = F.transform(F.coalesce(F.col("presence_countries"), none), lambda p: F.lower(F.trim(p))) if "presence_countries" in columns else none
    url, told = F.when(low("website") != "", low("website")).otherwise(low("source_url")), F.concat_ws(" ", low("company_name"), low("description"))
    exclude, absent, include = ([c.lower() for c in x] for x in (want.exclude, want.exclude_presence, want.include))
    unknown, out = (seat == "") & (country == ""), F.lit(False)
    if exclude:
        out = out | seat.isin(*exclude) | country.isin(*exclude)
        known = (domains.KNOWN_USA_DOMAINS if "usa" in exclude else ()) + (domains.KNOWN_EGYPT_DOMAINS if "egypt" in exclude else ())
        if known:
            out = out | domain.isin(*known)
        if "usa" in exclude:
            out = out | (unknown & _any(url, AMERICAN))
        out = out | (unknown & _any(told, [p for c in exclude for p in SEATS.get(c, (f"headquartered in {c}", f"based in {c}"))]))
    if absent:
        out = out | F.arrays_overlap(presence, F.array(*map(F.lit, absent)))
        for c, flag in (("usa", "has_usa_presence"), ("egypt", "has_egypt_presence")):
            if c in absent and flag in columns:
                out = out | F.coalesce(F.col(flag), F.lit(False))
    if include and want.strict:
        matched = seat.isin(*include) | country.isin(*include) | F.arrays_overlap(presence, F.array(*map(F.lit, include)))
        out = out | ((~unknown | (F.size(presence) > 0)) & ~matched)
    return F.coalesce(out, F.lit(False))


def reason(want: Wanted, columns, known: Column | None = None) -> Column:
    """The first reason; known: whether a record is in the index already."""
    low = lambda c: F.lower(F.trim(text_of(F.col(c)))) if c in columns else F.lit("")
    if want.task_type == "people_search":
        url = F.when(low("linkedin_url") != "", low("linkedin_url")).when(low("linkedin_profile") != "", low("linkedin_profile")).otherwise(low("website"))
        nobody = (low("company_name") == "") & (low("job_title") == "")
        return F.when(urls.is_company_profile(url), "linkedin_company_page").when(~(url.contains("linkedin.com") & urls.is_profile(url)), "not_linkedin_profile").when(nobody, "no_person_info")
    ranked = rank(F.col("notes")) if "notes" in columns else F.lit(0)
    score = F.col("confidence_score")
    rules = F.when((score < want.least_score) & (ranked < 8), F.format_string(f"low_confidence(%.0f<{want.least_score})", score.cast("double")))
    rules = rules.when(F.col("is_directory_or_media") & (ranked < 7), "directory_or_media")
    if want.task_type != "document_research":
        rules = rules.when(filters.directory_title(F.col("company_name")) & (ranked < 8), "directory_or_media")
    rules = rules.when(outside(want, columns), "geography_violation")
    return rules.when(known, "duplicate") if known is not None else rules


def known(records: DataFrame, index: DataFrame) -> DataFrame:
    """(seq) of records with the domain of an indexed record, or a name similar to one's. Profiles' sites are nobody's domain."""
    with scratch() as keep:
        keys = [F.lower(text_of(F.col("domain"))).alias("domain"), names.clean_name(F.col("company_name")).alias("clean"), names.acronym(F.col("company_name")).alias("short")]
        held, asked = stored(index.select(*keys).distinct(), "index"), stored(records.select("seq", *keys), "asked")
        by_domain = asked.filter("domain <> '' and not contains(domain, 'linkedin.com')").join(held.select("domain").distinct(), "domain", "left_semi").select("seq")
        names_of = lambda df, fresh: df.filter("clean <> ''").select("clean", "short", F.lit(fresh).alias("fresh"))
        every = stored(names_of(held, False).unionByName(names_of(asked, True)).groupBy("clean").agg(F.max("short").alias("short"), F.min(F.col("fresh").cast("int")).alias("new")).withColumn("id", F.monotonically_increasing_id()), "every")
        pairs = similar_pairs(every.select("id", "clean", "short", (F.col("new") == 1).alias("fresh")), fresh="fresh", across=True)
        new = every.select("id", "clean", "new")
        met = pairs.join(new.toDF("a", "ca", "na"), "a").join(new.toDF("b", "cb", "nb"), "b").filter("na <> nb").select(F.when(F.col("na") == 1, F.col("ca")).otherwise(F.col("cb")).alias("clean"))
        same = met.unionByName(every.filter("new = 0").select("clean")).distinct()
        by_name = asked.filter("not contains(domain, 'linkedin.com')").join(same, "clean", "left_semi").select("seq")
        return keep(by_domain.unionByName(by_name).distinct(), "known")


def rejected(records: DataFrame, want: Wanted, index: DataFrame | None = None) -> DataFrame:
    """records with `reason`."""
    if index is None:
        return records.withColumn("reason", reason(want, records.columns))
    marked = records.join(known(records, index).withColumn("seine_known", F.lit(True)), "seq", "left")
    return marked.withColumn("reason", reason(want, records.columns, F.coalesce("seine_known", F.lit(False)))).drop("seine_known")
