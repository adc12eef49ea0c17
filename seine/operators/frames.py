"""What is shown and handed out of records, and which companies are shown at all.

Frames are projections: fields fall back on others, blanks and spelled-out nothings count as empty. A company is shown unless
its address, its text or the request speaks against it; places are looked for by patterns in the record's text.

Defined results: columns that records lack count as blank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import urls
from seine.functions.text import clean, is_blank, text_of

# What speaks against a company, and for a kind of company.
BAD_HOSTS = (
    "wikipedia.org", "facebook.com", "instagram.com", "youtube.com", "x.com", "twitter.com", "companiesmarketcap.com", "worldpopulationreview.com", "alamy.com", "shutterstock.com",
)
BAD_PATHS = ("/news/", "/blog/", "/article/", "/articles/", "/wiki/")
BAD_TEXTS = ("top oil and gas companies", "largest oil and gas companies", "market cap", "stock photo", "directory", "list of companies", "ranking")
OF_LISTS = ("top", "best", "largest", "ranking", "list")
DIGITAL = ("software", "platform", "saas", "analytics", "automation", "digital", "ai", "iot", "scada", "monitoring", "optimization", "data platform", "cloud")
SERVICE = (
    "service", "services", "contractor", "engineering", "inspection", "maintenance", "wireline", "slickline", "logging", "well intervention", "coiled tubing",
    "testing", "instrumentation", "automation", "pipeline", "integrity", "oilfield", "petroleum services", "production services", "drilling services",
)
COMPANYISH = ("company", "vendor", "provider", "technology", "solutions", "platform", "software", "services")
FOOD = ("food", "food processing", "food manufacturing", "beverage")
WELLS, OF_WELLS = ("wireline", "slickline", "well logging"), ("wireline", "slickline", "well logging", "open hole", "cased hole", "perforation")
# Patterns of a country in a record's text; other countries by their names.
EVIDENCE = {
    "egypt": (r"\begypt\b", r"\begyptian\b", r"مصر", r"القاهرة", r"الاسكندرية", r"\bcairo\b", r"\balexandria\b", r"\bsuez\b", r"\bport said\b", r"\b6th of october\b", r"\bnew cairo\b", r"\+20\b", r"\.eg\b"),
    "united arab emirates": (r"\buae\b", r"\bunited arab emirates\b", r"\bdubai\b", r"\babudhabi\b", r"\babu dhabi\b", r"\bsharjah\b", r"\.ae\b"),
    "united kingdom": (r"\buk\b", r"\bu\.k\.\b", r"\bunited kingdom\b", r"\bengland\b", r"\bscotland\b", r"\bwales\b", r"\blondon\b", r"\.uk\b"),
    "united states": (r"\busa\b", r"\bu\.s\.a\.\b", r"\bunited states\b", r"\bhouston\b", r"\.us\b"),
    "norway": (r"\bnorway\b", r"\bnorwegian\b", r"\boslo\b", r"\bstavanger\b", r"\.no\b"),
    "saudi arabia": (r"\bsaudi arabia\b", r"\bsaudi\b", r"\bdammam\b", r"\bdhahran\b", r"\bal khobar\b", r"\.sa\b"),
    "qatar": (r"\bqatar\b", r"\bdoha\b", r"\.qa\b"),
    "oman": (r"\boman\b", r"\bmuscat\b", r"\.om\b"),
    "kuwait": (r"\bkuwait\b", r"\.kw\b"),
    "bahrain": (r"\bbahrain\b", r"\.bh\b"),
}
TEXT = ("company_name", "description", "summary", "snippet", "website", "url", "linkedin_url", "hq_country", "presence_countries", "country", "location", "city", "title")
LABELS = {
    "entity_discovery": "Companies", "document_research": "Academic Papers", "people_search": "LinkedIn Profiles", "market_research": "Market Research", "entity_enrichment": "Enrichment",
    "similar_entity_expansion": "Similar Entities",
}
CATEGORIES = {"software_company": "Digital / software companies", "service_company": "Service / engineering companies", "general": "General results"}
ENDINGS = (".xlsx", ".csv", ".json", ".pdf", ".docx", ".doc")


class Fields:
    """Columns of records by name, cleaned; those that are not there are empty."""

    def __init__(self, columns):
        self.columns = set(columns)

    def __call__(self, *names: str) -> Column:
        """The first filled of these."""
        own = [F.when(~is_blank(F.col(n)), F.nullif(clean(F.col(n)), F.lit(""))) for n in names if n in self.columns]
        return F.coalesce(*own, F.lit(""))

    @property
    def name(self) -> Column:
        return self("company_name", "title")

    @property
    def link(self) -> Column:
        return self("website", "source_url")

    @property
    def summary(self) -> Column:
        return self("summary", "description", "snippet", "notes", "abstract")


def shown(records: DataFrame, kind: str, key: str = "seq") -> DataFrame:
    """The columns that are shown of papers, persons or companies; summaries are cut."""
    f = Fields(records.columns)
    shapes = {
        "paper": {"title": f.name, "link": f.link, "authors": f("authors"), "year": f("publication_year"), "summary": F.substring(f.summary, 1, 320)},
        "person": {
            "name": f.name, "link": f("linkedin_profile", "linkedin_url", "website"), "employer": f("employer_name"), "job_title": f("job_title"), "location": f("city", "country"),
            "summary": F.substring(f.summary, 1, 260),
        },
        "company": {"name": f.name, "link": f.link, "email": f("email"), "phone": f("phone"), "linkedin": f("linkedin_profile", "linkedin_url"), "summary": F.substring(f.summary, 1, 240)},
    }
    return records.select(key, *[v.alias(k) for k, v in shapes[kind].items()])


def handed_out(records: DataFrame, people: bool, key: str = "seq") -> DataFrame:
    """The columns of an export; of people the profile is the link, if there is one."""
    f = Fields(records.columns)
    profile = f("linkedin_profile", "linkedin_url")
    link = F.when(F.lit(people) & (profile != ""), profile).otherwise(f.link)
    return records.select(key, f.name.alias("name"), link.alias("link"), f("email").alias("email"), f("phone").alias("phone"), profile.alias("linkedin"), f.summary.alias("summary"))


def paper_summaries(records: DataFrame, key: str = "seq") -> DataFrame:
    f = Fields(records.columns)
    title = F.when(f.name != "", f.name).otherwise("Untitled")
    return records.select(key, title.alias("title"), f.link.alias("link"), f("authors").alias("authors"), f("publication_year").alias("year"), f("doi").alias("doi"), f.summary.alias("summary"))


def markdown(records: DataFrame, columns: list[str], key: str = "seq") -> DataFrame:
    """(key, line): a record's row of a table in Markdown."""
    f = Fields(records.columns)
    return records.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(f(c), F.lit("|"), F.lit("/")) for c in columns]), F.lit(" |")).alias("line"))


def task_label(code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), text_of(code)), F.lit("Results"))


def category_label(code: Column) -> Column:
    own = F.coalesce(F.nullif(text_of(code), F.lit("")), F.lit("general"))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p]), F.trim(own)), F.initcap(F.replace(own, F.lit("_"), F.lit(" "))))


def file_name(name: Column, ending: Column) -> Column:
    """A file's name with an ending in place of the one it has."""
    own = F.coalesce(F.nullif(F.trim(text_of(name)), F.lit("")), F.lit("results"))
    return F.concat(F.regexp_replace(own, "(?i)(?:" + "|".join(e.replace(".", "[.]") for e in ENDINGS) + ")$", ""), ending)


@dataclass
class Asked:
    """What a request asks of the companies that are shown."""

    category: str = "general"
    industry: str = ""
    domain_keywords: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    exclude_presence: list[str] = field(default_factory=list)
    strict: bool = False

    @property
    def needs_place(self) -> bool:
        """Whether a record must speak of a wanted country: where places are strict, and Egypt or at most two are wanted."""
        return self.strict and bool(self.include) and ("egypt" in [c.lower() for c in self.include] or len(self.include) <= 2)


def text(columns) -> Column:
    """All that a record says, lower-cased."""
    f = Fields(columns)
    parts = [F.nullif(F.array_join("presence_countries", " ") if n == "presence_countries" else f(n), F.lit("")) for n in TEXT if n in f.columns]
    return F.lower(clean(F.concat_ws(" ", *parts)))


def _any(hay: Column, pieces) -> Column:
    out = F.lit(False)
    for p in pieces:
        out = out | hay.contains(p)
    return out


def patterns(countries: list[str]) -> str:
    """One pattern of what speaks of any of these countries."""
    return "|".join(p for c in countries for p in EVIDENCE.get(c.lower(), (rf"\b{re.escape(c.lower())}\b",)))


def speaks_of(hay: Column, countries: list[str]) -> Column:
    """Whether a record's text speaks of any of these countries; of none if there are none."""
    return hay.rlike(patterns(countries)) if countries else F.lit(False)


def valid_company(columns, asked: Asked, hay: Column) -> Column:
    """Whether a company is shown. hay: text() of the record."""
    f = Fields(columns)
    name, website = f("company_name"), f("website", "url")
    path = F.lower(F.regexp_extract(website, r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*(/[^?#]*)", 1))
    ok = ((name != "") | (website != "")) & ~_any(urls.host(website), BAD_HOSTS) & ~_any(path, BAD_PATHS) & ~_any(hay, BAD_TEXTS)
    ok = ok & ~((F.size(F.filter(F.split(name, r"\s+"), lambda w: w != "")) > 10) & _any(hay, OF_LISTS))
    firm = (website != "") | _any(hay, COMPANYISH)
    if asked.category == "software_company":
        ok = ok & _any(hay, DIGITAL) & firm
        if asked.industry == "food manufacturing":
            ok = ok & _any(hay, FOOD)
    if asked.category == "service_company":
        ok = ok & _any(hay, SERVICE) & firm
        if set(asked.domain_keywords) & set(WELLS):
            ok = ok & _any(hay, OF_WELLS)
    if asked.needs_place:
        ok = ok & speaks_of(hay, asked.include)
    ok = ok & ~speaks_of(hay, asked.exclude_presence) & ~speaks_of(hay, asked.exclude)
    return F.coalesce(ok, F.lit(False))


def merged_hints(packs: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, kind, n, value): the hints of the packs chosen for each key, pack after pack, each value of a kind once.

    packs: (pack, kind, place, value); chosen: (key, pack, rank).
    """
    met = chosen.join(packs, "pack").withColumn("value", F.trim("value")).filter("value <> ''")
    ordered = met.groupBy(key, "kind").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "place", "value"))), lambda x: x["value"])).alias("values"))
    return ordered.select(key, "kind", F.posexplode("values").alias("n", "value"))
