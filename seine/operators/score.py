"""Rule scores of records as one generated column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import contains_any, hits
from seine.operators.filters import blob

# Hints that are looked for as plain strings in a record's text.
SOFTWARE = ["software", "platform", "saas", "analytics", "automation", "digital", "mes", "quality management", "production planning", "ai", "artificial intelligence", "machine learning", "data platform", "cloud", "iot", "scada", "optimization", "optimisation", "monitoring", "digital twin"]
FOOD = ["food", "beverage", "food processing", "food manufacturing", "bakery", "dairy", "meat processing"]
WIRELINE = ["wireline", "slickline", "well logging", "open hole", "cased hole", "perforation"]
EVENT = ["egyps", "exhibitor", "booth", "conference", "event", "exhibit"]
TENDER = ["tender", "rfq", "rfp", "procurement", "invitation to tender", "bid notice"]
OFFICIAL = ["ministry", "authority", "operator", "government", "official"]
BAD_NEWS = ["bbc", "news", "article", "blog", "wikipedia", "job", "jobs", "vacancy", "courier", "shipping", "stock photo", "directory", "list of companies", "ranking"]
OIL_GAS = ["oil and gas", "oil & gas", "petroleum", "upstream", "midstream", "downstream", "energy services", "offshore", "subsurface", "reservoir", "drilling", "production"]
NORWAY = ["norway", "norwegian", "oslo", "stavanger", "bergen", "trondheim"]
ENTERPRISE = ["sap", "oracle", "microsoft", "erp", "crm"]
ACADEMIC = ["abstract", "doi", "journal", "conference", "paper", "research", "study", "authors", "published", "publication", "proceedings", "manuscript", "scholar"]
NOT_ACADEMIC = ["case study", "services", "product page", "solutions", "our capabilities", "halliburton", "slb", "weatherford", "baker hughes", "request a demo", "contact us"]
SERVICES = ["drilling services", "ship services", "courier", "recruitment"]


@dataclass(frozen=True)
class Wanted:
    """What is searched for; its fields become literals of the score."""

    category: str = "general"
    sector: str = ""
    entity: str = "company"
    intent: str = ""
    domain_keywords: list[str] = field(default_factory=list)
    include_countries: list[str] = field(default_factory=list)


def _if(test: Column, yes: int, no: int = 0) -> Column:
    return F.when(test, F.lit(yes)).otherwise(F.lit(no))


#: Fields of a record that its text is made of, in this order.
TOLD = ("company_name", "description", "notes", "website", "source_url", "summary", "contact_page", "linkedin_url", "authors", "doi", "job_title", "employer_name")


def told(columns) -> Column:
    """The text of a record: those of the fields that are among the columns, lower-cased."""
    return blob(*[c for c in TOLD if c in columns])


def score(want: Wanted, text: Column | None = None, has_country=None) -> Column:
    """0 to 100. has_country(text, country) says whether a text speaks of a country; by default as a plain string."""
    hay = told(("company_name", "description", "website", "contact_page", "linkedin_url")) if text is None else text
    speaks = has_country or (lambda t, c: t.contains(c))
    capped = lambda terms, each, most: F.least(hits(hay, terms) * each, F.lit(most))
    filled = lambda c: F.col(c) != ""
    rules = [
        _if(filled("company_name"), 8), _if(filled("website"), 10), _if(filled("email"), 8), _if(filled("phone"), 5),
        _if(F.col("page_type").isin("company", "document"), 8), _if(F.col("is_directory_or_media"), -25), _if(contains_any(hay, BAD_NEWS), -35),
    ]
    software, include = want.category == "software_company", [c.lower() for c in want.include_countries]
    soft, oil, food = hits(hay, SOFTWARE), hits(hay, OIL_GAS), hits(hay, FOOD)
    if software:
        rules += [capped(SOFTWARE, 4, 20), _if(soft == 0, -25), _if((soft < 2) & contains_any(hay, SERVICES), -35)]
    in_sector = F.lit("oil and gas" in want.sector) | contains_any(hay, OIL_GAS)
    rules.append(F.when(in_sector, capped(OIL_GAS, 2, 12)).otherwise(F.lit(0)))
    if software and want.sector == "oil and gas" and "norway" in include:
        north = hits(hay, NORWAY)
        rules += [_if((north > 0) | speaks(hay, "norway"), 18, -30), _if((soft >= 2) & (oil >= 1), 18, -28), _if(contains_any(hay, ENTERPRISE) & ((oil == 0) | (north == 0)), -30)]
    if software and want.sector == "food manufacturing":
        rules += [_if(food > 0, 25, -45), _if(contains_any(hay, ENTERPRISE) & (food == 0), -30)]
    wells = {"wireline", "slickline", "well logging"} & {k.lower() for k in want.domain_keywords}
    if wells:
        rules.append(_if(contains_any(hay, WIRELINE), 18, -35))
        if "egypt" in include:
            rules.append(_if(~speaks(hay, "egypt"), -45))
    if want.entity == "tender" or want.intent == "market_research":
        rules += [_if(contains_any(hay, TENDER), 18, -30), capped(OFFICIAL, 5, 15)]
    if "egyps" in want.sector or want.entity == "company" and any("wireline" in k or "well logging" in k for k in map(str.lower, want.domain_keywords)):
        rules.append(_if(contains_any(hay, EVENT), 15))
    if want.entity == "paper" or want.intent == "document_research":
        academic = hits(hay, ACADEMIC)
        rules += [F.least(academic * 5, F.lit(28)), _if(contains_any(hay, NOT_ACADEMIC), -40), _if(academic == 0, -35)]
        rules += [_if(filled(c), n) for c, n in (("doi", 14), ("authors", 12), ("publication_year", 5))]
    if include:
        there = speaks(hay, include[0])
        for c in include[1:]:
            there = there | speaks(hay, c)
        rules.append(_if(there, 10, -18 if len(include) <= 2 else 0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum(rules[1:], rules[0]).cast("double")))


def quality() -> Column:
    """How much a record tells, for choosing between records of one organisation."""
    filled = lambda c, n: _if(F.col(c) != "", n)
    points = [filled(c, n) for c, n in (("company_name", 8), ("website", 10), ("domain", 8), ("email", 6), ("phone", 5), ("linkedin_url", 4), ("contact_page", 3), ("hq_country", 4), ("country", 2))]
    points += [
        F.least(F.floor(F.length("description") / 40).cast("int"), F.lit(12)),
        F.when(F.col("page_type") == "company", 5).when(F.col("page_type").isin("directory", "media", "blog"), -8).otherwise(0),
        F.floor(F.floor(F.coalesce(F.col("confidence_score"), F.lit(0.0))) / 5).cast("int"),
    ]
    return sum(points[1:], points[0]).cast("int")


def ranked(score_column: Column, rank: Column, keep: Column) -> Column:
    """A score after a reviewer's rank from 0 to 10 and its verdict."""
    moved = F.when(rank.isNull(), score_column).when(rank >= 8, F.least(F.lit(100.0), score_column + 15)).when(rank >= 5, score_column).when(rank >= 3, score_column - 20).otherwise(score_column - 45)
    return F.greatest(F.lit(0.0), F.when(keep == F.lit(False), moved - 15).otherwise(moved))
