"""Prompts as columns: what kind of task, category, intent, format, number of results and places a request asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import geo
from seine.functions.text import bound, clean

# Own defaults: words that decide, in the order in which they are tried. The whole lists are those of `parser`.
TASK_TYPES = (
    ("people_search", r"\b(linkedin|people|engineers?|managers?|directors?|executives?)\b"),
    ("document_research", r"\b(papers?|articles?|journals?|literature|studies|research)\b"),
    ("similar_entity_expansion", r"\b(similar to|competitors?|alternatives?)\b"),
    ("entity_enrichment", r"\b(enrich|complete my|fill in)\b"),
    ("market_research", r"\b(market|tenders?|trends?)\b"),
)
CATEGORIES = (("service_company", r"\b(service compan|contractors?|service providers?)"), ("software_company", r"\b(software|saas|digital|platform|ai|analytics)\b"))
INTENTS = (("agent_or_distributor", r"\b(agents?|distributors?)\b"), ("reseller", r"\bresellers?\b"), ("partner", r"\bpartners?\b"))
FORMATS = (("csv", r"\bcsv\b"), ("json", r"\bjson\b"), ("pdf", r"\bpdf\b"))
NEGATIVE = r"\b(exclude|excluding|outside|without|except|not in|no)\b"


def _first(t: Column, rules, otherwise: str) -> Column:
    out = F.when(F.lit(False), "")
    for value, pattern in rules:
        out = out.when(t.rlike(pattern), value)
    return out.otherwise(otherwise)


def once_said(c: Column) -> Column:
    """A prompt without sentences that only repeat the one before."""
    return bound(F.split(clean(c), r"(?<=[.!?])\s+"), lambda s: F.array_join(F.filter(s, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(s, i - 1)))), " "))


def clauses(c: Column) -> Column:
    """Pieces of a prompt between marks and before words that exclude."""
    return F.split(F.regexp_replace(F.lower(clean(c)), f"({NEGATIVE})", "|$1"), r"[|,;.!?]")


def parse(prompts: DataFrame, text: str) -> DataFrame:
    """prompts with task_type, category, intent, format, max_results, include_countries and exclude_countries."""
    t = F.lower(once_said(F.col(text)))
    number = F.regexp_extract(t, r"\b(?:top|first|find|list|get)\s+([0-9]{1,4})\b", 1)
    loose = F.get(F.filter(F.regexp_extract_all(t, F.lit(r"\b([0-9]{1,4})\b"), F.lit(1)), lambda n: ~n.rlike("^(19|20)[0-9]{2}$")), F.lit(0))
    asked = F.coalesce(F.nullif(number, F.lit("")), loose).cast("int")
    parts = clauses(F.col(text))
    places = lambda negative: F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(parts, lambda p: p.rlike(NEGATIVE) if negative else ~p.rlike(NEGATIVE)), lambda p: geo.countries_in(p)))))
    return prompts.select(
        "*", _first(t, TASK_TYPES, "entity_discovery").alias("task_type"), _first(t, CATEGORIES, "general").alias("category"), _first(t, INTENTS, "general").alias("intent"),
        _first(t, FORMATS, "xlsx").alias("format"), F.when(asked.between(1, 5000), asked).otherwise(25).alias("max_results"),
        places(False).alias("include_countries"), places(True).alias("exclude_countries"),
    ).withColumn("include_countries", F.array_except("include_countries", "exclude_countries"))
