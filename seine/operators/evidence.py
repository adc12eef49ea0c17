"""Evidence of records: items with a label, a snippet, terms and countries, gathered and attached."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import bound, text_of

ITEM = "struct<evidence_type:string,source_type:string,label:string,snippet:string,matched_terms:array<string>,matched_countries:array<string>,confidence:double>"


def _item(kind: str, source: Column, label: Column, snippet: Column, terms: Column, countries: Column, confidence: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("evidence_type"), source.alias("source_type"), label.alias("label"), snippet.alias("snippet"),
        terms.cast("array<string>").alias("matched_terms"), countries.cast("array<string>").alias("matched_countries"), confidence.cast("double").alias("confidence"),
    ).cast(ITEM)


def of_text(body: Column, countries: Column, source: Column, label: Column | None = None) -> Column:
    """A text as evidence: its first 500 characters and the countries it speaks of; an empty one is worth nothing."""
    snippet = F.trim(text_of(body))
    named = source if label is None else F.coalesce(F.nullif(label, F.lit("")), source)
    return _item("text", source, named, F.substring(snippet, 1, 500), F.array(), countries, F.when(snippet == "", 0.0).otherwise(0.5))


def of_keywords(body: Column, words: list[str], source: Column) -> Column:
    """The words that stand in a text; null where none does."""
    low = F.lower(text_of(body))
    found = bound(low, lambda t: F.filter(F.array(*map(F.lit, words)), lambda w: t.contains(F.lower(w))))
    return bound(found, lambda f: F.when(F.size(f) > 0, _item("keyword", source, F.lit("keywords"), F.substring(text_of(body), 1, 500), f, F.array(), F.least(F.lit(1.0), F.lit(0.4) + 0.1 * F.size(f)))))


def united(items: Column, field: str) -> Column:
    """The filled terms or countries of all items in order, the first of equals."""
    whole = F.flatten(F.transform(items, lambda i: F.coalesce(i[field], F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.transform(whole, lambda x: F.trim(text_of(x))), lambda x: x != ""))


def summary(items: Column, most: int = 5, width: int = 140) -> Column:
    """The first items' labels with what they quote, between bars."""

    def told(i: Column) -> Column:
        name = F.coalesce(F.nullif(i["label"], F.lit("")), F.nullif(i["source_type"], F.lit("")), i["evidence_type"])
        quote = F.trim(text_of(i["snippet"]))
        return F.when(quote == "", name).otherwise(F.concat(name, F.lit(": "), F.substring(quote, 1, width)))

    return F.array_join(F.transform(F.slice(items, 1, most), told), " | ")


def noted(notes: Column, items: Column) -> Column:
    """A record's notes with the summary of its evidence; without items as they were."""
    told, own = F.concat(F.lit("evidence:"), summary(items)), F.trim(text_of(notes))
    return F.when(F.size(items) == 0, text_of(notes)).when(own == "", told).otherwise(F.concat_ws(" | ", own, told))
