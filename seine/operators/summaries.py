"""Summaries of records from their own words: the first sentences of what a record of a kind says.

A language model, where there is one, is asked elsewhere; this is what stands without it. Notes are filled where they are
blank, and papers get the authors found in their text where they name none.

Defined results: a record that says nothing has an empty summary and keeps its notes; columns that are not there are blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import papers, text
from seine.functions.text import clean
from seine.operators.frames import Fields

# What a record of a kind is told by, in this order; the first filled of each.
TOLD = {
    "company": (("company_name",), ("description", "summary"), ("hq_country", "country"), ("presence_countries",), ("website",)),
    "paper": (("company_name", "title"), ("authors",), ("publication_year", "year"), ("description", "abstract", "summary")),
    "person": (("company_name",), ("job_title",), ("employer_name",), ("city", "country"), ("description", "summary")),
}


def told(columns, kind: str) -> Column:
    """All that a record of a kind says, blanks between."""
    f = Fields(columns)

    def part(names: tuple[str, ...]) -> Column:
        if names == ("presence_countries",):
            return F.array_join("presence_countries", ", ") if "presence_countries" in f.columns else F.lit("")
        return f(*names)

    return clean(F.concat_ws(" ", *[F.nullif(part(n), F.lit("")) for n in TOLD[kind]]))


def summarised(records: DataFrame, kind: str, sentences: int = 2) -> DataFrame:
    """records with `summary_text`, and it as notes where they are blank; papers also with authors where they have none."""
    out = records
    if kind == "paper" and "authors" in records.columns:
        out = out.withColumn("authors", text.first_filled(F.col("authors"), papers.authors(F.col("description"))))
    made = text.fenced(out, {"summary_text": text.first_sentences(told(out.columns, kind), sentences)})
    return made.withColumn("notes", text.first_filled(F.col("notes"), F.col("summary_text"))) if "notes" in records.columns else made
