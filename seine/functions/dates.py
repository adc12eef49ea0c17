"""Column functions over dates that texts mention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import bound, first_of_each, text_of

# How dates are spelled, in the order in which they are looked for, and the formats tried on each.
PATTERNS = (
    r"\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b",
    r"\b([0-9]{1,2}/[0-9]{1,2}/20[0-9]{2})\b",
    r"\b([0-9]{1,2}-[0-9]{1,2}-20[0-9]{2})\b",
    r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+[0-9]{1,2},\s*20[0-9]{2})\b",
)
FORMATS = ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def parse(c: Column) -> Column:
    """The first format that fits; day before month where both do."""
    return F.to_date(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS]))


def deadlines(c: Column) -> Column:
    """array<struct<raw, normalized>>: spelled dates by pattern, then place; each spelling once, unparsed ones empty."""
    raw = F.concat(*[F.regexp_extract_all(text_of(c), F.lit(p), F.lit(1)) for p in PATTERNS])
    return F.transform(first_of_each(raw), lambda r: F.struct(r.alias("raw"), F.coalesce(F.date_format(parse(r), "yyyy-MM-dd"), F.lit("")).alias("normalized")))


def next_deadline(c: Column, today: Column) -> Column:
    """The earliest of a text's dates that isn't past, as its struct; the first of equals."""
    open_ = F.filter(deadlines(c), lambda d: d["normalized"] >= F.date_format(today, "yyyy-MM-dd"))
    earliest = lambda o: bound(F.array_min(F.transform(o, lambda d: d["normalized"])), lambda least: F.get(F.filter(o, lambda d: d["normalized"] == least), F.lit(0)))
    return bound(open_, earliest)
