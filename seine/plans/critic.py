"""What a critic says of a request before it is run.

Defined results: null lists and texts count as empty; a request without faults has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seine.functions.text import text_of


def task_issues(tasks: DataFrame, key: str) -> DataFrame:
    """(key, n, severity, code) of requests (key, industry, entity_types, include, exclude, exclude_presence, strict, intent)."""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    first = F.coalesce(F.get("entity_types", F.lit(0)), F.lit("company"))
    rules = (
        (F.trim(text_of(F.col("industry"))) == "", "error", "missing_industry"),
        (empty("entity_types"), "warning", "missing_entity"),
        (F.coalesce("strict", F.lit(False)) & empty("include") & empty("exclude") & empty("exclude_presence"), "warning", "strict_without_geo"),
        ((F.coalesce("intent", F.lit("general")) != "general") & (first != "company"), "info", "commercial_non_company"),
    )
    found = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"))) for holds, severity, code in rules]))
    return tasks.select(key, F.posexplode(found).alias("n", "i")).select(key, "n", "i.severity", "i.code")
