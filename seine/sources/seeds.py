"""Seed files: known organisations and people, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.functions import names, text, urls

# Names under which seed files hold each kind of key, in the order of preference.
COLUMNS = {
    "domain": ("domain", "website", "url", "Website", "URL", "Domain"),
    "company": ("company_name", "name", "company", "Company", "Company Name", "Name"),
    "profile": ("linkedin_url", "linkedin_profile", "LinkedIn URL", "LinkedIn Profile", "profile_url", "url"),
    "person": ("full_name", "person_name", "Full Name", "Person"),
}


def read(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as text."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _normal(kind: str, c: Column) -> Column:
    if kind == "domain":
        return urls.domain(c)
    if kind == "company":
        return names.clean_name(c)
    if kind == "profile":
        return F.when(c.contains("/in/"), F.rtrim(F.lower(F.trim(c)), F.lit("/"))).otherwise("")
    return F.lower(text.clean(c))


def keys(df: DataFrame) -> DataFrame:
    """(kind, key): the distinct filled keys of every kind, from all columns that may hold it."""
    rows = [F.struct(F.lit(kind).alias("kind"), _normal(kind, text.text_of(F.col(f"`{c}`"))).alias("key")) for kind, columns in COLUMNS.items() for c in columns if c in df.columns]
    if not rows:
        return df.sparkSession.createDataFrame([], "kind string, key string")
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.kind", "r.key").filter("key <> ''").distinct()


def summary(found: DataFrame) -> DataFrame:
    """(kind, n) of an index of keys."""
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def unknown(df: DataFrame, found: DataFrame, kind: str, column: str) -> DataFrame:
    """Rows whose key isn't in the index; blank keys are unknown."""
    known = found.filter(F.col("kind") == kind).select(F.col("key").alias("seine_key"))
    return df.join(known, _normal(kind, text.text_of(F.col(column))) == F.col("seine_key"), "left_anti")
