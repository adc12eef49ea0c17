"""Writers: records in the shape and format that was asked for. Spark writes the files; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPANY = ("company_name", "website", "email", "phone", "linkedin_url", "country", "hq_country", "description", "confidence_score")
PAPER = ("title", "authors", "publication_year", "doi", "source_url", "description", "confidence_score")


def shaped(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a kind that df has; lists become text; papers have a title for a name."""
    if kind == "paper" and "company_name" in df.columns:
        df = df.withColumnRenamed("company_name", "title")
    kept = [c for c in (PAPER if kind == "paper" else COMPANY) if c in df.columns]
    return df.select(*[F.array_join(c, ", ").alias(c) if dict(df.dtypes)[c].startswith("array<string") else F.col(c) for c in kept])


def write(df: DataFrame, path: str, fmt: str, kind: str = "company") -> str | None:
    """Writes parquet, json or csv below path; None, and nothing written, for an empty frame."""
    out = shaped(df, kind)
    if out.isEmpty():
        return None
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    elif fmt not in ("json", "parquet"):
        raise ValueError(f"no writer for {fmt}")
    writer.format(fmt).save(path)
    return path


def report(df: DataFrame, heading: str, order: str) -> DataFrame:
    """One row of Markdown for each record, in order; written with write.text."""
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("company_name")), F.when(F.col("website") != "", F.concat(F.lit("Website: "), F.col("website"))), F.substring("description", 1, 1200))
    return df.orderBy(order).select(F.concat(F.lit(f"<!-- {heading} -->\n"), body).alias("value"))


def html_of(markdown, title: str):
    """A column of Markdown as a plain page: headings by their signs, items and paragraphs by lines, all escaped."""
    safe = F.replace(F.replace(F.replace(markdown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    rest = lambda x, n: F.trim(F.substring(x, n, F.length(x)))
    line = lambda x: (
        F.when(x == "", "").when(x.startswith("### "), tag("h3", rest(x, F.lit(5)))).when(x.startswith("## "), tag("h2", rest(x, F.lit(4)))).when(x.startswith("# "), tag("h1", rest(x, F.lit(3))))
        .when(x.startswith("- "), tag("li", rest(x, F.lit(3)))).otherwise(tag("p", x))
    )
    body = F.array_join(F.filter(F.transform(F.split(F.coalesce(safe, F.lit("")), "\n"), lambda x: line(F.trim(x))), lambda x: x != ""), "\n")
    return F.concat(F.lit(f"<html><head><title>{title}</title></head><body>\n"), body, F.lit("\n</body></html>"))
