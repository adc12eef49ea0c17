"""Adapters from the driver's tables to the relations that the engine works on.

The SQL is plain enough for other engines, so oracles start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seine.session import table

#: Organisations made of suppliers: some names, sites and contacts missing, domains and names that repeat.
RECORDS_SQL = """
SELECT s_suppkey AS seq,
  CASE WHEN s_suppkey % 11 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN concat('Delta ', k, ' Software Ltd') WHEN s_suppkey % 3 = 1 THEN concat('delta-', k, ' software') ELSE concat('Nile ', k, ' Drilling Services & Co') END AS company_name,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('http://www.d', k, '.example.com/home/') END AS website,
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat('d', k, '.example.com') END AS domain,
  CASE WHEN s_suppkey % 4 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN concat('Analytics platform and cloud software for oil and gas production in Norway, unit ', k) WHEN s_suppkey % 4 = 2 THEN 'Latest news article and job directory' ELSE 'Wireline and slickline crews working offshore from Egypt with bakery digital monitoring' END AS description,
  CASE WHEN s_suppkey % 3 = 0 THEN concat('info', k, '@d', k, '.example.com') ELSE '' END AS email,
  CASE WHEN s_suppkey % 4 = 0 THEN concat('+20 2 555 ', 1000 + s_suppkey) ELSE '' END AS phone,
  CASE WHEN s_suppkey % 6 = 0 THEN concat('https://linkedin.com/company/d', k) ELSE '' END AS linkedin_url,
  CASE WHEN s_suppkey % 7 = 0 THEN concat('https://d', k, '.example.com/contact') ELSE '' END AS contact_page,
  CASE WHEN s_nationkey % 4 = 0 THEN 'egypt' WHEN s_nationkey % 4 = 1 THEN 'norway' WHEN s_nationkey % 4 = 2 THEN 'usa' ELSE '' END AS country,
  CASE WHEN s_nationkey % 5 = 0 THEN 'egypt' WHEN s_nationkey % 5 = 1 THEN 'usa' ELSE '' END AS hq_country,
  CASE WHEN s_suppkey % 8 = 0 THEN 'directory' WHEN s_suppkey % 8 = 1 THEN 'media' WHEN s_suppkey % 8 = 2 THEN 'document' ELSE 'company' END AS page_type,
  s_suppkey % 8 < 2 AS is_directory_or_media,
  CAST(s_suppkey * 37 % 101 AS DOUBLE) AS confidence_score,
  CASE WHEN s_suppkey % 4 = 0 THEN 'ddg' WHEN s_suppkey % 4 = 1 THEN 'exa' WHEN s_suppkey % 4 = 2 THEN 'tavily' ELSE 'serpapi' END AS source_provider
FROM (SELECT *, CAST(s_suppkey % 37 AS INTEGER) AS k FROM {supplier}) s
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RECORDS_SQL, supplier=table(spark, sf_dir, "supplier"))


RECORDS = f"({RECORDS_SQL.format(supplier='supplier')})"


#: Organisations named by the first words of texts: as many different names as there are texts, near copies among them.
NAMES_SQL = """
SELECT doc_id AS seq, concat_ws(' ', slice(words, 1, 1 + CAST(doc_id % 4 AS INTEGER)), CASE WHEN doc_id % 5 = 0 THEN 'Ltd' WHEN doc_id % 5 = 1 THEN 'energy' END) AS company_name
FROM (SELECT doc_id, filter(split(regexp_replace(substring(coalesce(text, ''), 1, 400), '[^A-Za-z0-9&]+', ' '), ' '), w -> w <> '') AS words FROM {documents}) d
"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a generator's output, which what reads it can't repeat: cutting a text is dear, and names are read many times
    return spark.sql(NAMES_SQL, documents=table(spark, sf_dir, "documents")).select("seq", F.explode_outer(F.array("company_name")).alias("company_name"))
