"""Queries over texts, addresses and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from seine.functions import dates, html, names, text, urls
from seine.session import table
from seine.sources import fixtures

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

STOP = ["that", "with", "from", "this"]
_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_MAIL = text.EMAIL.replace("\\-", "-")


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _docs(spark, d):
    return table(spark, d, "documents")


def _over_text(**columns):
    return lambda spark, d: _docs(spark, d).select("doc_id", *[f(F.col("text")).alias(n) for n, f in columns.items()])


def _over_name(**columns):
    return lambda spark, d: fixtures.records(spark, d).select("seq", *[f(F.col("company_name")).alias(n) for n, f in columns.items()])


_add("txt_clean_text", _over_text(cleaned=text.clean), f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
_add("txt_normalize", _over_text(normal=text.normal), f"SELECT doc_id, lower(translate(regexp_replace({_CLEAN}, '[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed]', '', 'g'), '{text.FROM_ARABIC}', '{text.TO_ARABIC}')) AS normal FROM documents")
_add(
    "txt_sentences_first2", _over_text(summary=lambda c: text.first_sentences(c, 2), n_sentences=lambda c: F.size(text.sentences(c))),
    f"""SELECT doc_id, array_to_string(s[1:2], ' ') AS summary, len(s)::INTEGER AS n_sentences FROM (
      SELECT doc_id, list_filter(string_split(regexp_replace({_CLEAN}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)""",
)
_add(
    "txt_email_extract", _over_text(emails=lambda c: F.array_join(F.array_sort(text.emails(c)), ",")),
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_MAIL}'), lambda e: lower(e)),
      lambda e: string_split(e, '@')[-1] NOT IN ({", ".join(f"'{x}'" for x in text.JUNK_MAIL_DOMAINS)})))), ',') AS emails FROM documents""",
)
_add("txt_phone_extract", _over_text(phones=lambda c: F.array_join(text.phones(c), ",")))
_add("txt_url_extract", _over_text(n_urls=lambda c: F.size(text.urls(c))), f"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '{text.URL.replace("'", "''")}'), lambda u: rtrim(u, '.,;'))))::INTEGER AS n_urls FROM documents""")
_add(
    "txt_doi_year_patent", _over_text(doi=text.doi, year=text.year, n_patents=lambda c: F.size(text.patents(c))),
    f"""SELECT doc_id, rtrim(regexp_extract(coalesce(text, ''), '{text.DOI}', 0), ').,;') AS doi, regexp_extract(coalesce(text, ''), '{text.YEAR}', 1) AS year,
      len(list_distinct(list_transform(regexp_extract_all(upper(coalesce(text, '')), '{text.PATENT}'), lambda p: regexp_replace(p, '\\s+', '', 'g'))))::INTEGER AS n_patents FROM documents""",
)

_DATED = "concat(text, ' due ', CAST(2024 + doc_id % 3 AS VARCHAR(4)), '-0', CAST(1 + doc_id % 9 AS VARCHAR(1)), '-15 or ', CAST(1 + doc_id % 28 AS VARCHAR(2)), '/7/2025, also Mar ', CAST(1 + doc_id % 28 AS VARCHAR(2)), ', 2026')"
_DUCK_DATES = """list_concat(list_concat(regexp_extract_all(t, '\\b20[0-9]{2}-[0-9]{2}-[0-9]{2}\\b'), regexp_extract_all(t, '\\b[0-9]{1,2}/[0-9]{1,2}/20[0-9]{2}\\b')),
  list_concat(regexp_extract_all(t, '\\b[0-9]{1,2}-[0-9]{1,2}-20[0-9]{2}\\b'), regexp_extract_all(t, '(?i)\\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\s+[0-9]{1,2},\\s*20[0-9]{2}\\b')))"""
_PARSED = "coalesce(strftime(try_strptime(r, ['%Y-%m-%d', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%b %d, %Y', '%B %d, %Y']), '%Y-%m-%d'), '')"


def _dated(spark, d):
    return _docs(spark, d).select("doc_id", F.expr(_DATED).alias("t"))


_add(
    "txt_deadlines", lambda spark, d: _dated(spark, d).select("doc_id", F.explode(dates.deadlines(F.col("t"))).alias("x")).select("doc_id", "x.raw", "x.normalized"),
    f"""SELECT doc_id, r AS raw, {_PARSED} AS normalized FROM (SELECT DISTINCT ON (doc_id, lower(r)) doc_id, r FROM (
      SELECT doc_id, unnest(ds) AS r, unnest(range(len(ds))) AS i FROM (SELECT doc_id, {_DUCK_DATES} AS ds FROM (SELECT doc_id, {_DATED} AS t FROM documents))) ORDER BY doc_id, lower(r), i)""",
)
_add(
    "txt_next_deadline", lambda spark, d: _dated(spark, d).select("doc_id", dates.next_deadline(F.col("t"), F.lit("2025-07-01").cast("date")).alias("x")).select("doc_id", F.col("x.normalized").alias("next_due")),
    f"""SELECT doc_id, min(n) FILTER (n >= '2025-07-01') AS next_due FROM (SELECT doc_id, {_PARSED} AS n FROM (
      SELECT doc_id, unnest({_DUCK_DATES}) AS r FROM (SELECT doc_id, {_DATED} AS t FROM documents))) GROUP BY doc_id""",
)
_TENDER = "concat(coalesce(text, ''), CASE WHEN doc_id % 3 = 0 THEN concat(' Closing date:  12 May 2026; Issuer: Ministry of  Works ', doc_id) ELSE '' END)"
_add(
    "txt_tender_fields", lambda spark, d: _docs(spark, d).select("doc_id", F.expr(_TENDER).alias("t")).select("doc_id", text.tender_deadline(F.col("t")).alias("deadline"), text.tender_buyer(F.col("t")).alias("buyer")),
    f"""SELECT doc_id, regexp_extract(t, '(?i)(?:deadline|closing date|due date)[:\\s]+([A-Za-z0-9,/\\- ]{{6,30}})', 1) AS deadline,
      trim(regexp_replace(regexp_extract(t, '(?i)(?:buyer|issuer|authority|ministry)[:\\s]+([A-Za-z0-9&.,\\- ]{{3,80}})', 1), ' +', ' ', 'g')) AS buyer
      FROM (SELECT doc_id, {_TENDER} AS t FROM documents)""",
)
_add(
    "txt_exhibitors", _over_text(n_names=lambda c: F.size(text.exhibitors(c))),
    """SELECT doc_id, len(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\n•|]+'), lambda s: trim(regexp_replace(regexp_replace(s, '^[\\s\\-*0-9.)]+', ''), '\\s+', ' ', 'g'))),
      lambda s: length(s) BETWEEN 2 AND 120 AND regexp_matches(s, '^[A-Z]'))))::INTEGER AS n_names FROM documents""",
)
_AUTHORS = "concat('Ann Lee, bob ', CAST(doc_id % 5 AS VARCHAR(2)), '; ann lee and Cy Poe, x; ', coalesce(text, ''))"
_add(
    "txt_author_list", lambda spark, d: _docs(spark, d).select("doc_id", F.array_join(text.authors(F.expr(_AUTHORS)), "|").alias("authors")),
    f"""SELECT doc_id, (SELECT string_agg(s, '|' ORDER BY i) FROM (SELECT arg_min(s, i) AS s, min(i) AS i FROM (SELECT trim(regexp_replace(unnest(l), '\\s+', ' ', 'g')) AS s, unnest(range(len(l))) AS i)
      WHERE length(s) >= 2 GROUP BY lower(s))) AS authors FROM (SELECT doc_id, string_split_regex({_AUTHORS}, '(?i)\\s*[,;]\\s*|\\s+and\\s+') AS l FROM documents)""",
)
_add(
    "txt_lang_detect", _over_text(languages=lambda c: F.array_join(text.languages(c), ",")),
    """SELECT doc_id, CASE WHEN regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[\u0600-\u06ff]') THEN 'en,ar' WHEN regexp_matches(t, '[\u0600-\u06ff]') THEN 'ar' ELSE 'en' END AS languages
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
_add("txt_truncate_slug", _over_text(short=lambda c: text.truncate(c, 80), slug=text.slug), f"""SELECT doc_id, CASE WHEN length(c) <= 80 THEN c ELSE rtrim(c[1:77]) || '...' END AS short, CASE WHEN s = '' THEN 'report' ELSE s END AS slug
  FROM (SELECT doc_id, {_CLEAN} AS c, regexp_replace(({_SLUG})[1:60], '-+$', '') AS s FROM documents)""")
_add(
    "top_keywords", lambda spark, d: _keywords(_docs(spark, d)),
    f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}')) AS word FROM documents)
      WHERE word NOT IN ({", ".join(f"'{s}'" for s in STOP)}) GROUP BY word ORDER BY n DESC, word LIMIT 25""",
)


def _keywords(df):
    from seine.operators.reports import top_keywords

    return top_keywords(df, text.keywords(F.col("text")), STOP, 25)


# --- addresses and pages ----------------------------------------------------------------------------------------

_HOST = "rtrim(regexp_replace(regexp_replace(regexp_replace(lower(trim({u})), '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', ''), '^www[0-9]*[.]', ''), '.')"
_SUFFIXES = ", ".join(f"'{s}'" for s in urls.TWO_LABEL_SUFFIXES)
_URL = f"""'https://' || {_HOST.format(u="url")} || regexp_extract(regexp_replace(regexp_replace(trim(url), '^https?://', ''), '[?#].*$', ''), '^[^/]*(/.*)$', 1)"""
_add(
    "url_parts", lambda spark, d: table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.domain(F.col("url")).alias("domain"), urls.normal_url(F.col("url")).alias("normal"), urls.root_url(F.col("url")).alias("root")),
    f"""SELECT page_id, h AS host, array_to_string(CASE WHEN array_to_string(p[-2:], '.') IN ({_SUFFIXES}) THEN p[-3:] ELSE p[-2:] END, '.') AS domain, normal, 'https://' || h AS root
      FROM (SELECT page_id, {_HOST.format(u="url")} AS h, string_split({_HOST.format(u="url")}, '.') AS p, rtrim({_URL}, '/') AS normal FROM pages)""",
)


def _page(**columns):
    return lambda spark, d: table(spark, d, "pages").select("page_id", *[f(F.col("html")).alias(n) for n, f in columns.items()])


_UNESCAPE = "replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_TIDY = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_add("html_title", _page(title=html.title), "SELECT page_id, " + _TIDY.format(x=_UNESCAPE.format(x="regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)")) + " AS title FROM pages")
_VISIBLE = _TIDY.format(x=_UNESCAPE.format(x="regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))
_add("html_main_text", _page(body=html.visible_text), f"SELECT page_id, {_VISIBLE} AS body FROM pages")
_add("html_links", _page(n_links=lambda c: F.size(html.links(c)), n_contact=lambda c: F.size(html.contact_links(c, text.CONTACT_WORDS))), f"""SELECT page_id, len(l)::INTEGER AS n_links, len(list_filter(l, lambda u: regexp_matches(lower(u), '{"|".join(text.CONTACT_WORDS)}')))::INTEGER AS n_contact
  FROM (SELECT page_id, list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*href=["'']([^"'']*)["'']', 1)) AS l FROM pages)""")
_add("html_company_name", _page(name=html.company_name, description=html.description, networks=lambda c: F.size(html.social_links(c))))
_LD = """concat('<script type="application/ld+json">{"@type":"Organization","name":"Org ', CAST(page_id AS VARCHAR(20)), '","email":"a@b.org","address":{"addressCountry":"EG"}}</script>')"""
_add(
    "html_jsonld", lambda spark, d: table(spark, d, "pages").select("page_id", html.json_ld_organisation(F.get(html.json_ld(F.concat(text.text_of(F.col("html")), F.expr(_LD))), F.lit(0))).alias("o")).select("page_id", "o.name", "o.email", "o.country"),
    "SELECT page_id, 'Org ' || page_id AS name, 'a@b.org' AS email, 'EG' AS country FROM pages",
)

# --- names --------------------------------------------------------------------------------------------------------

_ALL = "|".join(w.replace(".", "[.]") for w in sorted({*names.LEGAL_SUFFIXES, *names.NOISE_TOKENS}, key=lambda w: (-len(w), w)))
_CLEAN_NAME = f"trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(lower(company_name), '&', ' and '), '[/|:,_()\\[\\]{{}}\\-]+', ' ', 'g'), '\\s+', ' ', 'g')), '(?:(?:^|\\s)(?:{_ALL}))+$', ''))"
_add("er_clean_name", _over_name(clean=names.clean_name, short=names.acronym), f"""SELECT seq, clean, CASE WHEN len(t) < 2 THEN '' ELSE array_to_string(list_transform(t, lambda x: x[1]), '') END AS short
  FROM (SELECT seq, {_CLEAN_NAME} AS clean, list_filter(string_split({_CLEAN_NAME}, ' '), lambda x: x <> '') AS t FROM {fixtures.RECORDS})""")
_add("er_norm_name", _over_name(key=names.name_key), f"""SELECT seq, array_to_string(list_filter(string_split(trim(regexp_replace(replace(lower(company_name), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' '),
  lambda w: w <> '' AND w NOT IN ({", ".join(f"'{w}'" for w in names.KEY_NOISE)})), ' ') AS key FROM {fixtures.RECORDS}""")
_add("er_display_score", _over_name(points=names.display_score), f"""SELECT seq, (CASE WHEN s = '' THEN -999 ELSE CASE WHEN contains(s, '/') THEN -6 ELSE 0 END + CASE WHEN length(s) <= 60 THEN 3 WHEN length(s) <= 90 THEN 1 ELSE -3 END
  + CASE WHEN s[1] = upper(s[1]) AND s[1] <> lower(s[1]) THEN 2 ELSE 0 END + CASE WHEN (s = upper(s)) = (s = lower(s)) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, ' [|] | - | :: | — ') THEN -2 ELSE 0 END
  + CASE WHEN w BETWEEN 1 AND 5 THEN 3 WHEN w > 8 THEN -2 ELSE 0 END + CASE WHEN clean <> '' AND clean <> lower(s) THEN 1 ELSE 0 END END)::INTEGER AS points
  FROM (SELECT *, len(list_filter(string_split(clean, ' '), lambda x: x <> '')) AS w FROM (SELECT seq, trim(company_name) AS s, {_CLEAN_NAME} AS clean FROM {fixtures.RECORDS}))""")
