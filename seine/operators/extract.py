"""Records of people, papers, patents, events and tenders from search results, and what pages are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import html, text, urls

# Own defaults: words that tell kinds of pages, and the terms and industries of domain packs.
DIRECTORY = r"directory|list of|top [0-9]+|yellow ?pages|companies in"
MEDIA = r"news|magazine|press release|newspaper"
BLOG = r"blog|/post/|opinion"
PACKS = {
    "oil_gas": (("drilling", "wireline", "reservoir", "offshore", "well"), ("oil and gas", "petroleum")),
    "software": (("saas", "platform", "cloud", "analytics", "api"), ("software", "information technology")),
    "food": (("bakery", "dairy", "beverage", "packaging"), ("food manufacturing",)),
    "health": (("clinic", "hospital", "patient", "diagnostic"), ("healthcare", "pharma")),
}


def person(title: Column, url: Column, snippet: Column) -> Column:
    """struct(name, job_title, employer, location) of a profile result; a name missing from the title comes from the URL."""
    parts = F.split(F.regexp_replace(text.text_of(title), r"\s*[|]\s*LinkedIn.*$", ""), r"\s+[-–|]\s+")
    slug = F.regexp_extract(text.text_of(url), r"/in/([A-Za-z0-9-]+)", 1)
    words = F.filter(F.split(slug, "-"), lambda w: (w != "") & ~w.rlike("[0-9]"))
    spelled = F.initcap(F.array_join(F.slice(words, 1, 3), " "))
    name = text.clean(F.get(parts, F.lit(0)))
    at = F.regexp_extract(text.text_of(snippet), r"\bat ([A-Z][A-Za-z0-9& ]{1,60})", 1)
    return F.struct(
        F.when(name != "", name).otherwise(spelled).alias("name"), text.clean(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("job_title"),
        text.first_filled(F.get(parts, F.lit(2)), at).alias("employer"), text.clean(F.regexp_extract(text.text_of(snippet), r"Location:\s*([A-Za-z ,]+)", 1)).alias("location"),
    )


def page_type(url: Column, title: Column, body: Column) -> Column:
    """directory, media, blog or company, the first that a page's address or title shows; unknown without text."""
    head = F.lower(F.concat_ws(" ", url, title))
    return F.when(head.rlike(DIRECTORY), "directory").when(head.rlike(MEDIA), "media").when(head.rlike(BLOG), "blog").when(F.trim(text.text_of(body)) == "", "unknown").otherwise("company")


def pack_scores(df: DataFrame, key: str, body: Column, packs: dict = PACKS) -> DataFrame:
    """(key, pack, points, place) of packs with points: one for each term that the text holds, two for each industry."""
    t = F.lower(text.text_of(body))
    rows = F.array(*[F.struct(F.lit(n).alias("pack"), (text.hits(t, list(terms)) + text.hits(t, list(industries)) * 2).alias("points")) for n, (terms, industries) in packs.items()])
    ranked = F.array_sort(F.filter(rows, lambda r: r["points"] > 0), lambda a, b: F.when(a["points"] != b["points"], b["points"] - a["points"]).when(a["pack"] < b["pack"], -1).otherwise(1))
    return df.select(key, F.posexplode(ranked).alias("place", "r")).select(key, "r.pack", "r.points", (F.col("place") + 1).alias("place"))


def evidence(body: Column, keywords: list[str]) -> Column:
    """struct(terms, confidence): the keywords that a text holds, and 0.4 and 0.1 for each of them, 1 at most."""
    t = F.lower(text.text_of(body))
    terms = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: t.contains(k))
    return F.struct(terms.alias("terms"), F.when(F.size(terms) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.lit(0.4) + F.size(terms) * F.lit(0.1)), 4)).alias("confidence"))


def anchors(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """(key, name, link, domain) of a directory page's anchors to other hosts, each name and domain once for a page."""
    raw = pages.select(key, url, F.explode(F.regexp_extract_all(text.text_of(F.col(body)), F.lit(r"(?is)<a\s[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))).alias("a"))
    href = F.regexp_extract("a", r"(?i)href=[\"']([^\"']*)[\"']", 1)
    found = raw.select(key, url, text.clean(html.unescape(F.regexp_replace("a", "(?s)<[^>]*>", " "))).alias("name"), urls.join_url(F.col(url), href).alias("link"))
    named = found.withColumn("domain", urls.domain(F.col("link"))).filter((F.length("name") >= 2) & F.col("link").rlike("^https?://") & (F.col("domain") != urls.domain(F.col(url))))
    return named.groupBy(key, "name", "domain").agg(F.min("link").alias("link"))


def paper(title: Column, body: Column, url: Column) -> Column:
    """struct(title, doi, year, reference) of a paper; the reference is the arXiv page, else the DOI's, else the URL."""
    whole = F.concat_ws(" ", title, body, url)
    doi, arxiv = text.doi(whole), text.arxiv_id(whole)
    reference = F.when(arxiv != "", F.concat(F.lit("https://arxiv.org/abs/"), arxiv)).when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(text.text_of(url))
    return F.struct(text.clean(title).alias("title"), doi.alias("doi"), text.year(whole).alias("year"), reference.alias("reference"))


def focus(title: Column, body: Column) -> Column:
    """What a paper is about, the first of these labels that fits."""
    t = F.lower(F.concat_ws(" ", title, body))
    rules = (("review", r"\b(review|survey|overview)\b"), ("method", r"\b(method|algorithm|framework|model)"), ("experiment", r"\b(experiment|laboratory|measurement)"), ("case study", r"\b(case study|field)\b"), ("software", r"\b(software|tool|library)\b"))
    out = F.when(F.lit(False), "")
    for name, pattern in rules:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise("general")


def takeaway(topic: str, label: Column, has_abstract: Column, not_paper: Column) -> Column:
    """One sentence on a paper for readers of a topic."""
    return F.when(not_paper, F.lit(f"Probably no paper; check it before citing it on {topic}.")).when(has_abstract, F.concat(F.lit(f"Relevant to {topic} as "), label, F.lit("."))).otherwise(F.lit(f"No abstract; read it in full before using it on {topic}."))


def summary(kind: str) -> Column:
    """The text that stands for a record of a kind: its filled fields, labelled, in lines."""
    fields = {"company": (("Name", "company_name"), ("About", "description"), ("Seat", "hq_country"), ("Site", "website")), "paper": (("Title", "title"), ("Authors", "authors"), ("Year", "year")), "person": (("Name", "name"), ("Role", "job_title"), ("Employer", "employer"))}
    return F.concat_ws("\n", *[F.when(~text.is_blank(F.col(c)), F.concat(F.lit(f"{label}: "), F.col(c))) for label, c in fields[kind]])


# Words that a summary must have one of, by what is looked for.
OF_PAPERS = ("abstract", "paper", "study", "journal", "conference", "doi")
OF_WELLS = ("wireline", "slickline", "well logging")
OF_DIGITAL = ("software", "platform", "analytics", "automation", "digital", "monitoring", "scada", "ai")


def preferred_summary(parts: list[Column], task: str, keywords: list[str], category: str, industry: str) -> Column:
    """The first 500 characters of a record's own words, or nothing if they lack the words that the task asks for."""
    whole = F.trim(F.concat_ws(" ", *[text.text_of(c) for c in parts]))
    low = F.lower(whole)
    asked = F.lit(True)
    if task == "document_research":
        asked &= text.contains_any(low, OF_PAPERS)
    if {k.lower() for k in keywords} & set(OF_WELLS):
        asked &= text.contains_any(low, (*OF_WELLS, "logging"))
    if category == "software_company" and industry.lower() == "oil and gas":
        asked &= text.contains_any(low, OF_DIGITAL)
    return F.when(asked, F.substring(whole, 1, 500)).otherwise("")


def company_of_profile(title: Column, url: Column, snippet: Column) -> list[Column]:
    """company_name, linkedin_url (of company profiles only), description and domain of a search result."""
    name = F.regexp_replace(text.text_of(title), r"(?i)\s*[|\-–]\s*LinkedIn.*$", "")
    own = F.when(urls.is_company_profile(F.lower(text.text_of(url))), urls.normal_url(url)).otherwise("")
    return [text.clean(name).alias("company_name"), own.alias("linkedin_url"), text.clean(snippet).alias("description"), urls.domain(url).alias("domain")]
