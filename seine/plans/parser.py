"""Requests in words turned into columns: kind of task, things asked for, category, keywords, places, attributes, format,
number of results and the industry, by lists of words that are tried in their order.

All of it are column functions, but for places, which the gazetteer finds in the clauses of a request. A clause with a word
that excludes gives places to leave out, or, if it speaks of offices, activity or the like, places without presence; other
clauses give places to look in, which win over both.

Defined results: a null or empty request is a search for companies, 25 of them, anywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seine.functions import places
from seine.functions.text import bound, fenced, text_of
from seine.operators.gazetteer import Gazetteer

# Words by kind of thing, attribute, format, category, keyword; kinds of task; in the order in which they are tried.
ENTITIES = {
    "company": (
        "company", "companies", "vendor", "vendors", "firm", "firms", "provider", "providers", "contractor", "contractors", "operator", "operators",
        "supplier", "suppliers", "startup", "startups", "corporation", "corporations", "enterprise", "enterprises", "agency", "agencies", "business", "businesses",
    ),
    "person": ("person", "people", "founder", "ceo", "manager", "contact person", "researcher", "expert", "consultant", "director", "executive", "scientist", "engineer", "professor"),
    "paper": ("paper", "papers", "journal", "study", "studies", "publication", "publications", "article", "articles", "report", "reports", "thesis", "theses", "preprint", "research", "literature"),
    "organization": ("organization", "organisation", "association", "society", "institute", "foundation", "ngo", "consortium", "alliance", "university"),
    "event": ("event", "conference", "expo", "summit", "workshop", "forum", "symposium", "webinar", "congress", "trade show"),
    "product": ("product", "products", "tool", "tools", "platform", "solution", "solutions", "app", "application", "software", "system"),
}
NAMES_PERSON = ("people", "researcher", "expert", "consultant", "ceo", "founder", "director")
ATTRIBUTES = {
    "website": ("website", "site", "url", "homepage", "link", "web"),
    "email": ("email", "emails", "mail", "contact email", "e-mail"),
    "phone": ("phone", "telephone", "tel", "mobile", "contact number", "phone number", "contact details", "contact info", "contact information", "contact"),
    "linkedin": ("linkedin",),
    "hq_country": ("hq", "headquarters", "head office", "based in", "headquartered"),
    "presence_countries": ("branches", "offices", "presence", "locations", "regional", "operating in", "active in"),
    "summary": ("summary", "overview", "description", "abstract", "bio"),
    "author": ("author", "authors", "written by", "authored by", "who wrote", "researcher", "researchers"),
    "pdf": ("pdf", "full text", "download"),
}
FORMATS = {"xlsx": ("excel", "xlsx", "spreadsheet", "xls"), "csv": ("csv",), "pdf": ("pdf",), "json": ("json",)}
TASKS = {
    "entity_enrichment": ("enrich", "append", "fill missing", "complete list", "add email", "add phone", "enrich list", "update list"),
    "similar_entity_expansion": ("similar companies", "similar vendors", "like these", "similar to", "alternatives to", "companies like"),
    "market_research": ("market map", "landscape", "market research", "industry map", "competitive landscape", "market overview"),
    "document_research": ("paper", "papers", "study", "studies", "publication", "publications", "article", "articles", "report", "reports", "journal", "thesis", "research on", "literature"),
    "people_search": (
        "linkedin", "linkedin profile", "linkedin account", "people who work", "people working", "professionals in", "find engineers", "find managers", "find hr", "find people",
        "employees in", "staff in", "workers in",
    ),
}
SERVICES = (
    "service company", "service companies", "contractor", "contractors", "field service", "services provider", "engineering services", "oilfield services", "drilling services", "field services",
    "maintenance", "inspection", "testing", "consulting services", "wireline services", "slickline services", "well logging services", "well intervention", "completion services", "stimulation services",
)
DIGITAL = (
    r"digital", r"software", r"saas", r"platforms?", r"analytics", r"automation", r"cloud", r"iot", r"scada", r"app(?:lication)?", r"data company", r"tech company",
    r"technology (?:provider|vendor|company|companies)", r"ai company", r"ai companies", r"machine learning", r"artificial intelligence", r"monitoring", r"optimization", r"optimisation",
)
SOLUTIONS = {
    "machine learning": r"machine learning|ml", "artificial intelligence": r"artificial intelligence", "ai": r"ai", "analytics": r"analytics|analytic|insights",
    "monitoring": r"monitoring|remote monitoring|surveillance", "optimization": r"optimization|optimisation|optimizer|optimiser", "automation": r"automation|automated|autonomous",
    "iot": r"iot|internet of things", "scada": r"scada", "digital twin": r"digital twin|digital twins", "predictive maintenance": r"predictive maintenance",
}
DOMAINS = {
    "wireline": r"wireline|wire line", "slickline": r"slickline|slick line", "e-line": r"e-line|eline|electric line", "well logging": r"well logging|well log(?:ging)?", "open hole logging": r"open[- ]hole logging",
    "cased hole logging": r"cased[- ]hole logging", "perforation": r"perforation|perforating", "memory gauge": r"memory gauges?", "well intervention": r"well intervention", "downhole tools": r"downhole tools?",
    "completion": r"completion services?|well completion", "coiled tubing": r"coiled tubing", "well testing": r"well testing|well test", "stimulation": r"stimulation|well stimulation",
    "acidizing": r"acidizing|acidising", "cementing": r"cementing", "mud logging": r"mud logging", "drilling fluids": r"drilling fluids|mud chemicals", "directional drilling": r"directional drilling",
    "geosteering": r"geosteering", "managed pressure drilling": r"managed pressure drilling|mpd", "drilling automation": r"drilling automation", "drilling monitoring": r"drilling monitoring|real[- ]time drilling",
    "drilling optimization": r"drilling optimization|drilling optimisation", "esp": r"esp|electrical submersible pump|electric submersible pump", "artificial lift": r"artificial lift", "gas lift": r"gas lift",
    "rod pump": r"rod pump", "virtual flow metering": r"virtual flow metering|virtual flow meter|virtual meter", "multiphase metering": r"multiphase metering|multiphase meter", "well surveillance": r"well surveillance",
    "production monitoring": r"production monitoring", "production optimization": r"production optimization|production optimisation", "well performance": r"well performance", "flow assurance": r"flow assurance",
    "well integrity": r"well integrity", "pipeline monitoring": r"pipeline monitoring", "leak detection": r"leak detection", "asset integrity": r"asset integrity", "inspection": r"inspection|ndt",
    "corrosion monitoring": r"corrosion monitoring", "reservoir simulation": r"reservoir simulation", "reservoir modeling": r"reservoir modeling|reservoir modelling", "production engineering": r"production engineering",
}
INTENTS = {"agent_or_distributor": r"agent|agency|distributor|distribution|local representation|representative|representation", "reseller": r"resellers?", "partner": r"partners?|channel partners?"}
SHORT_PLACES = {"uk": "united kingdom", "u.k.": "united kingdom", "uae": "united arab emirates", "u.a.e.": "united arab emirates", "usa": "united states", "u.s.a.": "united states", "u.s.": "united states", "us": "united states"}
# Words of a request that tell nothing of its topic.
STOP = tuple(
    """find show get search look for me please about inside outside working works worked operate operates operated operating with without and or in on to export into as from of the a an
    related companies company papers paper organizations organization events event products product people person list all some any give that are i want need can you help also then provide
    their its which where when how what who each every per this these those have has do does did is was been being be but across serving serve serves serviced suitable prioritize prioritise
    especially include including foreign local egyptian active less-known unknown""".split()
)
ASIDE = tuple(
    """email emails phone phones contact number numbers linkedin website websites url tel mobile address operating operates headquartered link links title titles author authors doi journal
    year date abstract citation paper papers research study studies pdf csv excel xlsx xls json file files export download output format report document""".split()
)
# What ends a topic.
ENDS = (
    r"\s+and\s+export\b", r"\s+export\b", r"\s+as\s+(?:a\s+)?pdf\b", r"\s+in\s+pdf\b", r"\s+pdf\s+(?:file|format)\b", r"\s+pdf\b$", r"\s+to\s+pdf\b", r"\s+i\s+need\b",
    r"\s+(?:give|provide|show|list)\s+(?:me\s+)?(?:the\s+)?(?:link|title|author|doi|abstract)\b",
    r"\s+with\s+(?:email|phone|contact|number|linkedin|website|url|tel|mobile|link|title|author)\b", r"\s+without\s+(?:email|phone|contact|number|linkedin)\b",
    r"\s+(?:outside|excluding|except|not\s+in|not\s+from|not\s+inside|not\s+within)\b", r"\s+(?:operate|operates|operating|work|works|working|serve|serves|serving)\s+outside\b",
    r"\s+(?:and\s+)?(?:do(?:es)?\s+not|don't|doesn't|cannot|can't)\s+(?:operate|work|serve|have|be)\b", r"\s+(?:and\s+)?(?:excluding|exclude|except|avoid|without)\b",
    r"\s+in\s+(?:europe|asia|africa|north america|south america|middle east|north africa|mena|cis|gcc|nordics|apac)\b", r"\s+prioriti[sz]e\b",
)
OF_INDUSTRY = (
    "company", "companies", "vendor", "vendors", "provider", "providers", "firm", "firms", "startup", "startups", "supplier", "suppliers", "technology company", "technology companies",
    "software company", "software companies", "digital company", "digital companies", "service", "services", "digital", "software", "technology", "tech", "analytics", "automation", "platform", "platforms",
    "saas", "cloud", "ai", "artificial intelligence", "machine learning", "data", "iot", "scada", "digitalization", "digitization", "app", "application", "monitoring", "optimization", "optimisation",
)
NEGATIVE = r"exclude|excluding|reject|remove|avoid|except|other than|not\s+(?:in|from|inside|within)|outside|without|no|has\s+no|with\s+no|do(?:es)?\s+not|don't|doesn't|cannot|can't"
PRESENCE = (
    r"\b(?:presence|office|offices|branch|branches|subsidiar(?:y|ies)|local entity|local entities|entity|entities|operations?|legal entity|legal entities|registered entity|registered entities|"
    r"distributor|distributors|agent|agents|representative|representation|partner|partners)\b",
    r"\b(?:operate(?:s|d|ing)?|work(?:s|ed|ing)?|serv(?:e|es|ed|ing)?|active|present)\s+outside\b",
    r"\b(?:do(?:es)?\s+not|don't|doesn't|cannot|can't|not)\s+(?:operate|work|serve|have|be\s+active|be\s+present)\b.*?\b(?:in|inside|within)\b",
    r"\b(?:outside|without presence|without offices?|without branches?)\b",
)
_SPLIT = r"(?=(?:do(?:es)?\s+not|don't|doesn't|excluding|exclude|except|without|avoid|remove|reject|other than|not\s+in|not\s+inside|not\s+within)\b)"
_word = lambda words: r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")\b"


def normal(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " ")))


def _first_of(t: Column, rules: dict[str, str], otherwise: str) -> Column:
    """The first name whose pattern a text has."""
    out = F.when(F.lit(False), "")
    for name, pattern in rules.items():
        out = out.when(t.rlike(pattern), name)
    return out.otherwise(otherwise)


def _all_of(t: Column, rules: dict[str, str]) -> Column:
    """The names whose patterns a text has, in order."""
    return F.array_compact(F.array(*[F.when(t.rlike(p), n) for n, p in rules.items()]))


def entity_types(t: Column) -> Column:
    found = _all_of(t, {k: _word(w) for k, w in ENTITIES.items()})
    # a manager of papers is no person asked for
    real = bound(found, lambda f: F.when(F.array_contains(f, "paper") & ~t.rlike("|".join(NAMES_PERSON)), F.array_remove(f, "person")).otherwise(f))
    return bound(real, lambda f: F.when(F.size(f) == 0, F.array(F.lit("company"))).otherwise(f))


def task_type(t: Column) -> Column:
    return _first_of(t, {k: "|".join(w) for k, w in TASKS.items()}, "entity_discovery")


def category(t: Column) -> Column:
    return F.when(t.rlike("|".join(SERVICES)), "service_company").when(t.rlike(r"\b(?:" + "|".join(DIGITAL) + r")\b"), "software_company").otherwise("general")


def solutions(t: Column) -> Column:
    return _all_of(t, {k: rf"\b(?:{p})\b" for k, p in SOLUTIONS.items()})


def domains(t: Column) -> Column:
    return _all_of(t, {k: rf"\b(?:{p})\b" for k, p in DOMAINS.items()})


def intent(t: Column) -> Column:
    return _first_of(t, {k: rf"\b(?:{p})\b" for k, p in INTENTS.items()}, "general")


def output_format(t: Column) -> Column:
    return _first_of(t, {k: _word(w) for k, w in FORMATS.items()}, "xlsx")


def max_results(t: Column) -> Column:
    """A number before what is counted; else the first that is no year; else 25."""
    counted = F.regexp_extract_all(t, F.lit(r"\b(\d{1,4})\s*(?:results?|companies|vendors|firms|records?|entries|items?|papers?)\b"), F.lit(1))
    loose = F.regexp_extract_all(t, F.lit(r"\b(\d{1,5})\b"), F.lit(1))
    fits = lambda array, years: F.get(F.filter(F.transform(array, lambda x: x.cast("int")), lambda n: n.between(1, 5000) & (F.lit(years) | ~n.between(1800, 2100))), F.lit(0))
    return F.coalesce(fits(counted, True), fits(loose, False), F.lit(25))


def with_long_places(t: Column) -> Column:
    """Short names of places spelled out, the longer first."""
    for short in sorted(SHORT_PLACES, key=len, reverse=True):
        t = F.regexp_replace(t, r"\b" + re.escape(short) + r"\b", SHORT_PLACES[short])
    return t


def clauses(t: Column) -> Column:
    """The pieces of a request between marks and before words that exclude."""
    apart = F.regexp_replace(F.regexp_replace(with_long_places(t), r"\b(?:and|but)\s+" + _SPLIT, ". "), r",\s*" + _SPLIT, ". ")
    return F.filter(F.transform(F.split(apart, r"[.;:!?]\s*|\n+"), lambda p: F.trim(p)), lambda p: p != "")


def geography(pieces: Column, found: Column) -> Column:
    """struct<include, exclude, exclude_presence, strict> from clauses and the places of each."""
    out = lambda p: p.rlike(rf"\b(?:{NEGATIVE})\b")
    absent = lambda p: p.rlike("|".join(PRESENCE))
    pairs = F.arrays_zip(pieces.alias("p"), found.alias("c"))
    of = lambda which: F.array_distinct(F.flatten(F.transform(F.filter(pairs, lambda x: which(x["p"])), lambda x: x["c"])))
    include, presence = of(lambda p: ~out(p)), of(lambda p: out(p) & absent(p))
    rules = F.struct(include.alias("include"), F.array_except(presence, include).alias("exclude_presence"), F.array_except(F.array_except(of(lambda p: out(p) & ~absent(p)), include), presence).alias("exclude"))
    return bound(rules, lambda r: F.struct(r["include"], r["exclude"], r["exclude_presence"], (F.size(r["include"]) + F.size(r["exclude"]) + F.size(r["exclude_presence"]) > 0).alias("strict")))


def attributes(t: Column, task: Column, strict: Column) -> Column:
    """Sorted attributes asked for; of documents always the author, with places always seat and presence."""
    found = _all_of(t, {k: _word(w) for k, w in ATTRIBUTES.items()})
    papers = task == "document_research"
    usual = F.when(papers, F.array(F.lit("website"), F.lit("summary"), F.lit("author"))).otherwise(F.array(F.lit("website")))
    own = bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(usual))
    none = F.array().cast("array<string>")
    more = F.concat(F.when(papers, F.array(F.lit("author"))).otherwise(none), F.when(strict, F.array(F.lit("presence_countries"), F.lit("hq_country"))).otherwise(none))
    return F.array_sort(F.array_distinct(F.concat(own, more)))


def industry_candidate(c: Column) -> Column:
    """A topic without words of companies and technology; oil and gas last."""
    t = F.regexp_replace(normal(c), r"\boil\s*(?:&|and)?\s*gas\b", "oil and gas")
    for phrase in sorted({*OF_INDUSTRY, *SERVICES}, key=lambda w: (-len(w), w)):
        t = F.regexp_replace(t, rf"\b{phrase}\b", " ")
    tidy = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" ,-"))
    return bound(tidy(t), lambda x: F.when(x.rlike(r"\boil and gas\b"), F.trim(F.concat_ws(" ", tidy(F.regexp_replace(x, r"\boil and gas\b", " ")), F.lit("oil and gas")))).otherwise(x))


def topic(c: Column) -> Column:
    """What a phrase is about: up to what ends it, without places, attributes and words of asking."""
    t = normal(c)
    for end in ENDS:
        t = F.trim(F.regexp_replace(t, rf"{end}.*$", ""))
    spelled = {*places.COUNTRY_ALIASES, *SHORT_PLACES, *places.US_STATES, *places.CANADIAN_PROVINCES, *places.AUSTRALIAN_STATES}
    off = F.array(*map(F.lit, sorted({*STOP, *ASIDE, *spelled})))
    return industry_candidate(F.array_join(F.filter(F.split(t, r"[\s,/]+"), lambda w: (w != "") & ~F.array_contains(off, w)), " "))


_THINGS = r"(?:companies|vendors|firms|providers|contractors?)"
#: Phrases whose inner part is the topic, in the order in which they are tried.
ABOUT = (
    r"(?:speciali[sz]ed in|focused on|focus on)\s+(.+?)\s+(?:for|in)\s+(?:the\s+)?oil(?:\s+and\s+gas|\s*&\s*gas)\b",
    r"(?:find|search for|get|show|list)\s+(.+?)\s+(?:service companies|service providers|contractors?|companies|vendors|firms)\b",
    _THINGS + r"\s+(?:speciali[sz]ing|focused|working|operating|active)\s+in\s+(.+)",
    _THINGS + r"\s+(?:in|for|serving)\s+(?:the\s+)?(.+?)\s+(?:sector|industry|space|field|market)\b",
    r"(?:working|operating|active|serving)\s+in\s+(?:the\s+)?(.+?)\s+(?:industry|sector|space|field)\b",
    r"(?:papers?|studies|articles?|reports?|publications?|theses?|preprints?|research|literature)\s+(?:about|on|related to|concerning|regarding)\s+(.+)",
)


def focus(t: Column, task: Column) -> Column:
    """The first phrase's topic that has any, else what is left of the whole request."""
    tried = F.filter(F.array(*[topic(F.regexp_extract(t, p, 1)) for p in ABOUT]), lambda x: F.length(x) > 1)
    rest = topic(t)
    return bound(F.coalesce(F.get(tried, F.lit(0)), rest), lambda f: F.when((f == "") & (task == "document_research"), "research").otherwise(f))


def industry(focus_term: Column, t: Column, domain: Column, solution: Column) -> Column:
    """The focus, led by keywords of the domain, or of the solution, where it does not have them."""
    oil = t.rlike(r"\boil(?:\s+and\s+gas|\s*&\s*gas)\b")

    def of(f: Column) -> Column:
        bare = (f == "") | (f == "oil and gas")
        led = lambda words, n: F.array_join(F.slice(words, 1, n), " ")
        own = F.exists(F.slice(domain, 1, 3), lambda k: f.contains(k))
        return (
            F.when((F.size(domain) > 0) & oil & bare, industry_candidate(F.concat(led(domain, 4), F.lit(" oil and gas"))))
            .when((F.size(domain) > 0) & ~bare & ~own, industry_candidate(F.concat_ws(" ", led(domain, 4), f)))
            .when((F.size(solution) > 0) & oil & bare, industry_candidate(F.concat(led(solution, 3), F.lit(" oil and gas"))))
            .when(oil & (f == ""), "oil and gas").otherwise(f)
        )

    return bound(industry_candidate(focus_term), of)


def parse(requests: DataFrame, text: str, g: Gazetteer) -> DataFrame:
    """requests with `task`: struct of all that is read from a request."""
    said = fenced(requests, {"seine_t": normal(F.col(text))})
    t = F.col("seine_t")
    cut = fenced(said, {"seine_pieces": clauses(t), "seine_task": task_type(t), "seine_domain": domains(t), "seine_solution": solutions(t)})
    placed = fenced(cut, {"seine_found": g.in_each(F.col("seine_pieces")), "seine_focus": focus(t, F.col("seine_task"))})
    ruled = fenced(placed, {"seine_geo": geography(F.col("seine_pieces"), F.col("seine_found"))})
    task = F.struct(
        F.col("seine_task").alias("task_type"), entity_types(t).alias("entity_types"), category(t).alias("category"), F.col("seine_domain").alias("domain_keywords"), F.col("seine_solution").alias("solution_keywords"),
        industry(F.col("seine_focus"), t, F.col("seine_domain"), F.col("seine_solution")).alias("industry"), F.col("seine_focus").alias("focus"), intent(t).alias("intent"),
        attributes(t, F.col("seine_task"), F.col("seine_geo.strict")).alias("attributes"), F.col("seine_geo").alias("geography"), output_format(t).alias("format"), max_results(t).alias("max_results"),
    )
    return ruled.select(*requests.columns, task.alias("task"))
