"""Column functions that give codes their names, and records, prompts and files their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import text_of

# Names of codes.
TASK_TYPES = {
    "entity_discovery": "🏢 Companies", "document_research": "📄 Research Papers", "people_search": "👥 LinkedIn Profiles",
    "market_research": "📊 Market Research", "entity_enrichment": "🧩 Entity Enrichment", "similar_entity_expansion": "🧭 Similar Entities",
}
CATEGORIES = {"software_company": "Digital / software companies", "service_company": "Service / engineering companies", "general": "General companies"}
INTENTS = {"general": "General", "agent_or_distributor": "Agent / distributor", "reseller": "Reseller", "partner": "Partner / channel partner"}
LEVELS = {
    "engineer": "engineering and technical", "manager": "management and supervisory", "director": "director and VP", "hr": "HR and talent acquisition",
    "executive": "executive and C-suite", "research": "research and academic", "sales": "sales and business development",
}
EXTENSIONS = ("xlsx", "csv", "pdf", "json")
CACHE_VERSION = "v3_0"


def named(code: Column, names: dict[str, str], other: Column) -> Column:
    """The name of a code, else `other`."""
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.otherwise(other)


def title_case(code: Column) -> Column:
    return F.initcap(F.replace(code, F.lit("_"), F.lit(" ")))


def task_type(code: Column) -> Column:
    return named(text_of(code), TASK_TYPES, F.lit("🔍 Entities"))


def category(code: Column) -> Column:
    """An empty category is a general one; codes without a name are spelled with capitals."""
    code = text_of(code)
    return named(F.trim(code), CATEGORIES, F.when(code == "", "General").otherwise(title_case(code)))


def intent(code: Column) -> Column:
    code = F.coalesce(F.nullif(text_of(code), F.lit("")), F.lit("general"))
    return named(F.trim(code), INTENTS, title_case(code))


def shown_category(task: Column, entity: Column, code: Column) -> Column:
    """What a search is for: its task and the kind of entity come before the category."""
    task, entity = F.trim(text_of(task)), F.coalesce(F.nullif(text_of(entity), F.lit("")), F.lit("company"))
    return (
        F.when((task == "document_research") | (entity == "paper"), "Research / academic sources")
        .when((task == "people_search") | (entity == "person"), "People / LinkedIn profiles")
        .when(entity == "tender", "Tenders / procurement").when(entity == "product", "Products / platforms")
        .otherwise(category(code))
    )


def entity_of_task(task: Column) -> Column:
    t = F.lower(F.trim(text_of(task)))
    return F.when(t == "document_research", "paper").when(t == "people_search", "person").otherwise("company")


def level(code: Column) -> Column:
    """The phrase of the first level that stands in the code; else the code, or a professional."""
    low, out = F.lower(text_of(code)), None
    for k, v in LEVELS.items():
        out = F.when(low.contains(k), v) if out is None else out.when(low.contains(k), v)
    return out.otherwise(F.coalesce(F.nullif(text_of(code), F.lit("")), F.lit("professional")))


def file_name(name: Column, kind: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """A file's name with the ending of its kind in place of a known one; unknown kinds are spreadsheets."""
    stem = F.regexp_replace(F.trim(F.coalesce(F.nullif(name, F.lit("")), F.lit("results"))), rf"(?i)\.(?:{'|'.join(extensions)})$", "")
    return F.concat(stem, F.lit("."), F.when(kind.isin(*extensions), kind).otherwise("xlsx"))


def titles(items: Column) -> Column:
    """The filled items of a list, stripped, each word with a capital."""
    return F.transform(F.filter(F.transform(items, lambda s: F.trim(text_of(s))), lambda s: s != ""), F.initcap)


def snapshot_key(name: Column, url: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(text_of(name))), F.lower(F.trim(text_of(url))))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("::", F.lit(CACHE_VERSION), *[F.lower(F.trim(text_of(p))) for p in parts])


def prompt_key(prompt: Column) -> Column:
    return F.md5(text_of(prompt).cast("binary"))


def reviewed_rank(notes: Column) -> Column:
    """The rank that a reviewer left in a record's notes; null if none."""
    return F.nullif(F.regexp_extract(text_of(notes), "llm_rank:([0-9]+)/10", 1), F.lit("")).cast("int")


def json_in(answer: Column) -> Column:
    """The JSON of an answer that may stand in fences or among words; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text_of(answer)), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    whole = lambda s: F.when(F.try_parse_json(s).isNotNull() & (s != ""), s)
    return F.coalesce(whole(bare), whole(F.regexp_extract(bare, r"(?s)\{.*\}", 0)), whole(F.regexp_extract(bare, r"(?s)\[.*\]", 0)))


# Words of a topic that say whom to look for, not what about.
JOB_WORDS = ("engineer", "manager", "director", "recruiter", "talent", "human resources", "hr", "executive", "ceo", "coo", "cto", "cfo", "president", "professor")
COMPANY_WORDS = (
    "company", "companies", "vendor", "vendors", "provider", "providers", "firm", "firms", "contractor", "contractors",
    "organization", "organisations", "business", "businesses",
)


def people_topic(c: Column) -> Column:
    """The lower-cased words of a topic without those for jobs and companies; the whole topic if none is left."""
    low = F.lower(F.trim(F.regexp_replace(text_of(c), r"\s+", " ")))
    left = F.array_join(F.filter(F.split(low, r"[\s,/]+"), lambda w: (w != "") & ~w.isin(*JOB_WORDS, *COMPANY_WORDS)), " ")
    return F.when(left != "", left).when(low != "", low).otherwise("industry")
