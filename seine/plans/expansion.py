"""Expansion of topics by a graph of terms: synonyms, sub-sectors, kinds of companies, places, titles and codes.

The graph is a table (bucket, cue, place, term): a term is proposed where its cue stands in the topic (of an industry: the
first industry with a cue), is the name of a place asked for, or stands in a position asked for. Each bucket keeps the order
in which terms come, drops repeats whatever their case, and is cut at its cap. Tasks meet the graph in an equi-join on the
cues they have; cues are found in one pass over a topic by the graph's distinct cues, of which there may be CUES.

Defined results: null topics, places and positions give no terms; repeated tasks are expanded each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seine.functions.text import bound, first_of_each, text_of

CAPS = {"synonyms": 8, "sub_sectors": 8, "company_types": 6, "geo_variants": 5, "job_variants": 12, "industry_codes": 4}
#: Distinct cues of a graph that are looked for in topics.
CUES = 5_000
#: Terms of one cue that count as synonyms.
OF_ONE = 4

# Terms by topic, in the order in which topics are tried.
TOPICS = {
    "oil gas": ("petroleum", "hydrocarbons", "upstream", "downstream", "oilfield"),
    "oil and gas": ("petroleum", "hydrocarbons", "upstream", "downstream", "oilfield"),
    "oilfield": ("oilfield services", "well services", "drilling services", "completion"),
    "oilfield service": ("well services", "drilling contractor", "completion services", "wireline", "cementing", "stimulation", "coiled tubing", "mud logging", "directional drilling", "ESP services"),
    "upstream": ("exploration", "production", "E&P", "drilling", "reservoir", "well completion", "artificial lift"),
    "downstream": ("refinery", "petrochemical", "LNG", "pipeline", "storage"),
    "drilling": ("rotary drilling", "directional drilling", "horizontal drilling", "drill bit", "drill string", "BHA", "MWD", "LWD"),
    "petroleum engineer": ("reservoir engineer", "drilling engineer", "production engineer", "completion engineer", "wellsite engineer"),
    "digital oil gas": ("digital oilfield", "IIoT energy", "Industry 4.0 oil gas", "digital transformation energy", "upstream software", "production optimization software", "SCADA oil gas"),
    "esp": ("electrical submersible pump", "artificial lift", "downhole pump", "submersible motor pump"),
    "pipeline": ("pipeline integrity", "pipeline inspection", "pig", "flow assurance", "pipeline operations"),
    "energy": ("power", "utilities", "electricity", "renewables", "fossil fuel"),
    "renewable energy": ("solar energy", "wind energy", "green energy", "clean energy", "photovoltaic", "wind turbine", "energy storage"),
    "solar": ("photovoltaic", "PV", "solar panel", "solar farm", "solar power"),
    "wind": ("wind turbine", "wind farm", "offshore wind", "onshore wind"),
    "software": ("SaaS", "platform", "cloud software", "enterprise software", "digital solution", "technology platform"),
    "digital": ("digital transformation", "Industry 4.0", "IoT", "AI", "machine learning", "automation", "cloud computing"),
    "analytics": ("data analytics", "big data", "business intelligence", "BI", "predictive analytics", "real-time monitoring"),
    "ai": ("artificial intelligence", "machine learning", "deep learning", "neural network", "predictive", "NLP"),
    "cybersecurity": ("information security", "network security", "OT security", "industrial cybersecurity", "cyber defense", "SCADA security"),
    "fintech": ("financial technology", "payments", "banking software", "insurtech", "regtech", "blockchain"),
    "healthcare": ("medical", "health tech", "pharma", "clinical", "hospital", "telemedicine", "medtech", "life sciences"),
    "engineering": ("EPC", "technical services", "consulting engineering", "project management", "FEED", "detailed design"),
    "manufacturing": ("industrial manufacturing", "production", "assembly", "process manufacturing", "OEM"),
    "construction": ("building", "infrastructure", "EPC contractor", "civil engineering", "structural"),
    "maintenance": ("MRO", "predictive maintenance", "preventive maintenance", "asset integrity", "condition monitoring"),
    "engineer": ("engineering professional", "technical specialist", "petroleum engineer", "mechanical engineer", "electrical engineer", "process engineer", "control engineer"),
    "manager": ("management professional", "project manager", "operations manager", "technical manager", "business development manager"),
    "hr": ("human resources", "talent acquisition", "recruitment", "people operations", "workforce management"),
    "director": ("VP", "vice president", "executive", "head of", "general manager"),
    "egypt": ("cairo", "alexandria", "EGPC", "Egyptian", "Nile delta"),
    "saudi arabia": ("KSA", "saudi", "aramco", "SABIC", "riyadh"),
    "uae": ("dubai", "abu dhabi", "emirates", "ADNOC"),
    "usa": ("united states", "american", "US-based", "houston", "texas"),
}
# Industries by cue words, the first that fits: kinds of companies, sub-sectors and codes.
INDUSTRIES = (
    (("oil", "gas", "petroleum", "oilfield", "upstream"),
     ("oilfield services company", "drilling contractor", "EPC contractor", "well services provider", "production services company", "subsurface solutions company", "integrated energy company"),
     ("upstream exploration", "drilling services", "completion services", "well intervention", "production optimization", "pipeline services", "offshore services", "onshore services"),
     ("SIC 1311 crude petroleum gas", "SIC 1381 drilling oil gas wells", "NAICS 211 oil gas extraction", "NAICS 213 support activities mining")),
    (("software", "digital", "saas", "platform", "tech"),
     ("SaaS company", "technology vendor", "software developer", "digital solutions provider", "cloud platform company"),
     ("enterprise software", "cloud computing", "data analytics", "AI/ML solutions", "IoT platform"), ()),
    (("renewable", "solar", "wind", "clean energy"),
     ("solar developer", "wind energy company", "EPC solar", "energy storage provider", "green energy startup"),
     ("utility-scale solar", "distributed solar", "offshore wind", "onshore wind", "battery storage", "green hydrogen"), ()),
    (("healthcare", "medical", "pharma", "health"),
     ("hospital", "pharmaceutical company", "medical device company", "health tech startup", "clinical research organization"),
     ("diagnostics", "therapeutics", "medical devices", "digital health", "telemedicine"), ()),
    (("fintech", "financial", "banking", "payment"),
     ("fintech startup", "digital bank", "payment processor", "insurtech company", "robo-advisor"),
     ("digital payments", "lending", "wealthtech", "insurtech", "regtech", "blockchain"), ()),
)
# Titles by level, and titles of the oil industry.
LEVELS = {
    "engineer": ("engineer", "engineering", "specialist", "analyst", "technologist", "technical", "geologist", "geophysicist", "physicist"),
    "manager": ("manager", "supervisor", "team lead", "project manager", "section head", "superintendent", "foreman", "coordinator"),
    "director": ("director", "vice president", "VP", "head of", "general manager", "GM", "C-suite", "CEO", "COO", "CTO", "president"),
    "hr": ("HR", "human resources", "talent", "recruitment", "recruiter", "people", "workforce", "learning development", "L&D"),
    "executive": ("executive", "C-level", "leadership", "board", "managing director", "MD"),
}
OIL_CUES = ("oil", "gas", "petroleum")
OIL_TITLES = (
    "petroleum engineer", "reservoir engineer", "drilling engineer", "production engineer", "completion engineer", "wellsite engineer", "facilities engineer", "process engineer",
    "HSE manager", "operations manager", "project manager", "technical director", "business development manager", "HR manager", "talent acquisition",
)

SCHEMA = "kind string, bucket string, cue string, place int, term string"


def default_graph() -> list[tuple[str, str, str, int, str]]:
    """(kind, bucket, cue, place, term): how a cue is met (topic, industry, geography, position), and where a term stands."""
    out = []
    for k, (cue, terms) in enumerate(TOPICS.items()):
        out += [("topic", "synonyms", cue, 100 * k + i, t) for i, t in enumerate(terms[:OF_ONE])]
        out += [("geography", "geo_variants", cue, i, t) for i, t in enumerate(terms)]
    for k, (cues, *buckets) in enumerate(INDUSTRIES):
        for cue in cues:
            out += [("industry", bucket, cue, 100 * k + i, t) for bucket, terms in zip(("company_types", "sub_sectors", "industry_codes"), buckets, strict=True) for i, t in enumerate(terms)]
    for k, (cue, terms) in enumerate(LEVELS.items()):
        out += [("position", "job_variants", cue, 100 * k + i, t) for i, t in enumerate(terms)]
    return out + [("titles", "job_variants", cue, 1_000_000 + i, t) for cue in OIL_CUES for i, t in enumerate(OIL_TITLES)]


def graph_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_graph(), SCHEMA)


def expanded(tasks: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """(key, bucket, n, term) of tasks (key, topic, entity, task_type, geography array, positions array)."""
    cues = [r.cue for r in graph.select("cue").distinct().orderBy("cue").limit(CUES + 1).collect()]
    if len(cues) > CUES:
        raise ValueError(f"over {CUES} cues")
    known = F.array(*map(F.lit, cues)) if cues else F.array().cast("array<string>")
    people = (F.col("entity") == "person") | (F.col("task_type") == "people_search")
    at = tasks.withColumn("seine_task", F.monotonically_increasing_id())
    none = F.array().cast("array<string>")
    asked = F.flatten(F.array(
        bound(F.lower(text_of(F.col("topic"))), lambda t: F.flatten(F.transform(F.filter(known, lambda c: t.contains(c)), lambda c: F.transform(F.array(F.lit("topic"), F.lit("industry"), F.lit("titles")), lambda k: F.struct(k.alias("kind"), c.alias("cue"), F.lit(0).alias("nth")))))),
        F.transform(F.coalesce("geography", none), lambda g, i: F.struct(F.lit("geography").alias("kind"), F.lower(g).alias("cue"), i.alias("nth"))),
        F.flatten(F.transform(F.coalesce("positions", none), lambda p, i: F.transform(F.filter(known, lambda c: F.lower(p).contains(c)), lambda c: F.struct(F.lit("position").alias("kind"), c.alias("cue"), i.alias("nth"))))),
    ))
    met = at.select(key, "seine_task", F.coalesce(people, F.lit(False)).alias("people"), F.explode(asked).alias("a")).select(key, "seine_task", "people", "a.*").join(graph, ["kind", "cue"])
    met = met.filter(F.col("people") | ~F.col("kind").isin("position", "titles"))
    # of industries the first one alone; each begins at a hundred of its own
    first = F.min(F.when(F.col("kind") == "industry", F.floor(F.col("place") / 100))).over(Window.partitionBy("seine_task"))
    one = met.withColumn("seine_first", first).filter((F.col("kind") != "industry") | (F.floor(F.col("place") / 100) == F.col("seine_first")))
    terms = one.groupBy(key, "seine_task", "bucket").agg(F.array_sort(F.collect_set(F.struct("nth", "place", "term"))).alias("t"))
    cap = F.create_map(*[x for b, n in CAPS.items() for x in (F.lit(b), F.lit(n))])
    kept = F.slice(first_of_each(F.transform("t", lambda x: x["term"])), F.lit(1), F.try_element_at(cap, F.col("bucket")))
    return terms.select(key, "bucket", F.posexplode(kept).alias("n", "term"))


def worded(base: Column, terms: Column, geography: Column, entity: Column) -> Column:
    """Queries made of terms: each with the kind of thing asked for and the first place, and the first three with the topic."""
    place = F.coalesce(F.get(geography, F.lit(0)), F.lit(""))
    kind = F.when(entity == "person", F.lit(None)).otherwise(entity)
    tidy = lambda *parts: F.trim(F.regexp_replace(F.concat_ws(" ", *parts), r"\s+", " "))
    every = F.concat(F.transform(terms, lambda t: tidy(t, kind, place)), F.transform(F.slice(terms, 1, 3), lambda t: tidy(base, t, place)))
    return F.filter(every, lambda q: q != "")
