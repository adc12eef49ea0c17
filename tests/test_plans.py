"""Requests read, and topics expanded, against results written out by hand."""

from pyspark.sql import functions as F

from seine.operators import gazetteer
from seine.plans import expansion, parser

GULF = ["bahrain", "kuwait", "oman", "qatar", "saudi arabia", "united arab emirates"]
REQUESTS = [
    ("Find wireline service companies in Egypt and exclude Norway, with email and phone. Export to CSV", {
        "task_type": "entity_discovery", "entity_types": ["company"], "category": "service_company", "domain_keywords": ["wireline"], "industry": "wireline", "intent": "general",
        "attributes": ["email", "hq_country", "phone", "presence_countries"], "include": ["egypt"], "exclude": ["norway"], "exclude_presence": [], "format": "csv", "max_results": 25,
    }),
    ("List 40 digital oil & gas companies in the GCC, without offices in the USA", {
        "task_type": "entity_discovery", "category": "software_company", "include": GULF, "exclude_presence": ["usa"], "exclude": [], "max_results": 40, "industry": "40 oil and gas", "format": "xlsx",
    }),
    ("papers about machine learning for reservoir simulation in pdf, 2019", {
        "task_type": "document_research", "entity_types": ["paper"], "solution_keywords": ["machine learning"], "domain_keywords": ["reservoir simulation"], "format": "pdf", "max_results": 25,
        "industry": "reservoir simulation", "attributes": ["author", "pdf"],
    }),
    ("people working at drilling contractors in Texas, top 15 results as JSON", {"task_type": "people_search", "entity_types": ["company", "person"], "include": ["usa"], "max_results": 15, "format": "json", "category": "service_company"}),
    ("similar companies to a solar vendor that do not operate in the UK", {"task_type": "similar_entity_expansion", "include": [], "exclude_presence": ["united kingdom"], "exclude": []}),
    ("looking for a local distributor of water pumps", {"intent": "agent_or_distributor", "industry": "looking distributor water pumps"}),
    (None, {"task_type": "entity_discovery", "entity_types": ["company"], "category": "general", "industry": "", "attributes": ["website"], "max_results": 25, "include": [], "format": "xlsx"}),
]


def test_requests(spark):
    frame = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REQUESTS)], "i int, request string")
    got = {r.i: r.task.asDict(recursive=True) for r in parser.parse(frame, "request", gazetteer.Gazetteer(spark)).collect()}
    for i, (request, want) in enumerate(REQUESTS):
        found = got[i] | got[i]["geography"]
        assert {k: found[k] for k in want} == want, request


def test_expansion(spark):
    tasks = [
        (1, "Digital oil gas", "company", "entity_discovery", ["USA", "Egypt"], None), (2, "gasket makers", "person", "people_search", None, ["HR Manager", "x"]),
        (3, None, None, None, ["Atlantis"], []), (4, "solar software", "company", "x", None, ["manager"]), (4, "solar software", "company", "x", None, ["manager"]),
    ]
    frame = spark.createDataFrame(tasks, "id int, topic string, entity string, task_type string, geography array<string>, positions array<string>")
    rows = expansion.expanded(frame, expansion.graph_of(spark), "id").collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.bucket, r.n)):
        got.setdefault((r.id, r.bucket), []).append(r.term)
    assert got[1, "synonyms"] == ["petroleum", "hydrocarbons", "upstream", "downstream", "digital oilfield", "IIoT energy", "Industry 4.0 oil gas", "digital transformation energy"]
    assert got[1, "geo_variants"] == ["united states", "american", "US-based", "houston", "texas"] and got[1, "company_types"][:2] == ["oilfield services company", "drilling contractor"] and len(got[1, "company_types"]) == 6
    assert (1, "job_variants") not in got and got[1, "industry_codes"][0] == "SIC 1311 crude petroleum gas"
    assert got[2, "job_variants"] == [*expansion.LEVELS["manager"], "HR", "human resources", "talent", "recruitment"]
    assert not any(k[0] == 3 for k in got)
    assert got[4, "company_types"] == [t for t in expansion.INDUSTRIES[1][1] for _ in range(2)] and got[4, "synonyms"][:2] == ["photovoltaic"] * 2
    queries = spark.range(1).select(expansion.worded(F.lit("wells"), F.array(*map(F.lit, "abcd")), F.array(F.lit("Oslo")), F.lit("company")).alias("c"), expansion.worded(F.lit("wells"), F.array(F.lit("a")), F.array().cast("array<string>"), F.lit("person")).alias("p")).first()
    assert queries.c == ["a company Oslo", "b company Oslo", "c company Oslo", "d company Oslo", "wells a Oslo", "wells b Oslo", "wells c Oslo"] and queries.p == ["a", "wells a"]
