"""Labels of texts in both languages, by words that speak for them.

A text is lower-cased, without signs that only set letters apart or turn them round, and with single blanks; a word speaks
for its label wherever it stands, inside other words too. Votes go to the label with most words, the first by name of equals.

Defined results: a null text says nothing; things asked for are then companies, category and intent are general.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seine.functions.text import bound, text_of

# Words by kind of thing.
ENTITIES = {
    "company": ("company", "companies", "vendor", "provider", "supplier", "firm", "contractor", "startup", "business", "enterprise", "شركة", "شركات", "مورد", "مزود", "مقاول"),
    "paper": ("paper", "papers", "study", "studies", "article", "articles", "publication", "publications", "journal", "thesis", "literature", "ورقة", "اوراق", "أوراق", "بحث", "ابحاث", "أبحاث", "دراسة", "دراسات", "مقال", "مقالات"),
    "person": ("person", "people", "profile", "profiles", "expert", "engineer", "manager", "director", "founder", "researcher", "consultant", "linkedin", "شخص", "أشخاص", "مهندس", "مدير", "باحث", "خبير", "لينكدان", "لينكد إن"),
    "organization": ("organization", "organisation", "association", "university", "lab", "منظمة", "جامعة", "مختبر"),
    "event": ("event", "conference", "expo", "summit", "webinar", "exhibitor", "speaker", "مؤتمر", "معرض", "فعالية"),
    "product": ("product", "products", "tool", "software", "platform", "solution", "منتج", "أداة", "منصة", "حل"),
    "patent": ("patent", "patents", "براءة", "براءات"),
    "tender": ("tender", "rfp", "rfq", "procurement", "vendor list", "مناقصة", "عطاء", "توريد"),
    "dataset": ("dataset", "datasets", "data set", "benchmark", "بيانات", "مجموعة بيانات"),
    "news": ("news", "updates", "press release", "خبر", "أخبار", "اخبار"),
}
# Words by kind of organisation.
CATEGORIES = {
    "software_company": ("digital", "software", "saas", "platform", "analytics", "automation", "ai", "artificial intelligence", "machine learning", "iot", "scada", "cloud", "technology company", "tech company", "رقمي", "رقمية", "برمجيات", "منصة", "منصات", "ذكاء اصطناعي", "تحليلات", "أتمتة", "انترنت الاشياء"),
    "service_company": ("service company", "service companies", "contractor", "contractors", "engineering services", "oilfield services", "inspection", "maintenance", "testing", "wireline", "slickline", "well logging", "شركة خدمات", "شركات خدمات", "خدمات هندسية", "مقاول", "صيانة", "تفتيش", "اختبار"),
    "manufacturer": ("manufacturer", "manufacturing", "factory", "fabrication", "مصنع", "تصنيع", "تصنيع"),
    "consultancy": ("consulting", "consultancy", "advisor", "advisory", "استشارات", "استشاري"),
    "operator": ("operator", "operators", "مشغل", "مشغلين"),
    "general": (),
}
# Words by what business is meant.
INTENTS = {
    "agent_or_distributor": ("agent", "agency", "distributor", "distribution", "representative", "representation", "local representative", "وكيل", "توكيل", "موزع", "توزيع", "ممثل محلي"),
    "reseller": ("reseller", "resellers", "إعادة بيع", "ريسيلر"),
    "partner": ("partner", "partners", "channel partner", "alliance", "شريك", "شراكة"),
    "recruiting": ("hire", "hiring", "recruit", "recruitment", "وظائف", "توظيف"),
    "competitor_research": ("competitor", "competition", "منافس", "منافسين"),
    "supplier_discovery": ("supplier", "supplier discovery", "مورد", "مورّد"),
    "academic": ("research", "academic", "literature", "أكاديمي", "بحثي"),
    "general": (),
}
# Words by industry.
INDUSTRIES = {
    "oil and gas": ("oil and gas", "oil & gas", "petroleum", "oilfield", "upstream", "midstream", "downstream", "النفط والغاز", "بترول", "البترول", "حقول النفط"),
    "energy": ("energy", "power", "utilities", "الطاقة", "الكهرباء"),
    "manufacturing": ("manufacturing", "factory", "industrial", "food manufacturing", "manufacturing sector", "التصنيع", "صناعي"),
    "healthcare": ("healthcare", "medical", "hospital", "pharma", "life sciences", "الرعاية الصحية", "طبي", "دوائي"),
    "software": ("software", "saas", "enterprise software", "برمجيات", "برمجي"),
    "academia": ("academic", "research", "university", "lab", "أكاديمي", "جامعة", "مختبر"),
    "finance": ("finance", "banking", "fintech", "financial services", "تمويل", "بنوك", "فنتك"),
    "telecom": ("telecom", "telecommunications", "communications", "اتصالات", "اتصالات"),
    "construction": ("construction", "building", "infrastructure", "انشاءات", "بناء", "بنية تحتية"),
    "mining": ("mining", "metals", "minerals", "تعدين", "معادن"),
    "agriculture": ("agriculture", "agri", "farming", "زراعة"),
    "ccs": ("ccs", "carbon capture", "carbon capture and storage", "احتجاز الكربون"),
}
# Words by kind of solution.
SOLUTIONS = {
    "machine learning": ("machine learning", "ml", "تعلم الآلة"),
    "artificial intelligence": ("artificial intelligence", "ذكاء اصطناعي"),
    "ai": ("ai",),
    "analytics": ("analytics", "analytic", "تحليلات"),
    "monitoring": ("monitoring", "remote monitoring", "مراقبة"),
    "optimization": ("optimization", "optimisation", "تحسين"),
    "automation": ("automation", "automated", "أتمتة"),
    "iot": ("iot", "internet of things", "انترنت الاشياء", "إنترنت الأشياء"),
    "scada": ("scada",),
    "digital twin": ("digital twin", "توأم رقمي"),
    "predictive maintenance": ("predictive maintenance", "صيانة تنبؤية"),
}
# Words by field of the oil industry.
DOMAINS = {
    "wireline": ("wireline", "وايرلاين"),
    "slickline": ("slickline", "سليك لاين", "سلك لاين"),
    "e-line": ("e-line", "electric line"),
    "well logging": ("well logging", "logging", "تسجيل آبار", "قياسات الآبار"),
    "coiled tubing": ("coiled tubing", "كويلد تيوبنج"),
    "well testing": ("well testing", "اختبار الآبار"),
    "mud logging": ("mud logging", "تسجيل الطفلة"),
    "drilling": ("drilling", "حفر"),
    "drilling optimization": ("drilling optimization", "تحسين الحفر"),
    "esp": ("esp", "electrical submersible pump", "مضخة غاطسة كهربائية"),
    "artificial lift": ("artificial lift", "رفع صناعي"),
    "production optimization": ("production optimization", "تحسين الإنتاج"),
    "well surveillance": ("well surveillance", "مراقبة الآبار"),
    "multiphase metering": ("multiphase metering", "قياس متعدد الأطوار"),
    "flow assurance": ("flow assurance", "ضمان الانسياب"),
    "reservoir simulation": ("reservoir simulation", "محاكاة المكامن"),
    "reservoir modeling": ("reservoir modeling", "reservoir modelling", "نمذجة المكامن"),
    "pipeline inspection": ("pipeline inspection", "فحص خطوط الأنابيب"),
    "asset integrity": ("asset integrity", "سلامة الأصول"),
}


def label(text: str) -> str:
    """A word as it is looked for."""
    return " ".join("".join(c for c in text.strip().lower() if c not in "\u0640\u200f\u200e").split())


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.trim(text_of(c))), "\u0640\u200f\u200e", ""), r"(?U)\s+", " "))


def found(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The labels that a text has a word of, their own names being words too, in the table's order."""

    def of(t: Column) -> Column:
        tried = [F.when(F.exists(F.array(*[F.lit(label(w)) for w in (name, *words)]), lambda w: t.contains(w)), name) for name, words in table.items()]
        return F.array_compact(F.array(*tried))

    return bound(normal(c), of)


def voted(c: Column, table: dict[str, tuple[str, ...]], otherwise: str = "general") -> Column:
    """The label with most of its words in a text; `otherwise` if none has any."""

    def of(t: Column) -> Column:
        votes = [F.struct((-F.size(F.filter(F.array(*[F.lit(label(w)) for w in words]), lambda w: t.contains(w)))).alias("n"), F.lit(name).alias("name")) for name, words in table.items() if words and name != otherwise]
        best = F.array_min(F.array(*votes))
        return F.when(best["n"] < 0, best["name"]).otherwise(otherwise)

    return bound(normal(c), of)


def entity_types(c: Column) -> Column:
    return bound(found(c, ENTITIES), lambda f: F.when(F.size(f) == 0, F.array(F.lit("company"))).otherwise(f))
