"""Fixed values of geography: spellings of countries, states and provinces, and the members of regions."""

# Countries and how else they are spelled.
COUNTRY_ALIASES = {
    "usa": ("usa", "us", "u.s.", "u.s.a.", "united states", "united states of america", "america", "the us", "the usa", "the united states", "أمريكا", "الولايات المتحدة"),
    "canada": ("canada", "ca"), "mexico": ("mexico", "méxico"), "brazil": ("brazil", "brasil"), "argentina": ("argentina",), "chile": ("chile",),
    "colombia": ("colombia",), "peru": ("peru", "perú"), "venezuela": ("venezuela",), "ecuador": ("ecuador",), "bolivia": ("bolivia",), "uruguay": ("uruguay",),
    "paraguay": ("paraguay",),
    "united kingdom": ("uk", "u.k.", "united kingdom", "britain", "great britain", "england", "scotland", "wales", "northern ireland", "بريطانيا", "المملكة المتحدة"),
    "ireland": ("ireland", "eire"), "france": ("france",), "germany": ("germany", "deutschland"), "italy": ("italy", "italia"), "spain": ("spain", "españa"),
    "portugal": ("portugal",), "netherlands": ("netherlands", "holland", "the netherlands"), "belgium": ("belgium",), "switzerland": ("switzerland",),
    "austria": ("austria",), "norway": ("norway",), "sweden": ("sweden",), "denmark": ("denmark",), "finland": ("finland",), "poland": ("poland",),
    "czech republic": ("czech republic", "czechia", "czech"), "romania": ("romania",), "greece": ("greece",), "turkey": ("turkey", "türkiye"), "hungary": ("hungary",),
    "ukraine": ("ukraine",), "russia": ("russia", "russian federation"), "serbia": ("serbia",), "croatia": ("croatia",), "bulgaria": ("bulgaria",),
    "slovakia": ("slovakia",), "slovenia": ("slovenia",), "estonia": ("estonia",), "latvia": ("latvia",), "lithuania": ("lithuania",), "luxembourg": ("luxembourg",),
    "iceland": ("iceland",), "saudi arabia": ("saudi arabia", "ksa", "kingdom of saudi arabia", "السعودية", "المملكة العربية السعودية"),
    "united arab emirates": ("uae", "u.a.e", "u.a.e.", "united arab emirates", "emirates", "the uae", "الإمارات", "الامارات", "الإمارات العربية المتحدة"),
    "qatar": ("qatar", "قطر"), "oman": ("oman", "sultanate of oman", "عمان"), "kuwait": ("kuwait", "الكويت"), "bahrain": ("bahrain", "البحرين"), "iraq": ("iraq",),
    "iran": ("iran",), "jordan": ("jordan",), "lebanon": ("lebanon",), "israel": ("israel",), "syria": ("syria",), "yemen": ("yemen",),
    "egypt": ("egypt", "arab republic of egypt", "مصر", "جمهورية مصر العربية"), "libya": ("libya",), "algeria": ("algeria",), "tunisia": ("tunisia",),
    "morocco": ("morocco",), "south africa": ("south africa",), "nigeria": ("nigeria",), "angola": ("angola",), "kenya": ("kenya",), "ghana": ("ghana",),
    "ethiopia": ("ethiopia",), "mozambique": ("mozambique",), "tanzania": ("tanzania",), "zambia": ("zambia",), "cameroon": ("cameroon",), "senegal": ("senegal",),
    "ivory coast": ("ivory coast", "côte d'ivoire", "cote d'ivoire"), "india": ("india", "bharat"), "pakistan": ("pakistan",), "bangladesh": ("bangladesh",),
    "sri lanka": ("sri lanka",), "china": ("china", "prc", "people's republic of china"), "japan": ("japan",),
    "south korea": ("south korea", "korea", "republic of korea"), "north korea": ("north korea",), "taiwan": ("taiwan",), "hong kong": ("hong kong", "hk"),
    "singapore": ("singapore",), "malaysia": ("malaysia",), "indonesia": ("indonesia",), "thailand": ("thailand",), "vietnam": ("vietnam", "viet nam"),
    "philippines": ("philippines",), "myanmar": ("myanmar", "burma"), "cambodia": ("cambodia",), "laos": ("laos",), "mongolia": ("mongolia",),
    "australia": ("australia",), "new zealand": ("new zealand", "nz"), "papua new guinea": ("papua new guinea",), "fiji": ("fiji",), "kazakhstan": ("kazakhstan",),
    "azerbaijan": ("azerbaijan",), "uzbekistan": ("uzbekistan",), "turkmenistan": ("turkmenistan",), "kyrgyzstan": ("kyrgyzstan",), "tajikistan": ("tajikistan",),
    "georgia": ("georgia",), "armenia": ("armenia",),
}

# States, provinces and territories of usa, and their unambiguous short forms.
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia state", "hawaii", "idaho", "illinois",
    "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana",
    "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york state", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington state", "west virginia",
    "wisconsin", "wyoming", "district of columbia", "washington dc", "washington d.c.", "puerto rico", "guam", "us virgin islands", "american samoa",
    "northern mariana islands", "al", "ak", "az", "ar", "ct", "fl", "ga", "il", "ia", "ks", "ky", "la", "md", "mi", "mn", "mo", "ne", "nv", "nh", "nj", "nm", "ny", "nc",
    "nd", "oh", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wv", "wi", "wy", "dc",
)

# States, provinces and territories of canada, and their unambiguous short forms.
CANADIAN_PROVINCES = (
    "ontario", "quebec", "british columbia", "alberta", "manitoba", "saskatchewan", "nova scotia", "new brunswick", "newfoundland and labrador", "prince edward island",
    "northwest territories", "nunavut", "yukon", "qc", "bc", "ab", "mb", "sk", "ns", "nb", "nl", "pe",
)

# States, provinces and territories of australia, and their unambiguous short forms.
AUSTRALIAN_STATES = (
    "new south wales", "victoria", "queensland", "western australia", "south australia", "tasmania", "northern territory", "australian capital territory", "nsw", "vic",
    "qld", "wa", "sa", "tas", "nt", "act",
)

# Arabic names of regions.
ARABIC_REGIONS = {
    "الخليج": "gcc", "دول الخليج": "gcc", "اوروبا": "europe", "أوروبا": "europe", "الشرق الاوسط": "middle east", "الشرق الأوسط": "middle east",
    "شمال افريقيا": "north africa", "شمال أفريقيا": "north africa",
}

# Regions and their members.
REGIONS = {
    "europe": (
        "united kingdom", "france", "germany", "italy", "spain", "portugal", "netherlands", "belgium", "switzerland", "austria", "norway", "sweden", "denmark",
        "finland", "poland", "czech republic", "romania", "greece", "turkey", "hungary", "ukraine", "ireland", "serbia", "croatia", "bulgaria", "slovakia", "slovenia",
        "estonia", "latvia", "lithuania", "luxembourg", "iceland",
    ),
    "middle east": (
        "saudi arabia", "united arab emirates", "qatar", "oman", "kuwait", "bahrain", "iraq", "jordan", "lebanon", "israel", "iran", "yemen", "syria",
    ),
    "north africa": (
        "egypt", "libya", "algeria", "tunisia", "morocco",
    ),
    "mena": (
        "egypt", "libya", "algeria", "tunisia", "morocco", "saudi arabia", "united arab emirates", "qatar", "oman", "kuwait", "bahrain", "iraq", "jordan", "lebanon",
        "israel", "iran", "yemen",
    ),
    "gcc": (
        "saudi arabia", "united arab emirates", "qatar", "oman", "kuwait", "bahrain",
    ),
    "asia": (
        "india", "pakistan", "bangladesh", "china", "japan", "south korea", "singapore", "malaysia", "indonesia", "thailand", "vietnam", "philippines", "sri lanka",
        "taiwan", "hong kong", "myanmar", "cambodia",
    ),
    "southeast asia": (
        "singapore", "malaysia", "indonesia", "thailand", "vietnam", "philippines", "myanmar", "cambodia", "laos",
    ),
    "africa": (
        "egypt", "libya", "algeria", "tunisia", "morocco", "south africa", "nigeria", "angola", "kenya", "ghana", "ethiopia", "mozambique", "tanzania", "cameroon",
        "senegal",
    ),
    "sub-saharan africa": (
        "south africa", "nigeria", "angola", "kenya", "ghana", "ethiopia", "mozambique", "tanzania",
    ),
    "north america": (
        "usa", "canada", "mexico",
    ),
    "south america": (
        "brazil", "argentina", "chile", "colombia", "peru", "venezuela", "ecuador",
    ),
    "latin america": (
        "mexico", "brazil", "argentina", "chile", "colombia", "peru", "venezuela", "ecuador", "bolivia", "uruguay", "paraguay",
    ),
    "cis": (
        "russia", "kazakhstan", "azerbaijan", "ukraine", "uzbekistan", "turkmenistan", "kyrgyzstan", "tajikistan", "georgia", "armenia",
    ),
    "apac": (
        "australia", "new zealand", "india", "china", "japan", "south korea", "singapore", "malaysia", "indonesia", "thailand", "vietnam", "philippines",
    ),
    "nordics": (
        "norway", "sweden", "denmark", "finland", "iceland",
    ),
    "scandinavia": (
        "norway", "sweden", "denmark",
    ),
    "dach": (
        "germany", "austria", "switzerland",
    ),
    "benelux": (
        "netherlands", "belgium", "luxembourg",
    ),
    "balkans": (
        "serbia", "croatia", "bulgaria", "romania", "greece", "slovenia",
    ),
}
