"""Word lists, synonyms and constants that results depend on."""

from __future__ import annotations

# Query parameters that only track a reader.
TRACKING_PREFIXES = ("utm_", "wt_", "mc_")
TRACKING_NAMES = ("fbclid", "gclid", "mc_cid", "mc_eid", "_ga", "_gl", "cmpid", "ref", "referer", "referrer", "spm", "yclid")

# Named HTML entities that are decoded.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘",
    "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
}

# Concept -> (English forms, Spanish forms).
LEXICON = {
    "election": (("election", "elections", "electoral"), ("elección", "elecciones", "electoral", "electorales")),
    "vote": (("vote", "votes", "voting", "voter", "voters"), ("voto", "votos", "votación", "votante", "votantes")),
    "ballot": (("ballot", "ballots"), ("papeleta", "papeletas", "tarjetón")),
    "presidential": (("presidential", "president"), ("presidencial", "presidenciales", "presidente")),
    "candidate": (("candidate", "candidates", "candidacy"), ("candidato", "candidatos", "candidata", "candidatas", "candidatura")),
    "campaign": (("campaign", "campaigns", "campaigning"), ("campaña", "campañas")),
    "runoff": (("runoff", "runoffs", "second round"), ("segunda vuelta", "balotaje")),
    "migration": (("migration", "migrant", "migrants", "immigration", "immigrant", "immigrants"), ("migración", "migraciones", "migrante", "migrantes", "inmigración", "inmigrante")),
    "security": (("security",), ("seguridad",)),
    "outbreak": (("outbreak", "outbreaks"), ("brote", "brotes")),
}
ELECTION_CONCEPTS = ("election", "vote", "ballot", "presidential", "candidate", "campaign", "runoff")
# Words of elections beside those forms, and words of the forms that say too little by themselves.
ELECTION_EXTRAS = ("debate", "debates", "electorate", "incumbent", "comicios", "sondeo", "sondeos", "encuesta", "encuestas")
ELECTION_VAGUE = ("second", "round")

# Geography -> words for its people.
DEMONYMS = {
    "colombia": ("colombian", "colombians"), "kenya": ("kenyan", "kenyans"), "venezuela": ("venezuelan", "venezuelans"),
    "mexico": ("mexican", "mexicans"), "ecuador": ("ecuadorian", "ecuadorians"), "panama": ("panamanian", "panamanians"),
    "brazil": ("brazilian", "brazilians"), "peru": ("peruvian", "peruvians"), "united states": ("american", "americans"), "us": ("american", "americans"),
}

# Other spellings of a configured geography.
GEO_SYNONYMS = {
    "US": ("U.S.", "U.S", "USA", "U.S.A.", "U.S.A", "United States"),
    "Colombia": ("Colombia", "Colombian", "Colombians", "Bogota", "Bogotá"),
}

# Place -> geography.
GEO_ALIASES = {
    "beijing": "China", "shanghai": "China", "shenzhen": "China", "guangzhou": "China", "hong kong": "China", "tokyo": "Japan", "osaka": "Japan", "kyoto": "Japan",
    "moscow": "Russia", "saint petersburg": "Russia", "st petersburg": "Russia", "kyiv": "Ukraine", "kiev": "Ukraine",
    "washington": "United States", "washington dc": "United States", "washington d.c.": "United States", "new york": "United States", "new york city": "United States", "los angeles": "United States",
    "mexico city": "Mexico", "guadalajara": "Mexico", "bogota": "Colombia", "bogotá": "Colombia", "medellin": "Colombia", "medellín": "Colombia", "cali": "Colombia",
    "brasilia": "Brazil", "brasília": "Brazil", "sao paulo": "Brazil", "são paulo": "Brazil", "rio de janeiro": "Brazil", "buenos aires": "Argentina", "lima": "Peru", "santiago": "Chile",
    "montevideo": "Latin America", "caracas": "Latin America", "london": "United Kingdom", "paris": "France", "berlin": "Germany", "brussels": "European Union", "ottawa": "Canada", "toronto": "Canada",
}

# Topic label synonyms.
TOPIC_SYNONYMS = {
    "security cooperation": "Security policy", "national security": "Security policy", "border security": "Border policy", "security incidents": "Security policy",
    "energy": "Energy policy", "immigration policy": "Migration policy", "deportation": "Deportation policy", "deportation policy": "Deportation policy",
    "asylum policy": "Migration policy", "visa policy": "Migration policy", "global health": "International health", "global public health": "International health",
    "disease outbreaks": "International health", "outbreak response": "International health", "vaccine updates": "Public health policy", "vaccine messaging": "Public health policy",
    "vaccine rollout": "Public health policy", "public health messaging": "Public health", "economic sanctions": "Sanctions enforcement", "sanctions": "Sanctions enforcement",
    "trade tariffs": "Trade policy", "tariff policy": "Trade policy", "customs delays": "Customs policy", "humanitarian operations": "Humanitarian aid",
    "humanitarian assistance": "Humanitarian aid", "bilateral relations": "Diplomatic relations",
}

# Keyword label synonyms.
KEYWORD_SYNONYMS = {
    "outbreaks": "outbreak", "vaccines": "vaccine", "asylum court": "asylum", "deportation flights": "deportation", "deportation notices": "deportation",
    "border corridors": "border", "border pressure": "border", "labor disputes": "labor", "visa announcements": "visa", "organized crime framing": "organized crime",
    "security incidents": "security", "diplomatic tone": "diplomacy",
}

# Outlet names.
OUTLET_ALIASES = {
    "nyt": "New York Times", "the new york times": "New York Times", "ny times": "New York Times", "wsj": "Wall Street Journal", "ap": "Associated Press", "ap news": "Associated Press",
    "bbc news": "BBC", "bbc world service": "BBC", "bbc world": "BBC", "hill": "The Hill", "the hill": "The Hill", "la silla vacia": "La Silla Vacía", "la silla vacía": "La Silla Vacía",
    "silla nacional": "La Silla Vacía", "la silla nacional": "La Silla Vacía", "revista semana": "Semana", "infobae colombia": "Infobae", "infobae américa": "Infobae",
}

# Kinds of feeds that have a reader.
READABLE_KINDS = ("rss", "social")

# Words left out of a headline family, and two-letter words kept in it.
FAMILY_STOPWORDS = (
    "the", "a", "an", "and", "or", "of", "in", "on", "for", "to", "with", "at", "by", "from", "as", "is", "are", "was", "were", "be", "new", "say", "says", "said",
    "after", "over", "amid", "into", "out", "its", "his", "her", "their", "this", "that", "near", "off",
    "el", "la", "los", "las", "un", "una", "de", "del", "en", "con", "por", "para", "que", "se", "su", "sus", "y", "o", "al",
)
FAMILY_SHORT = ("us", "eu", "uk", "un", "id", "ai")

# Words left out of evidence tokens.
EVIDENCE_STOPWORDS = (
    "the", "and", "for", "are", "was", "were", "has", "have", "had", "will", "with", "from", "that", "this", "into", "over", "after", "before", "amid",
    "its", "his", "her", "their", "they", "but", "not", "out", "who", "what", "how", "why", "you", "our", "your", "say", "says", "said", "new", "more",
    "than", "all", "can", "may", "now", "one", "two", "amp",
)

# Terms of commodity framing.
COMMODITY_TERMS = ("farmer", "farmers", "harvest", "crop", "crops", "commodity", "commodities", "wheat", "soy", "grain", "fertilizer", "livestock")

# Windows, caps, thresholds and weights.
WINDOW_MINUTES, TRAILING_MINUTES, SIGNAL_MINUTES = 60, 1440, 360
PER_FEED, PER_RUN = 30, 200
CLUSTER_CAP, STORY_CAP, QUEUE_CAP = 15, 5, 2
RECALL_POOL, RECALL_TOP, RECALL_FLOOR = 250, 80, 0.35
BEAT_FIT = {"topic": 0.30, "keyword": 0.25, "geo": 0.20, "recency": 0.10, "commodity": 0.15, "no_signal": 0.20}
BEAT_THRESHOLD, RESCUE_BOUND, RESCUE_SIGNALS, SEMANTIC_RESCUE = 0.20, 0.35, 3, 0.60
BLEND = (0.65, 0.35)
RELEVANCE = {"topic": 3.0, "keyword": 3.0, "entity": 2.0, "geo": 1.0, "corroboration": 1.5, "beat_fit": 1.0, "freshness": 0.25}
ELECTION_BOOST, ELECTION_PENALTY, ELECTION_GEO = 1.5, 0.75, 0.7
DENSITY_HALF = 2
GEO_CONFLICT, GEO_IMPLICIT = 0.90, 0.80
LINEAGE_JACCARD, SPLIT_JACCARD, BUNDLE_JACCARD, BUNDLE_SHARED = 0.5, 0.15, 0.34, 2
TTL_MINUTES, SNIPPET, DEFAULT_WEIGHT, SOCIAL_WEIGHT = 60, 500, 50.0, 60.0
REJECTIONS_KEPT = 200
MIN_SUCCESS, MIN_STORIES = 0.95, 2

# Limits of written lines, and when one line repeats another.
PROSE_SENTENCES, PROSE_CHARS = 2, 300
REPEAT_CHARS, REPEAT_WORDS, REPEAT_JACCARD, REPEAT_COVERED = 30, 4, 0.7, 0.85

# Reasons of a failed writer for which a story is left out.
WRITER_FAILURES = ("write_failed", "rewrite_failed", "resolver_threw")

# Keyword <- phrases of a text that name it (* : may go on with further letters).
KEYWORD_HINTS = (
    ("OFAC", ("ofac",)), ("migration", ("migration",)), ("sanctions", ("sanction", "sanctions")), ("energy", ("energy",)), ("border", ("border",)), ("security", ("security",)),
    ("health", ("health",)), ("outbreak", ("outbreak", "outbreaks")), ("vaccine", ("vaccine", "vaccines")), ("customs", ("custom", "customs")), ("DIAN", ("dian",)), ("trade", ("trade",)),
    ("asylum", ("asylum",)), ("deportation", ("deportation",)), ("ICE", ("ice",)), ("DHS", ("dhs",)), ("diplomacy", ("diploma*",)), ("labor", ("labor",)), ("manufacturing", ("manufacturing",)),
    ("tariffs", ("tariff", "tariffs")), ("visa", ("visa",)), ("United Nations", ("united nations", "unhcr")), ("organized crime", ("organized crime",)), ("elections", ("election", "elections")),
    ("public health", ("public health",)), ("WHO", ("who",)), ("migration", ("migracion", "migración", "migratorio", "migratoria", "migratorios", "migratorias")),
)

# Topic <- phrases of a text that name it, phrases that forbid it, phrases of which it needs one beside.
TOPIC_HINTS = (
    ("Migration policy", ("migration",)), ("Deportation policy", ("deportation",), ("humanitarian",)), ("Border policy", ("border", "cbp", "dhs", "ice")), ("Border policy", ("asylum",)),
    ("Security policy", ("security",)), ("Public health", ("public health",)), ("Public health policy", ("public health policy",)), ("Public health policy", ("vaccine rollout", "rollout")),
    ("Trade policy", ("tariff", "tariffs", "trade")), ("Customs policy", ("customs",)), ("Energy policy", ("energy",)), ("Sanctions enforcement", ("sanction", "sanctions")),
    ("Humanitarian aid", ("humanitarian",)), ("Health policy", ("health ngo",)), ("Public health", ("health ngo",)), ("International health", ("outbreak", "vaccine")),
    ("International trade", ("trade",), (), ("across",)), ("Elections", ("election", "elections")),
    ("Migration policy", ("migracion", "migración", "migratorio", "migratoria", "migratorios", "migratorias")), ("Elections", ("elecciones",)), ("Security", ("seguridad",)),
)

# Bare topics and their fuller labels; topics and keywords that are noise; topics that go beside a fuller one; words that only qualify.
TOPIC_PROMOTIONS = {"migration": "Migration policy", "trade": "Trade policy", "election": "Elections", "elections": "Elections"}
NOISE_TOPICS = ("compliance", "compliance risk", "labor disputes", "tariffs", "shipping", "shipping risk", "official reactions", "shelter capacity", "organized crime")
NOISE_KEYWORDS = ("compliance", "shipping", "shelter", "rollout", "messaging")
VAGUE_TOPICS = {"sanctions enforcement": ("energy policy", "migration policy"), "public health": ("public health policy",)}
QUALIFIERS = (
    "cooperation", "delays", "updates", "messaging", "bulletins", "risk", "rollout", "capacity", "announcements", "notices", "framing", "flights",
    "corridors", "pressure", "disputes", "incidents", "shifts", "storylines", "operations", "court",
)

# Handles that stand for a keyword, one of them only beside a phrase.
HANDLE_HINTS = {"@icegov": "ICE", "@cbp": "border"}
DIAN_HANDLE = ("@diancolombia", "customs policy", "DIAN")

# What a text drafts by itself (value, parts of words that stand for it; outlets and keywords in their own spelling).
DRAFT_TOPICS = (("Diplomatic relations", "diplomat", "bilateral"), ("Migration policy", "migrat", "deportat"))
DRAFT_KEYWORDS = ("OFAC", "sanctions", "deportation")
DRAFT_GEOGRAPHIES = (("US", "united states", " us ", " u.s."), ("Colombia", "colombia"))
DRAFT_OUTLETS = ("Reuters", "NYT", "Washington Post", "El Tiempo", "El País", "Semana", "La Silla Vacía", "Infobae")
DRAFT_OUTLET_SPELLINGS = (("La Silla Vacia", "la silla vacia"), ("La Silla Vacía", "silla nacional"), ("Revista Semana", "revista semana"), ("Infobae Colombia", "infobae colombia"))

# Score from which a scorer's label becomes a tag.
SEMANTIC_TAG = 0.75

# Pages of posts that are read of one name at most.
SOCIAL_PAGES = 25

# The contract version of snapshots, and older ones that are brought to it.
CONTRACT, LEGACY_CONTRACTS = "2026-05-19-meta-story-fields", ("2026-04-22-slice1",)

# Sources of a story at most; messages of calls that ran out of time, and of providers that failed.
STORY_SOURCES = 5
TIMEOUT_FAILURE = r"(?i)timed out|timeout|abort"
PROVIDER_FAILURE = (
    r"(?is)api[_ ]?key|anthropic_api_key|rate[ _-]?limit|overloaded|temporarily unavailable|service unavailable|\bunavailable\b|authentication|unauthorized|forbidden|permission|connection error"
    r"|econnreset|enotfound|etimedout|fetch failed|socket hang up|returned empty|empty.*?response|status code|\b(?:429|5\d{2})\b"
)

# Characters of an item that are scored; characters of a body that a writer sees.
ITEM_CHARS, EXCERPT_CHARS = 2000, 400

# Outlets that a written line may only name if the story has them.
KNOWN_OUTLETS = (
    "reuters", "bloomberg", "associated press", "the associated press", "afp", "bbc", "cnn", "the new york times", "new york times", "nyt", "the wall street journal", "wall street journal", "wsj",
    "the washington post", "washington post", "the guardian", "the financial times", "financial times", "ft", "axios", "politico", "semafor", "el tiempo", "el espectador", "el pais", "el país",
    "semana", "infobae", "noticias caracol", "rcn",
)

# Evidence that is translated of an item at most; share of a story's sources that has to be covered.
TRANSLATED_CHARS, TRANSLATED_SNIPPETS = 700, 2
COVERAGE = 0.6
