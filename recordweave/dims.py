"""Weights, thresholds, word lists and probe phrases.

These are plain constants that the results depend on. Each list is small by
construction (hand-kept), so it becomes literal columns, never a join.
"""

# --- desks -----------------------------------------------------------------
# fixed values: the notes of a brief that is not there yet
NOTE_PENDING = "Today's brief is being generated. Showing last published brief."
NOTE_FAILED = "Today's brief failed generation. Showing last published brief."

# fixed values: desks, and their order where several tie
DESKS = ["defense", "ai", "energy"]
HOME_DESK_TIEBREAK = ["defense", "energy", "ai"]

# --- fixed values: scoring ---------------------------------------------------
SOURCE_WEIGHTS = {
    "usaspending": 0.9, "dod_contracts": 0.85, "edgar": 0.85, "nrc": 0.85,
    "sam_gov": 0.8, "congress_gov": 0.8, "arxiv": 0.7, "fred": 0.7,
    "feeds": 0.6, "gdelt": 0.5,
}
DEFAULT_SOURCE_WEIGHT = 0.6
ENTITY_IMPORTANCE = {
    "company": 1.0, "program": 0.85, "person": 0.7, "gov_agency": 0.75,
    "institution": 0.6, "sector": 0.5, "security": 0.95, "product": 0.75,
    "facility": 0.65, "geography": 0.55, "segment": 0.7,
}
DEFAULT_ENTITY_IMPORTANCE = 0.5
MATERIALITY_THRESHOLD = 0.35
CROSS_SECTOR_WEIGHT = 0.02
MAGNITUDE_MIN_WINDOW = 10
MAGNITUDE_BUCKETS = [
    (1e6, 0.05), (5e6, 0.15), (1e7, 0.2), (1e8, 0.4), (1e9, 0.7),
]

# --- fixed values: selection -------------------------------------------------
NOVELTY_WINDOW_DAYS = 7
NOVELTY_PENALTY = 0.5
OUTLET_CAP = 3
OUTLET_PENALTY = 0.5
BRIEF_LIMIT = 50
RESEARCH_FLOOR = 3
NEWS_FLOOR = 4
AMOUNT_WINDOW_DAYS = 90
WINDOW_HOURS_FALLBACK = 48
SIGNIFICANCE_THRESHOLD = 0.45
PASSAGE_TOP_K = 20
EDGE_CONTEXT_LIMIT = 50

# --- fixed values: graph -----------------------------------------------------
HALF_LIFE_DAYS = 30.0
WEIGHT_FLOOR = 1.5
CROSS_DESK_BOOST = 2.0

# --- fixed values: resolution -----------------------------------------------
SIM_HIGH, SIM_MEDIUM, SIM_LOW = 0.92, 0.70, 0.55
AMBIGUITY_MARGIN = 0.05
TRIGRAM_THRESHOLD = 0.3
MAX_CANDIDATES = 5
MENTION_SUFFIXES = [
    "INC", "CORP", "LLC", "LTD", "LP", "CO", "CORPORATION", "INCORPORATED",
    "LIMITED", "COMPANY", "PLC", "GMBH", "AG", "SA",
]
AWARD_SUFFIXES = [
    "INC", "CORP", "LLC", "LTD", "LP", "CO", "CORPORATION", "INCORPORATED",
    "LIMITED", "COMPANY",
]
STOPWORD_ALIASES = [
    "GENERAL PUBLIC", "UNITED STATES", "NEW AMERICA", "OPEN TEXT",
    "QUANTUM COMPUTING", "HYPERSCALE DATA", "AI ERA",
]
ALIAS_MIN_TOKENS, ALIAS_MAX_TOKENS = 2, 6
MINTABLE_ID_TYPES = ["cik", "uei"]

# --- fixed values: money -----------------------------------------------------
AMOUNT_SCALES = {
    "trillion": 1e12, "tn": 1e12, "t": 1e12,
    "billion": 1e9, "bn": 1e9, "b": 1e9,
    "million": 1e6, "mn": 1e6, "mm": 1e6, "m": 1e6,
    "thousand": 1e3, "k": 1e3,
}
AMOUNT_PATTERN = (
    r"(?i)\$\s*([\d][\d,]*(?:\.\d+)?)\s*"
    r"(trillion|billion|million|thousand|tn|bn|mm|mn|[bmkt])?\b"
)
# the display helper knows no "tn"
DISPLAY_AMOUNT_PATTERN = (
    r"(?i)\$\s*([\d][\d,]*(?:\.\d+)?)\s*"
    r"(trillion|billion|million|thousand|bn|mm|mn|[bmkt])?\b"
)
PERCENT_PATTERN = r"(\d{1,3}(?:\.\d+)?)\s?%"
LONG_DATE_PATTERN = (
    r"\b(?:January|February|March|April|May|June|July|August|September|October|"
    r"November|December)\s+\d{1,2},?\s+\d{4}\b"
)
PROJECTION_PATTERN = (
    r"(?i)\b(?:projected|forecasts?|forecasted|estimated to (?:reach|hit|grow|total|exceed)|"
    r"expected to (?:reach|hit|grow|exceed|top|surpass)|could (?:reach|hit|top|exceed|grow to)|"
    r"poised to (?:reach|hit)|set to (?:reach|hit)|on track to (?:reach|hit)|"
    r"(?:total )?addressable market|market (?:size|value|worth|opportunity)|\bTAM\b|\bCAGR\b|"
    r"annually|per year|per annum)\b"
)
HORIZON_PATTERN = (
    r"(?i)\b(?:investment|spending|capex|capital expenditure|buildout|build-out|outlays?|demand|"
    r"capacity|needed|required)\b[^.]{0,60}\bby\s+20\d\d\b|\bby\s+20\d\d\b[^.]{0,60}\b"
    r"(?:investment|spending|capex|buildout|build-out|outlays?|demand|capacity|needed|required)\b"
)
MAX_FACTS = 25
EXCERPT_CHARS = 1200
BOILERPLATE_CHARS = 400

# --- fixed values: citations -------------------------------------------------
CITE_PATTERN = r"\[CITE:(\d+)\]"
CITE_KEYWORD_PATTERN = r"(?i)[\[(（【［]\s*cite\s*[:\-]?\s*(\d{1,3})\s*[\])）】］]"
CITE_BARE_PATTERN = r"[\[［]\s*(\d{1,3})\s*[\]］]"
ABBREVIATIONS = [
    "u.s", "u.k", "u.n", "e.u", "d.c", "gen", "lt", "col", "adm", "sen", "rep", "gov",
    "capt", "sgt", "maj", "brig", "cmdr", "corp", "inc", "ltd", "co", "dr", "mr", "mrs",
    "ms", "st", "no", "jr", "sr", "vs", "etc", "e.g", "i.e", "a.m", "p.m", "ph.d",
]

# --- fixed values: item types ------------------------------------------------
ITEM_TYPES = ["award", "filing", "policy", "macro", "signal", "operational", "research"]
ITEM_TYPE_SYNONYMS = {
    "contract": "award", "procurement": "award", "grant": "award", "obligation": "award",
    "sec": "filing", "disclosure": "filing", "earnings": "filing",
    "regulation": "policy", "legislation": "policy", "rule": "policy", "law": "policy",
    "doctrine": "policy", "strategy": "policy",
    "economic": "macro", "economy": "macro", "market": "macro", "financial": "macro",
    "operation": "operational", "combat": "operational", "military": "operational",
    "deployment": "operational", "exercise": "operational", "strike": "operational",
    "patrol": "operational", "incident": "operational", "launch": "operational",
    "paper": "research", "study": "research", "arxiv": "research", "preprint": "research",
    "technology": "research", "prototype": "research", "milestone": "research",
    "breakthrough": "research", "development": "research",
    "news": "signal", "announcement": "signal", "update": "signal",
}

# --- fixed values: evidence ladder -------------------------------------------
EVIDENCE_CLASS = {
    "usaspending": "primary", "dod_contracts": "primary", "sam_gov": "primary",
    "congress_gov": "primary", "fred": "primary", "edgar": "primary", "nrc": "primary",
    "arxiv": "primary", "feeds": "reported", "gdelt": "signal",
}
LINK_ONLY_SOURCES = ["gdelt", "feeds"]
ATTRIBUTIONS = ["confirmed", "reported", "analysis", "speculative"]

# --- fixed values: published dates -------------------------------------------
PUBLISHED_KEYS = {
    "feeds": ["published"],
    "arxiv": ["published", "updated"],
    "gdelt": ["seendate"],
    "usaspending": ["last_modified", "start_date"],
    "edgar": ["file_date"],
    "nrc": ["publication_date"],
    "sam_gov": ["posted_date", "published"],
}
PUBLISHED_FALLBACK_KEYS = [
    "published", "publication_date", "posted_date", "file_date", "date", "start_date", "seendate",
]

# --- fixed values: JSON wrappers and leak markers ----------------------------
WRAPPER_KEYS = ["text", "analysis", "read", "watch", "rewritten", "body", "content", "convergence_read"]
LEAK_MARKERS = [
    '"rewritten"', '"analysis"', '"convergence_read"', '"text"', '"body"', '"read"', '"watch"',
]

# --- fixed values: commerce noise --------------------------------------------
COMMERCE_NOISE = [
    "save up to", "flash sale", "weekend sale", "for only $", "huge discount",
    "prime day", "black friday", "best deals",
    "gaming pc", "gaming laptop", "gaming desktop", "gaming chair", "gaming monitor",
    "gaming keyboard", "gaming mouse", "gaming headset",
    "steam controller", "steam machine", "steam deck", "dualshock",
    "playstation", "xbox", "nintendo",
]
COMMERCE_NOISE_PATTERN = r"(?i)\b\d{1,3}%\s*off\b|\$\d[\d,]*\s*off\b|\bplummets?\s+\$"

# --- fixed values: parser limits ---------------------------------------------
AWARD_MAX_AGE_DAYS = 4 * 365
TITLE_CHARS = 300
SNIPPET_CHARS = 300
PAPER_ABSTRACT_CHARS = 600
REGISTER_ABSTRACT_CHARS = 700
MAX_ITEMS_PER_FEED = 12
MAX_BODIES_PER_RUN = 80
LOOKBACK_DAYS = {"usaspending": 45, "sam_gov": 30, "edgar": 7, "nrc": 7, "arxiv": 7, "gdelt": 2}
HOT_WINDOW_DAYS = 21
QUERY_GROUP_SIZE = 8
DISPLAY_NAME_PATTERN = r"^(.*?)\s*(?:\(([^)]+)\)\s*)?\(CIK\s*(\d+)\)"

# --- fixed values: word-matched companies (display, ticker, lower-case aliases)
NUCLEAR_COMPANIES = [
    ("Oklo", "OKLO", ["oklo"]),
    ("NuScale Power", "SMR", ["nuscale"]),
    ("Centrus Energy", "LEU", ["centrus"]),
    ("BWX Technologies", "BWXT", ["bwx technologies", "bwxt"]),
    ("Constellation Energy", "CEG", ["constellation energy", "constellation"]),
    ("Vistra", "VST", ["vistra"]),
    ("Nano Nuclear Energy", "NNE", ["nano nuclear"]),
    ("Energy Fuels", "UUUU", ["energy fuels"]),
    ("Uranium Energy", "UEC", ["uranium energy"]),
    ("Cameco", "CCJ", ["cameco"]),
    ("Lightbridge", "LTBR", ["lightbridge"]),
    ("GE Vernova", "GEV", ["ge vernova"]),
]

# --- fixed values: health ----------------------------------------------------
MIN_ITEMS_PER_BRIEF = 4
MIN_FAITHFULNESS = 0.98
SOURCE_STALE_HOURS = 30
FINDING_LEVELS = ["critical", "warn", "notice", "info"]
BREAKER_THRESHOLD = 3
BREAKER_COOLDOWN_MINUTES = 30

# --- fixed values: subscription status ---------------------------------------
SUBSCRIPTION_STATUS = {
    "on_trial": "trialing", "active": "active", "past_due": "past_due", "unpaid": "past_due",
    "paused": "cancelled", "cancelled": "cancelled", "expired": "cancelled",
}
CANCEL_EVENTS = ["subscription_cancelled", "subscription_expired"]
PRO_STATUSES = ["active", "trialing"]
ARCHIVE_DAYS = 90

# --- fixed values: momentum --------------------------------------------------
RECENT_DAYS, BASELINE_DAYS = 7, 21
MOVE_PERCENT = 25.0
MAX_THEMES, MAX_PHRASES = 6, 5

# --- fixed values: probe phrases ---------------------------------------------
AWARD_PROBES = [
    (["satellite", "spacecraft", "launch vehicle", "space launch", "geospatial",
      "satellite communications", "space-based"], ["defense", "ai"]),
    (["directed energy", "high energy laser", "laser weapon", "microwave weapon",
      "unmanned aircraft", "unmanned aerial", "drone", "loitering munition",
      "guided missile", "hypersonic", "precision strike", "munition", "warhead",
      "radar", "surveillance", "reconnaissance", "electro-optical", "infrared sensor",
      "night vision", "signals intelligence", "electronic warfare", "electronic attack"], ["defense"]),
    (["autonomous", "autonomy", "robotic", "robotics", "counter-uas",
      "artificial intelligence", "machine learning", "command and control"], ["defense", "ai"]),
    (["data center", "high performance computing", "supercomputer", "semiconductor",
      "advanced computing", "quantum computing", "exascale"], ["ai"]),
    (["small modular reactor", "grid modernization", "transmission line",
      "energy storage", "grid scale battery", "nuclear power", "hydrogen",
      "geothermal", "carbon capture", "high-assay low-enriched uranium"], ["energy"]),
    (["rare earth", "critical minerals"], ["energy", "defense", "ai"]),
]
OPPORTUNITY_PROBES = [
    ("hypersonic", "defense"), ("counter-unmanned aircraft", "defense"),
    ("directed energy weapon", "defense"), ("unmanned underwater vehicle", "defense"),
    ("munitions production", "defense"), ("missile defense", "defense"),
    ("artificial intelligence", "ai"), ("high performance computing", "ai"), ("semiconductor", "ai"),
    ("small modular reactor", "energy"), ("microgrid", "energy"), ("energy storage", "energy"),
]
REGISTER_PROBES = [
    ("small modular reactor", ["energy"]), ("advanced reactor", ["energy"]),
    ("high-assay low-enriched uranium", ["energy"]), ("combined license", ["energy"]),
    ("uranium enrichment", ["energy"]), ("microreactor", ["energy"]), ("TRISO", ["energy"]),
]
FILING_PROBES = [
    ("small modular reactor", ["energy", "ai"]), ("high-assay low-enriched uranium", ["energy"]),
    ("hyperscale data center", ["ai", "energy"]), ("directed energy weapon", ["defense", "energy"]),
    ("counter-unmanned aircraft", ["defense", "ai"]), ("hypersonic", ["defense"]),
    ("autonomous weapon", ["defense", "ai"]), ("rare earth", ["defense", "ai", "energy"]),
    ("grid-scale storage", ["energy"]), ("battery energy storage", ["energy"]),
    ("transmission interconnection", ["energy"]), ("power purchase agreement", ["energy"]),
    ("liquefied natural gas", ["energy"]), ("uranium enrichment", ["energy", "defense"]),
    ("nuclear fuel", ["energy", "defense"]), ("solid-state battery", ["energy"]),
    ("geothermal", ["energy"]), ("microgrid", ["energy", "defense"]),
    ("munitions production", ["defense"]), ("missile defense", ["defense"]),
    ("loitering munition", ["defense", "ai"]), ("unmanned surface vessel", ["defense", "ai"]),
    ("solid rocket motor", ["defense"]), ("electronic warfare", ["defense"]),
    ("satellite constellation", ["defense", "ai"]), ("shipbuilding", ["defense"]),
    ("Defense Production Act", ["defense", "energy"]),
    ("generative artificial intelligence", ["ai"]), ("large language model", ["ai"]),
    ("graphics processing unit", ["ai", "energy"]), ("semiconductor fabrication", ["ai", "defense"]),
    ("advanced packaging", ["ai"]), ("liquid cooling", ["ai", "energy"]),
    ("edge computing", ["ai", "defense"]),
    ("rare earth magnet", ["defense", "ai", "energy"]), ("permanent magnet", ["defense", "energy"]),
    ("gallium", ["defense", "ai", "energy"]), ("germanium", ["defense", "ai", "energy"]),
    ("critical minerals", ["defense", "ai", "energy"]), ("quantum computing", ["defense", "ai"]),
    ("collaborative combat aircraft", ["defense", "ai"]), ("high-power microwave", ["defense"]),
    ("high-energy laser", ["defense"]), ("unmanned underwater vehicle", ["defense", "ai"]),
    ("quantum sensing", ["defense", "ai"]), ("space situational awareness", ["defense", "ai"]),
    ("high bandwidth memory", ["ai"]), ("silicon photonics", ["ai"]),
    ("extreme ultraviolet lithography", ["ai"]), ("immersion cooling", ["ai", "energy"]),
    ("microreactor", ["energy"]), ("enhanced geothermal", ["energy"]), ("perovskite", ["energy"]),
    ("iron-air battery", ["energy"]), ("long-duration energy storage", ["energy"]),
    ("virtual power plant", ["energy"]), ("space-based solar power", ["energy", "ai"]),
    ("orbital data center", ["ai", "energy"]), ("contested logistics", ["defense"]),
    ("biomanufacturing", ["defense", "energy"]), ("optical circuit switching", ["ai"]),
    ("data processing unit", ["ai"]), ("Ultra Ethernet", ["ai"]), ("hydrokinetic", ["energy"]),
    ("grid transformer shortage", ["energy"]), ("critical minerals", ["defense", "energy"]),
    ("semiconductor export", ["ai", "defense"]), ("behind-the-meter power", ["ai", "energy"]),
    ("co-packaged optics", ["ai"]), ("carbon capture", ["energy"]), ("offshore wind", ["energy"]),
    ("green ammonia", ["energy"]),
]
NEWS_PROBES = [
    ("collaborative combat aircraft", "defense"), ("military drone swarm", "defense"),
    ("unmanned underwater vehicle", "defense"), ("unmanned surface vessel", "defense"),
    ("high-energy laser weapon", "defense"), ("high-power microwave weapon", "defense"),
    ("hypersonic missile", "defense"), ("missile defense system", "defense"),
    ("quantum sensing navigation", "defense"), ("proliferated low earth orbit", "defense"),
    ("space situational awareness", "defense"), ("military artificial intelligence", "defense"),
    ("Nvidia Blackwell", "ai"), ("AI accelerator chip", "ai"), ("Google TPU", "ai"),
    ("high bandwidth memory", "ai"), ("advanced chip packaging", "ai"), ("silicon photonics", "ai"),
    ("AI data center", "ai"), ("data center power demand", "ai"), ("immersion cooling", "ai"),
    ("liquid cooling data center", "ai"), ("EUV lithography", "ai"), ("AI inference chip", "ai"),
    ("small modular reactor", "energy"), ("nuclear microreactor", "energy"),
    ("TRISO nuclear fuel", "energy"), ("enhanced geothermal", "energy"),
    ("perovskite solar cell", "energy"), ("nickel-zinc battery", "energy"),
    ("iron-air battery", "energy"), ("long-duration energy storage", "energy"),
    ("thermal energy storage", "energy"), ("virtual power plant", "energy"),
    ("grid interconnection queue", "energy"), ("uranium enrichment", "energy"),
    ("space-based solar power", "energy"), ("space solar power beaming", "energy"),
    ("orbital data center", "ai"), ("contested logistics", "defense"),
    ("military biomanufacturing", "defense"), ("autonomous military resupply", "defense"),
    ("cyber electromagnetic warfare", "defense"), ("Nvidia NVLink interconnect", "ai"),
    ("Ultra Ethernet AI networking", "ai"), ("optical circuit switching", "ai"),
    ("data processing unit", "ai"), ("Groq inference chip", "ai"),
    ("mixture of experts model", "ai"), ("hydrokinetic turbine", "energy"),
    ("closed-loop geothermal", "energy"), ("grid transformer shortage", "energy"),
    ("critical minerals supply", "defense"), ("counter-drone system", "defense"),
    ("additive manufacturing defense", "defense"), ("semiconductor export controls", "ai"),
    ("sovereign AI cloud", "ai"), ("co-packaged optics", "ai"),
    ("nuclear powered data center", "ai"), ("green ammonia", "energy"),
    ("carbon capture storage", "energy"), ("offshore wind", "energy"), ("methane abatement", "energy"),
]
