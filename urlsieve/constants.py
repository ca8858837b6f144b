"""Values that decide results: word lists, limits, weights and patterns.

Everything in this module is a fixed value. Changing one changes scores.
"""

# --- labels -----------------------------------------------------------------
CLASSES = ["benign", "defacement", "malware", "phishing"]
BENIGN = "benign"
PHISHING = "phishing"
MALICIOUS = ["defacement", "malware", "phishing"]
# Arg-max order of the evidence decision; the first maximum wins.
DECISION_ORDER = ["phishing", "defacement", "malware"]

# --- static evidence lexicon ------------------------------------------------
RISK_TERMS = [
    "account", "auth", "bank", "billing", "check", "confirm", "credential", "download", "driver", "free",
    "install", "login", "password", "payment", "secure", "security", "signin", "suspended", "unlock", "update",
    "verify", "wallet",
]
PHISHING_INTENT_TERMS = [
    "account", "auth", "check", "confirm", "credential", "login", "password", "secure", "security", "signin",
    "unlock", "verify",
]
DEFACEMENT_TERMS = [
    "deface", "defaced", "hacked", "hacker", "index_old", "owned", "pwned", "upload", "uploads", "wp",
    "wp-content",
]
MALWARE_TERMS = [
    "crack", "download", "driver", "free", "install", "keygen", "patch", "setup", "tool", "update",
]
RISK_EXTENSIONS = ["apk", "bat", "cmd", "exe", "jar", "msi", "ps1", "rar", "scr", "vbs", "zip"]
COMPRESSED_EXTENSIONS = ["rar", "zip"]
RISK_TLDS = ["click", "loan", "mom", "party", "pw", "rest", "review", "support", "top", "work", "xyz"]
IMPERSONATION_TARGETS = [
    "amazon", "apple", "daum", "facebook", "github", "gmail", "google", "instagram", "kakao", "microsoft",
    "naver", "netflix", "office", "paypal", "youtube",
]
LOOKALIKE_FROM = "013457"
LOOKALIKE_TO = "oleast"

STATIC_LEXICON = {
    "risk_terms": RISK_TERMS,
    "phishing_intent_terms": PHISHING_INTENT_TERMS,
    "defacement_terms": DEFACEMENT_TERMS,
    "malware_terms": MALWARE_TERMS,
    "risk_extensions": RISK_EXTENSIONS,
    "compressed_extensions": COMPRESSED_EXTENSIONS,
    "risk_tlds": RISK_TLDS,
    "impersonation_targets": IMPERSONATION_TARGETS,
}

# --- seed terms of the rebuilt dictionary -----------------------------------
SEED_TERMS = {
    "phishing": PHISHING_INTENT_TERMS,
    "defacement": DEFACEMENT_TERMS,
    "malware": MALWARE_TERMS,
}
SEED_EXTENSIONS = {"malware": RISK_EXTENSIONS}
SEED_TERM_PREFIXES = ["tok", "dpart", "path", "pseg", "qk", "qv"]
SEED_EXTENSION_PREFIXES = ["ext", "tok", "pseg"]
SEED_SCORE = 6.0

# --- neutral and low-information words --------------------------------------
NEUTRAL_URL_TERMS = [
    "api", "asp", "aspx", "by", "com", "example", "html", "id", "index", "message", "net", "news", "org", "page",
    "php", "test", "www",
]
SUSPICIOUS_TEXT_KEYWORDS = [
    "account", "bank", "billing", "confirm", "credential", "login", "password", "payment", "secure", "signin",
    "suspended", "update", "verify", "wallet",
]
LOW_INFORMATION_PAGE_TERMS = [
    "align", "blank", "block", "body", "border", "button", "center", "class", "color", "content", "display", "div",
    "font", "font-size", "form", "head", "height", "hidden", "hit", "href", "html", "image", "img", "inline",
    "input", "label", "left", "line", "link", "main", "margin", "meta", "none", "padding", "page", "right",
    "script", "scr", "span", "src", "style", "table", "tcolor", "text", "title", "type", "value", "width",
]
DEFACEMENT_PHRASES = ["hacked by", "defaced by", "owned by"]
LEARNED_TERM_PREFIXES = [
    "tok", "path", "pseg", "qkey", "qk", "qv", "sld", "dpart", "domain", "subdomain",
]
LEARNED_COMMON_THRESHOLD = 5.0
LEARNED_CLASS_THRESHOLD = 4.0

# --- explanation words ------------------------------------------------------
RISK_AMPLIFIER_WORDS = [
    "account", "admin", "bank", "billing", "confirm", "credential", "download", "free", "login", "password", "pay",
    "payment", "secure", "signin", "unlock", "update", "verify", "wallet",
]
COMMON_BENIGN_CONTEXT_TOKENS = [
    "client", "confirm", "delivery", "document", "download", "file", "install", "pay", "setup", "tracking",
    "update",
]
MALWARE_CONTEXT_TOKENS = ["client", "download", "file", "install", "setup", "update"]
HIGH_RISK_FEATURES = [
    "has_userinfo", "host_is_ip", "has_percent_encoding", "many_dots", "very_long_url", "ext:apk", "ext:bat",
    "ext:cmd", "ext:exe", "ext:jar", "ext:msi", "ext:ps1", "ext:scr", "ext:vbs",
]
LOW_INFORMATION_DISPLAYS = [
    "api", "asp", "aspx", "by", "com", "co", "example", "html", "http", "https", "id", "index", "message", "net",
    "news", "org", "page", "php", "test", "www",
]
FEATURE_CATEGORIES = {
    "tld": "domain", "tldpart": "domain", "sld": "domain", "subdomain": "domain", "domain": "domain",
    "dpart": "domain", "path": "path", "pseg": "path", "ext": "file_extension", "qkey": "query", "qk": "query",
    "qv": "query", "tok": "lexical", "char": "character_ngram",
}
WEIGHT_SALIENCY, WEIGHT_DICTIONARY, WEIGHT_CASE = 0.45, 0.30, 0.25
CASE_LABEL_MISMATCH_WEIGHT = 0.72
CASE_SIMILARITY_FLOOR = 0.5
TOP_CASES = 3

# --- dictionary profiles: (top common, top per class, minimum document frequency)
ADAPTIVE_PROFILE = (1000, 800, 5)
REBUILD_PROFILE = (1400, 1200, 3)
MIN_MALICIOUS_CLASSES = 2
SMOOTHING = 1.0

# --- features ---------------------------------------------------------------
TFIDF_MAX_FEATURES, TFIDF_MIN_DF, TFIDF_MAX_DF = 50000, 3, 0.95
CHAR_PAD, CHAR_UNK, CHAR_CLS, CHAR_LENGTH = 0, 1, 2, 256

# --- decision and model thresholds ------------------------------------------
DECISION_THRESHOLD = 0.35
GATE_MIN_PROB, GATE_MIN_MARGIN = 0.55, 0.08
GRAY_ZONE, SPECIALIST_MIN_PROB = 0.20, 0.25
SPECIALIST_PHISHING, SPECIALIST_BENIGN = 0.60, 0.35
META_GATE_THRESHOLD = 0.70
SPECIALIST_MAX_SAMPLES = 60000
L2_PENALTY = 1e-5

# --- stream shape -----------------------------------------------------------
WARMUP_PER_MILLE = 200
BATCH_SIZE, UPDATE_INTERVAL, WINDOW_BATCHES = 5000, 3, 6

# --- input limits -----------------------------------------------------------
MAX_URL_LENGTH = 2048
MAX_HTML_BYTES = 250000
MAX_TEXT_PARTS, MAX_SCRIPT_PARTS, MAX_SCRIPT_CHARS, MAX_TITLE_CHARS = 80, 60, 4000, 180
RATE_MAX_REQUESTS, RATE_WINDOW_SECONDS = 60, 60
