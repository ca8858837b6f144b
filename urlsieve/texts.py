"""Texts of reasons, evidence records and summaries. Results are compared word by word."""

# --- reasons of URL rules, by rule name; {} takes a value of the row ----------
URL_REASONS = {
    "userinfo": "URL contains user-info marker '@'.",
    "percent": "URL contains percent-encoded characters.",
    "ip_host": "Host is represented as an IP address.",
    "long_url": "URL is unusually long.",
    "many_labels": "Host contains a long subdomain combining authentication-related or service-like tokens.",
    "mixed_digits": "Second-level domain mixes letters with look-alike digits.",
    "lookalike": "Second-level domain becomes '{}' after common look-alike digit normalization.",
    "many_digits": "Second-level domain contains repeated or multiple look-alike digits.",
    "impersonation": "Look-alike normalized domain matches a high-value impersonation target: {}.",
    "risk_tld": "TLD '.{}' is commonly abused in phishing campaigns.",
    "compressed": "URL contains a compressed download file indicator '.{}'.",
    "executable": "URL contains an executable file extension risk indicator '.{}'.",
    "risk_terms": "Contextual risk-intent terms in URL: {}.",
    "phishing_terms": "Multiple credential-phishing intent terms: {}.",
    "defacement_terms": "Defacement-related terms in URL: {}.",
    "defacement_page": "Defacement term appears in a web page filename.",
    "malware_terms": "Software-delivery terms appear near a file path; these terms can be benign alone, but add "
                     "malware-distribution risk when combined with executable or download-path structure: {}.",
    "malware_exe": "The executable extension is interpreted as a file-delivery URL structure, not as file-content "
                   "analysis.",
    "brand": "Brand term appears with credential-phishing terms outside the registered service domain: {}.",
    "http": "URL uses HTTP rather than HTTPS.",
    "dictionary": "Learned risk dictionary matched URL tokens with context weighting: {}.",
    "query": "Query parameter '{}={}' contains risk term(s): {}.",
}

# --- context names of dictionary matches --------------------------------------
CONTEXTS = {
    "neutral": "neutral path/query token",
    "path": "contextual path/query token",
    "subdomain": "subdomain token",
    "structural": "structural URL token",
    "tld": "TLD token",
    "registered": "registered-domain token with low standalone evidence",
    "host": "host token",
    "free": "context-free token",
    "generic": "generic token",
}

# --- reasons of page rules ----------------------------------------------------
PAGE_REASONS = {
    "password": "Page contains {} password input field(s).",
    "external": "Page has {} form action(s) posting to another host.",
    "insecure": "Page has {} insecure HTTP form action(s).",
    "iframe": "Page combines iframe usage with form/login surface.",
    "suspicious": "Suspicious page terms near a sensitive interaction surface: {}.",
    "defacement": "Defacement-related text was found on the page: {}.",
    "malware": "Download/malware lure text was found on the page: {}.",
    "script": "Inline JavaScript shows obfuscation-like patterns.",
    "certificate": "SSL certificate does not appear to match the requested host.",
    "expiry": "SSL certificate expires very soon.",
    "ssl_error": "SSL certificate check failed: {}.",
    "no_form": "No login form, password field, or external form action was found.",
    "title": "Page loaded normally with a visible title.",
    "not_collected": "Live page evidence was not collected.",
    "unavailable": "Static page evidence was not used because live page evidence was unavailable ({}).",
    "not_html": "Fetched resource was not HTML, so page-level phishing signals were limited.",
}

# --- sources of reasons: words in the reason, source; the first match wins ----
REASON_SOURCES = [
    (["transformer"], "Transformer alignment"),
    (["page", "html", "form", "ssl"], "Static page evidence"),
    (["query parameter"], "Query evidence"),
    (["extension", "download", "executable"], "File/URL structure"),
    (["brand", "credential", "phishing"], "Phishing context"),
    (["defacement", "hacked", "owned"], "Defacement context"),
]
OTHER_SOURCE = "URL context"

# --- explanation --------------------------------------------------------------
FACTOR_REASONS = {
    "high": "high-risk URL structure",
    "amplifier": "risk-intent keyword",
    "query": "query-string context",
    "https": "HTTPS context",
}
RISK_LABELS = {
    "phishing": "phishing risk",
    "malware": "malware distribution risk",
    "defacement": "defacement risk",
}
ALIGNMENT = {
    "strong": "Transformer saliency is aligned with the lexicon evidence around {}.",
    "weak": "Transformer alignment is weak, so the risk explanation mainly relies on URL lexicon evidence; the aligned "
            "token signal is {}.",
    "present": "Transformer alignment is present but does not dominate the explanation.",
    "none": "Transformer alignment did not add meaningful support for this risk label.",
    "decision": "Transformer-token alignment was consistent with the URL-level risk evidence.",
}
SUMMARY = {
    "benign_reasons": "The system marked the URL as low-risk/benign because the integrated evidence score remained below "
                      "the risk threshold. Main evidence: {}",
    "benign": "The system marked the URL as low-risk/benign because no strong contextual URL, Transformer-alignment, or "
              "static page risk evidence was found.",
    "risk_reasons": "The system indicated {} based on URL-level evidence. Main risk evidence: {} Main token evidence: {}.",
    "risk": "The system indicated {}. The strongest explanation signals were {}, combining URL token saliency, risk "
            "dictionary evidence, context rules, static page evidence, and similar URL cases.",
    "no_token": "no dominant token",
}
TOKEN_REASONS = {
    "ip_host": "{} is structural URL evidence indicating that the host is an IP address rather than a registered domain. "
               "It is treated as strong URL-structure evidence.",
    "extension": "{} is treated as strong URL-level file-extension evidence. This does not inspect the downloaded file "
                 "itself; it only explains risk from the URL structure.",
    "delivery": "{} can also appear in benign software URLs, so it is not used as standalone malware proof. It increases "
                "the explanation score because it appears together with an executable file-extension/path pattern. It is "
                "shown as contextual supporting evidence.",
    "context": "{} is a contextual token that can appear in benign URLs; its evidence is interpreted only with "
               "surrounding URL structure.",
    "match": "{} matched as {} token evidence in the URL context.",
}
RECORD_SOURCES = {
    "alignment": "Transformer alignment",
    "page": "Static page evidence",
    "ip": "IP host normalization",
    "combination": "Contextual combination",
    "delivery": "File-delivery structure",
    "contextual": "Contextual token evidence",
    "token": "Token evidence",
}
RECORD_REASONS = {
    "ip": "The numeric host components are treated as parts of one IPv4 host, not as separate domain/TLD risk tokens.",
    "combination": "Common software-delivery words such as download/update are not treated as malicious by themselves; the "
                   "risk increases because they appear together with an executable file-extension or file-path pattern.",
    "delivery": "The executable extension is interpreted as a URL-level file-delivery structure, not as analysis of the "
                "file contents.",
}
METHOD = "Lexicon-Context Evidence Module"
XAI_METHOD = "Lexicon-Context Guided XAI"
