"""Fixed values the triage results depend on."""

# --- fixed values: phrases counted by the keyword rule ------------------------------------
PHISHING_KEYWORDS = [
    "verify your account", "urgent action", "reset password", "wire transfer", "invoice",
    "gift card", "docusign", "suspended", "expired", "immediate action", "click here",
    "verify now", "account locked", "security alert", "payment failed", "billing issue",
    "account verification", "suspicious activity", "unusual login", "confirm identity",
    "update payment", "renew subscription", "expiring soon",
]

# --- fixed values: link shorteners, used as unanchored patterns (one entry counts thrice) --
SUSPICIOUS_DOMAINS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "short.link", "is.gd", "v.gd", "ow.ly",
    "buff.ly", "rebrand.ly", "tiny.cc", "shorturl.at", "cutt.ly", "short.link", "rb.gy",
    "bit.do", "short.link", "tiny.one",
]

# --- fixed values: trusted senders, used as unanchored patterns ----------------------------
TRUSTED_DOMAINS = [
    "gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "apple.com", "microsoft.com",
    "google.com", "amazon.com", "paypal.com", "ebay.com", "linkedin.com", "facebook.com",
    "twitter.com", "instagram.com", "netflix.com", "spotify.com", "dropbox.com", "adobe.com",
    "salesforce.com", "slack.com",
]

# --- fixed values: company names that a display name may imitate ---------------------------
IMITATED_COMPANIES = ["paypal", "apple", "microsoft", "google", "amazon", "netflix"]

# --- fixed values: urgent wording ----------------------------------------------------------
URGENT_PATTERNS = [
    r"\b(urgent|asap|immediately|right now|expires?|deadline)\b",
    r"\b(act now|don't wait|limited time|hurry)\b",
    r"\b(click here|verify now|confirm immediately)\b",
    r"\b(account will be|suspended|locked|closed)\b",
]

# --- fixed values: odd From headers --------------------------------------------------------
ODD_HEADER_PATTERNS = [
    r"<[^>]*@[^>]*>",
    r"[^\x00-\x7F]",
    r"\b(no-reply|noreply|donotreply)\b",
]

# --- fixed values: substrings counted by the numeric feature set ---------------------------
FEATURE_KEYWORDS = [
    "urgent", "verify", "account", "password", "click", "here", "immediately", "suspended",
    "expired", "action", "required", "confirm", "update", "billing", "payment", "invoice",
]

# --- fixed values: order of the numeric features -------------------------------------------
FEATURE_NAMES = [
    "subject_length", "snippet_length", "body_length", "url_count", "url_domain_count",
    "has_urls", "spf_pass", "dkim_pass", "dmarc_pass", "auth_score", "has_html",
    "content_ratio", "domain_length", "has_domain", "suspicious_keyword_count",
    "exclamation_count", "caps_ratio", "number_count",
]

# --- fixed values: patterns of the field derivation ----------------------------------------
# one class with the same matches: an alternation repeated by + recurses in the JVM's regex engine
URL_PATTERN = r"(?i)https?://[!$-_a-z]+"
NETLOC_PATTERN = r"(?i)^https?://([^/?#]*)"
ANGLE_ADDRESS_PATTERN = r"<([^>]+@[^>]+)>"
BARE_ADDRESS_PATTERN = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
ADDRESS_DOMAIN_PATTERN = r"@([^\n]+)"
DISPLAY_NAME_PATTERN = r"^([^<]+)<"
DISPLAY_DOMAIN_PATTERN = r"@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# --- fixed values: lengths -----------------------------------------------------------------
SNIPPET_LENGTH = 600
FINGERPRINT_SNIPPET_LENGTH = 200
PROMPT_SNIPPET_LENGTH = 500
PREVIEW_DOMAINS = 5

# --- fixed values: default English stop words (pass another list to replace them) ----------
STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very can will just don should now ll re ve ain aren couldn didn doesn hadn
hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()
