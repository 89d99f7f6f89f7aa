"""Class names, word lists, lookup tables, patterns and thresholds.

These are data, not logic; every operator that uses one takes it as a default parameter.
"""

# The five classes, their numeric labels and their risk levels.
CLASSES = [
    "Legitimate",
    "Spam",
    "Traditional_Phishing",
    "Business_Email_Compromise",
    "AI_Generated_Phishing",
]
CLASSES_SORTED = sorted(CLASSES)
CATEGORY_LABELS = {
    "Legitimate": 0,
    "Spam": 1,
    "Traditional_Phishing": 2,
    "Business_Email_Compromise": 3,
    "AI_Generated_Phishing": 4,
}
CLASS_RISK = {
    "Legitimate": "Safe",
    "Spam": "Medium",
    "Traditional_Phishing": "High",
    "Business_Email_Compromise": "Critical",
    "AI_Generated_Phishing": "Critical",
}
DEFAULT_RISK = "High"

# Language tags.
LANGUAGES = [
    "CodeMixed_Sinhala_English",
    "CodeMixed_Tamil_English",
    "CodeMixed_Multilingual",
    "Sinhala",
    "Tamil",
    "English",
    "Unknown",
]
CODE_MIXED = ["CodeMixed_Sinhala_English", "CodeMixed_Tamil_English"]

# Suspicious words counted when the models were trained (21) and at serving time (29).
TRAINING_KEYWORDS = [
    "account", "verify", "verification", "login", "password", "urgent", "immediately",
    "suspend", "blocked", "update", "confirm", "bank", "payment", "invoice", "payroll",
    "otp", "wallet", "click", "security", "restore", "expire",
]
SERVING_KEYWORDS = [
    "account", "verify", "verification", "login", "password", "urgent", "immediately",
    "suspend", "suspended", "blocked", "update", "confirm", "bank", "payment", "invoice",
    "payroll", "otp", "wallet", "click", "security", "restore", "expire", "expired",
    "credentials", "transfer", "confidential", "winner", "reward", "prize",
]

# First URL scorer.
URL_WORDS = [
    "login", "verify", "verification", "secure", "security", "account", "bank",
    "payment", "invoice", "wallet", "reset", "update", "confirm", "unlock",
]
URL_LOOKALIKES = [
    "paypai", "micr0soft", "g00gle", "faceb00k", "amaz0n", "wa11et", "cust0mer", "acc0unt",
]

# Second URL scorer.
URL_POINT_WORDS = [
    "login", "verify", "update", "secure", "account", "bank", "password", "otp",
    "wallet", "payment", "invoice", "payroll", "confirm", "signin", "reset", "unlock",
]
SHORTENERS = [
    "bit.ly", "tinyurl.com", "t.co", "goo.gl", "cutt.ly", "rebrand.ly", "is.gd", "buff.ly", "ow.ly",
]

# Attachment extensions.
EXECUTABLE_EXTENSIONS = [
    ".exe", ".scr", ".com", ".bat", ".cmd", ".ps1", ".vbs", ".vbe", ".js", ".jse",
    ".wsf", ".wsh", ".hta", ".msi", ".msp", ".dll", ".jar", ".lnk", ".iso", ".img",
]
MACRO_EXTENSIONS = [".docm", ".xlsm", ".pptm", ".xltm", ".dotm"]
ARCHIVE_EXTENSIONS = [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2"]
DOUBLE_EXTENSION_INNER = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".jpg", ".jpeg", ".png", ".txt"]

# Authentication results.
AUTH_RESULTS = ["pass", "fail", "softfail", "neutral", "none", "temperror", "permerror", "policy"]
RECEIVED_SPF_RESULTS = ["pass", "fail", "softfail", "neutral", "none", "temperror", "permerror"]

# Metadata line prefixes in screenshots.
METADATA_PREFIXES = ["from:", "to:", "cc:", "bcc:", "reply-to:", "date:", "sent:", "received:"]

# HTML tags that end a line of text.
BLOCK_TAGS = [
    "address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "li", "p", "section", "table", "tr",
]

# Stop words of the occlusion candidates.
OCCLUSION_STOP_WORDS = [
    "the", "and", "for", "your", "you", "this", "that", "with",
    "from", "please", "dear", "now", "today", "within", "will",
]

# Structured feature columns, in model order.
NUMERIC_FEATURES = [
    "url_count_extracted", "has_url", "has_defanged_url", "text_char_count", "text_word_count",
    "subject_char_count", "body_char_count", "suspicious_keyword_count", "email_entropy",
]
CATEGORICAL_FEATURES = ["detected_language"]
STRUCTURED_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES
TEXT_COLUMN = "clean_email_text"
TARGET_COLUMN = "category"

# Characters stripped from both ends of a URL.
URL_EDGE_CHARS = ".,;:!?)]}\"'"

# Patterns. The whitespace class spells out the Unicode white space
# set so that Java and RE2 agree on it.
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_SEP = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
HTML_TAG = r"<[^>]+>"
EMAIL_ADDRESS = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b"
SERVING_URL = rf"(?i)\b(?:https?://|hxxps?://|www\.)[^{WS}<>\"']+"
TRAINING_URL = rf"(?i)\b(?:https?://|hxxps?://|hxxp?://|www\.)[^{WS}<>\"']+"
DEFANGED = r"(?i)hxxp|\[\.\]|\(\.\)"
SINHALA = r"[\x{0d80}-\x{0dff}]"
TAMIL = r"[\x{0b80}-\x{0bff}]"
LATIN = r"[A-Za-z]"

# Size limits and defaults.
MAX_EML_BYTES = 15 * 1024 * 1024
TEXT_CUT = 5000
SEED = 42
ENTROPY_ALERT = 4.5
