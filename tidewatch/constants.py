"""Fixed values that must equal the reference behaviour (kept as plain text)."""

# --- fixed values: class labels, index = class id ---------------------------
CLASSES = ["benign", "defacement", "phishing", "malware"]
CLASS_IDS = {name: i for i, name in enumerate(CLASSES)}

# --- fixed values: lexical feature patterns ---------------------------------
KEYWORD_PATTERN = r"(?i)(login|verify|update|secure|bank|account|confirm|free|bonus|admin|webscr|paypal|signin)"
CONSONANT_PATTERN = "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]"
SPECIAL_PATTERN = r"[^a-zA-Z0-9.\-/:\?]"
SHORTENER_PATTERN = r"(bit\.ly|goo\.gl|t\.co|ow\.ly|is\.gd|tinyurl|tr\.im)"
ARCHIVE_PATTERN = r"(?i)(\.exe|\.zip|\.rar|\.tar|\.gz|\.7z)"
SUSPICIOUS_TLD_PATTERN = r"(?i)(\.top|\.xyz|\.club|\.site|\.online|\.pro|\.pw)"

# --- fixed values: serving guard ---------------------------------------------
ALLOW_LIST = ["google.com", "github.com", "microsoft.com", "apple.com",
              "youtube.com", "wikipedia.org", "amazon.com", "cloudflare.com"]
GUARD_KEYWORDS = ["paypal", "verification", "verify", "secure", "login", "bank",
                  "update", "account", "signin", "webscr", "confirm", "suspicious"]
MALWARE_MARKERS = ["payload", ".exe", ".zip", ".rar", ".tar", ".gz"]
ALLOW_VECTOR = [0.999, 0.0, 0.001, 0.0]
MALWARE_VECTOR = [0.05, 0.05, 0.10, 0.80]
PHISHING_VECTOR = [0.05, 0.05, 0.80, 0.10]
GUARD_ENTROPY = 4.2
GUARD_MIN_KEYWORDS = 2

# --- fixed values: fusion --------------------------------------------------
ALPHA_GRID = [0.3, 0.5, 0.7]
SERVING_ALPHA = 0.7
MISSING_GRAPH_VECTOR = [0.65, 0.15, 0.15, 0.05]
EPS = 1e-9

# --- fixed values: splits ---------------------------------------------------
SPLIT_SEED = "42"
TRAIN_FRACTION = 0.70
VAL_FRACTION = 0.15

# --- fixed values: entropy risk buckets and display --------------------------
ENTROPY_LOW = 3.5
ENTROPY_HIGH = 4.5
DISPLAY_WIDTH = 35

# --- fixed values: feature names in order; the single source of truth for every model and report
FEATURE_COLS = [
    "url_length", "domain_length", "path_length", "subdomain_count", "num_dots",
    "num_digits", "num_hyphens", "num_special_chars", "https_flag", "contains_ip",
    "num_underscores", "num_equals", "num_ampersands", "num_percent",
    "num_semicolons", "num_tilde", "num_plus", "num_asterisk", "num_hash",
    "vowel_count", "consonant_count", "letter_count", "has_port",
    "entropy", "domain_entropy", "unique_char_ratio", "digit_ratio",
    "special_char_ratio", "query_param_count", "longest_token_length",
    "vowel_ratio", "consonant_ratio", "letter_ratio",
    "suspicious_keyword_count", "contains_at", "double_slash_count",
    "is_shortened", "has_exe_or_zip", "suspicious_tld", "multiple_subdomains",
]
assert len(FEATURE_COLS) == 40
