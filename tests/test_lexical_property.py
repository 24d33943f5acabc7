"""Property test: the Spark feature expressions against a plain-Python
statement of the feature definitions (Python ``re`` semantics), on random
URL-like strings including non-ASCII digits and letters."""

import math
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.constants import FEATURE_COLS
from tidewatch.functions.lexical import with_lexical_features

ALPHABET = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") + list(
    ".-/:?&=%;~+*#@_! ") + ["٣", "é", "ß", "中", "Ⅻ", "😀", "𝔘"]
PIECES = ["http://", "https://", "www.", ".com", "login", "Verify", "bit.ly", ".exe", ".xyz", "//", ":8080",
          "1.2.3.4", "paypal", ".pro"]

URLS = st.lists(st.one_of(st.sampled_from(ALPHABET), st.sampled_from(PIECES)), min_size=1, max_size=25).map("".join)


def ref_features(u: str) -> dict:
    host_m = re.search(r"^(?:https?://)?([^/:\?]+)", u)
    host = host_m.group(1) if host_m else ""
    path_m = re.search(r"^(?:https?://)?[^/:\?]+(/[^\?]*)", u)
    path = path_m.group(1) if path_m else ""

    def ent(s):
        if not s:
            return 0.0
        n = len(s)
        return -sum((c / n) * math.log2(c / n) for c in Counter(s).values())
    n = len(u)
    cnt = lambda p, s=u: len(re.findall(p, s))
    digits = cnt(r"\d")
    special = cnt(r"[^a-zA-Z0-9.\-/:\?]")
    vowels, cons, letters = cnt("[aeiouAEIOU]"), cnt("[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]"), cnt("[a-zA-Z]")
    r = lambda x: x / n if n else 0.0
    toks = [t for t in re.split(r"\W+", u) if t]
    return {
        "url_length": n, "domain_length": len(host), "path_length": len(path),
        "subdomain_count": host.count("."), "num_dots": u.count("."), "num_digits": digits,
        "num_hyphens": u.count("-"), "num_special_chars": special, "https_flag": int(u.startswith("https")),
        "contains_ip": int(bool(re.search(r"\b(?:\d{1,3}\.){3}\d{1,3}\b", host))),
        "num_underscores": u.count("_"), "num_equals": u.count("="), "num_ampersands": u.count("&"),
        "num_percent": u.count("%"), "num_semicolons": u.count(";"), "num_tilde": u.count("~"),
        "num_plus": u.count("+"), "num_asterisk": u.count("*"), "num_hash": u.count("#"),
        "vowel_count": vowels, "consonant_count": cons, "letter_count": letters,
        "has_port": int(bool(re.search(r":\d+", u))), "entropy": ent(u), "domain_entropy": ent(host),
        "unique_char_ratio": r(len(set(u))), "digit_ratio": r(digits), "special_char_ratio": r(special),
        "query_param_count": cnt("[&?]"), "longest_token_length": max((len(t) for t in toks), default=0),
        "vowel_ratio": r(vowels), "consonant_ratio": r(cons), "letter_ratio": r(letters),
        "suspicious_keyword_count": len(re.findall(
            r"(?i)(login|verify|update|secure|bank|account|confirm|free|bonus|admin|webscr|paypal|signin)", u)),
        "contains_at": int("@" in u), "double_slash_count": max(u.count("//") - 1, 0),
        "is_shortened": int(bool(re.search(r"(bit\.ly|goo\.gl|t\.co|ow\.ly|is\.gd|tinyurl|tr\.im)", host))),
        "has_exe_or_zip": int(bool(re.search(r"(?i)(\.exe|\.zip|\.rar|\.tar|\.gz|\.7z)", u))),
        "suspicious_tld": int(bool(re.search(r"(?i)(\.top|\.xyz|\.club|\.site|\.online|\.pro|\.pw)", host))),
        "multiple_subdomains": int(host.count(".") > 2),
    }


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(URLS, min_size=60, max_size=60))
def test_features_match_python_definitions(spark, urls):
    df = spark.createDataFrame([(i, u, "benign") for i, u in enumerate(urls)], "i int, url string, type string")
    rows = {r["i"]: r for r in with_lexical_features(df).collect()}
    for i, u in enumerate(urls):
        ref = ref_features(u)
        for c in FEATURE_COLS:
            assert math.isclose(float(rows[i][c]), float(ref[c]), abs_tol=1e-9), (u, c, rows[i][c], ref[c])
