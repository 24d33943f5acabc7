import math

import pytest
from pyspark.sql import functions as F

from tidewatch.constants import FEATURE_COLS
from tidewatch.functions.lexical import (display_truncate, entropy_risk, shannon_entropy,
                                         with_lexical_features)

GOLDEN_URLS = [
    "aaaa", "ab", "http://secure-login.com/verify/update", "https://google.com/search?q=hello",
    "www.google.com", "http://paypal-verification-secure-login-account89.com/login.php",
    "http://x89qm12-z90a1.biz/auth/session/payload.exe", "https://docs.github.com/en/rest/reference/repos",
    "suspicious-verify-bank-update.net/login", "http://1.2.3.4:8080/a//b?x=1&y=2#f", "HTTP://EX.COM/UP",
    "http://user@h.co.uk/p;q", "reddit.com/r", "a.b.c.prod.example.xyz/%20~+*_d.TAR.gz",
]

# golden values of the feature table in FIXTURES.md (g1..g14)
GOLDEN = {
    "url_length": [4, 2, 37, 33, 14, 63, 49, 47, 39, 34, 16, 23, 12, 38],
    "domain_length": [4, 2, 16, 10, 14, 46, 17, 15, 33, 7, 4, 12, 10, 22],
    "path_length": [0, 0, 14, 7, 0, 10, 25, 24, 6, 0, 0, 4, 2, 16],
    "subdomain_count": [0, 0, 1, 1, 2, 1, 1, 2, 1, 3, 0, 2, 1, 5],
    "num_dots": [0, 0, 1, 1, 2, 2, 2, 2, 1, 3, 1, 2, 1, 7],
    "num_digits": [0, 0, 0, 0, 0, 2, 7, 0, 0, 10, 0, 0, 0, 2],
    "num_hyphens": [0, 0, 1, 0, 0, 4, 1, 0, 3, 0, 0, 0, 0, 0],
    "num_special_chars": [0, 0, 0, 1, 0, 0, 0, 0, 0, 4, 0, 2, 0, 5],
    "https_flag": [0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0],
    "contains_ip": [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0],
    "num_underscores": [0] * 13 + [1],
    "num_equals": [0, 0, 0, 1, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0],
    "num_ampersands": [0] * 9 + [1, 0, 0, 0, 0],
    "num_percent": [0] * 13 + [1],
    "num_semicolons": [0] * 11 + [1, 0, 0],
    "num_tilde": [0] * 13 + [1],
    "num_plus": [0] * 13 + [1],
    "num_asterisk": [0] * 13 + [1],
    "num_hash": [0] * 9 + [1, 0, 0, 0, 0],
    "vowel_count": [4, 1, 11, 8, 4, 19, 12, 12, 14, 1, 3, 4, 3, 6],
    "consonant_count": [0, 1, 19, 18, 8, 32, 21, 26, 20, 8, 8, 11, 7, 17],
    "letter_count": [4, 2, 30, 26, 12, 51, 33, 38, 34, 9, 11, 15, 10, 23],
    "has_port": [0] * 9 + [1, 0, 0, 0, 0],
    "entropy": [0.0, 1.0, 4.324186, 3.983196, 2.842371, 4.347070, 4.556051, 3.923290, 4.265545,
                4.194388, 3.452820, 3.882045, 3.251629, 4.414994],
    "domain_entropy": [0.0, 1.0, 3.625, 2.646439, 2.842371, 4.151401, 3.734522, 3.506891, 4.081532,
                       2.128085, 1.5, 3.251629, 3.121928, 3.568084],
    "unique_char_ratio": [0.25, 1.0, 0.621622, 0.545455, 0.571429, 0.380952, 0.551020, 0.404255,
                          0.564103, 0.617647, 0.75, 0.695652, 0.833333, 0.684211],
    "digit_ratio": [0, 0, 0, 0, 0, 0.031746, 0.142857, 0, 0, 0.294118, 0, 0, 0, 0.052632],
    "special_char_ratio": [0, 0, 0, 0.030303, 0, 0, 0, 0, 0, 0.117647, 0, 0.086957, 0, 0.131579],
    "query_param_count": [0, 0, 0, 1, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0],
    "longest_token_length": [4, 2, 6, 6, 6, 12, 7, 9, 10, 4, 4, 4, 6, 7],
    "vowel_ratio": [1.0, 0.5, 0.297297, 0.242424, 0.285714, 0.301587, 0.244898, 0.255319, 0.358974,
                    0.029412, 0.1875, 0.173913, 0.25, 0.157895],
    "consonant_ratio": [0.0, 0.5, 0.513514, 0.545455, 0.571429, 0.507937, 0.428571, 0.553191, 0.512821,
                        0.235294, 0.5, 0.478261, 0.583333, 0.447368],
    "letter_ratio": [1.0, 1.0, 0.810811, 0.787879, 0.857143, 0.809524, 0.673469, 0.808511, 0.871795,
                     0.264706, 0.6875, 0.652174, 0.833333, 0.605263],
    "suspicious_keyword_count": [0, 0, 4, 0, 0, 5, 0, 0, 4, 0, 0, 0, 0, 0],
    "contains_at": [0] * 11 + [1, 0, 0],
    "double_slash_count": [0] * 9 + [1, 0, 0, 0, 0],
    "is_shortened": [0] * 12 + [1, 0],
    "has_exe_or_zip": [0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1],
    "suspicious_tld": [0] * 13 + [1],
    "multiple_subdomains": [0] * 9 + [1, 0, 0, 0, 1],
}


@pytest.fixture(scope="module")
def golden_rows(spark):
    df = spark.createDataFrame([(i, u, "benign") for i, u in enumerate(GOLDEN_URLS)], "i int, url string, type string")
    return {r["i"]: r for r in with_lexical_features(df).collect()}


def test_feature_count(golden_rows):
    assert len(FEATURE_COLS) == 40
    assert set(GOLDEN) == set(FEATURE_COLS)


@pytest.mark.parametrize("feature", FEATURE_COLS)
def test_golden_feature(golden_rows, feature):
    for i, expected in enumerate(GOLDEN[feature]):
        got = golden_rows[i][feature]
        assert math.isclose(float(got), float(expected), abs_tol=1e-6), (feature, GOLDEN_URLS[i], got, expected)


def test_entropy_reference_cases(spark):
    df = spark.createDataFrame([("aaaa",), ("ab",), ("",)], "s string")
    got = [r[0] for r in df.select(shannon_entropy("s")).collect()]
    assert got == [0.0, 1.0, 0.0]


def test_keyword_count_case(spark):
    df = spark.createDataFrame([("http://secure-login.com/verify/update", "phishing")], "url string, type string")
    assert with_lexical_features(df).first()["suspicious_keyword_count"] >= 3


def test_entropy_risk_and_truncate(spark):
    df = spark.createDataFrame([(3.0, "x" * 40), (4.0, "short"), (5.0, "y")], "e double, s string")
    rows = df.select(entropy_risk(F.col("e")).alias("r"), display_truncate("s").alias("t")).collect()
    assert [r.r for r in rows] == ["low", "medium", "high"]
    assert rows[0].t == "x" * 35 + "..." and rows[1].t == "short"


def test_character_statistics_of_long_texts_hold_a_stretch_at_a_time(spark):
    """memory follows the stretch, not the characters of a batch; a text over several stretches is one text."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    from tidewatch.functions import lexical as L
    plain = lambda t: (-sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) + 0.0, len(set(t))) if t else (0.0, 0)
    long = "ab\U0001f600c" * (L.STRETCH // 2) + "z"  # over three stretches
    texts = ["", "aaaa", None, long, "äö a\x00", "x" * 7, long + "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.s.entropy, r.s.distinct) for r in df.select("i", L.char_stats_long("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (pytest.approx(plain(t)[0]), plain(t)[1])
    batch = pa.array(["lorem ipsum dolor sit amet " * 400] * 2000)  # 22 million characters
    tracemalloc.start()
    L._char_stats(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 * L.STRETCH
