"""The 40 lexical URL features and reusable string functions.

Everything here is a Spark built-in expression (regexp_count, regexp_extract,
higher-order array functions), so it stays in the JVM and the narrow projection
fuses with the scan.  Regexes use Java syntax with explicit Unicode classes so
that ``\\d``/``\\w`` keep their Unicode meaning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ARCHIVE_PATTERN, CONSONANT_PATTERN, DISPLAY_WIDTH, ENTROPY_HIGH,
                         ENTROPY_LOW, FEATURE_COLS, KEYWORD_PATTERN, SHORTENER_PATTERN,
                         SPECIAL_PATTERN, SUSPICIOUS_TLD_PATTERN)

# fixed values: host and path patterns of the lexical features
HOST_PATTERN = r"^(?:https?://)?([^/:\?]+)"
PATH_PATTERN = r"^(?:https?://)?[^/:\?]+(/[^\?]*)"
IPV4_PATTERN = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
TOKEN_SEPARATOR = r"[^\p{L}\p{N}_]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_matches(c, pattern: str) -> Column:
    """Number of non-overlapping regex matches."""
    return F.regexp_count(_c(c), F.lit(pattern))


def lexical_host(c) -> Column:
    """Regex host of the lexical features ('' when absent)."""
    return F.regexp_extract(_c(c), HOST_PATTERN, 1)


def lexical_path(c) -> Column:
    return F.regexp_extract(_c(c), PATH_PATTERN, 1)


def char_count(c, ch: Column) -> Column:
    c = _c(c)
    return F.length(c) - F.length(F.replace(c, ch, F.lit("")))


def shannon_entropy(c) -> Column:
    """Shannon entropy in bits over the code points of a string; '' -> 0."""
    c = _c(c)
    n = F.length(c)

    def step(acc, ch):
        p = char_count(c, ch) / n
        return acc - p * F.log2(p)

    ent = F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), step)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(ent)


STRETCH = 1 << 20  # characters counted at once


def _pieces(texts: pa.Array):
    """``(row, code points)`` of an Arrow array of strings, at most STRETCH at a time of a text."""
    for row, text in enumerate(texts):
        t = text.as_py() or ""
        for i in range(0, len(t), STRETCH):
            yield row, np.frombuffer(t[i:i + STRETCH].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _stretches(texts: pa.Array):
    """Pieces together as ``(rows, their code points)``, fewer than two times STRETCH a stretch."""
    rows, parts, size = [], [], 0
    for row, cp in _pieces(texts):
        rows.append(row)
        parts.append(cp)
        size += len(cp)
        if size >= STRETCH:
            yield rows, parts
            rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _char_stats(texts: pa.Array) -> pa.Array:
    """Shannon entropy and number of distinct characters of a batch of strings.  Every (row, code point)
    pair is counted by numpy, a stretch of the batch at a time, so memory does not follow its characters."""
    keys, counts = [], []
    for rows, parts in _stretches(texts):
        seg = np.repeat(np.array(rows, dtype=np.uint64) << np.uint64(32), [len(p) for p in parts])
        k, n = np.unique(seg | np.concatenate(parts), return_counts=True)
        keys.append(k)
        counts.append(n)
    out, distinct = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    if keys:
        # a text over two stretches has counts in both
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(at, np.concatenate(counts), len(pair))
        row = (pair >> np.uint64(32)).astype(np.int64)
        prob = count / np.bincount(row, count, len(texts))[row]
        out = np.bincount(row, weights=-prob * np.log2(prob), minlength=len(texts))
        distinct = np.bincount(row, minlength=len(texts))
    return pa.StructArray.from_arrays([pa.array(out + 0.0), pa.array(distinct.astype(np.int64))], names=["entropy", "distinct"])


def char_stats_long(c) -> Column:
    """struct(entropy, distinct) of long texts (documents).  The built-in form
    above rescans the string once per distinct character, which is fine for URLs
    but costs O(length x alphabet) on whole documents; this Arrow UDF counts
    code points with numpy, and works on the batch as it came, stretch by stretch."""
    return F.arrow_udf(_char_stats, "struct<entropy:double,distinct:long>")(_c(c))


def shannon_entropy_long(c) -> Column:
    return char_stats_long(c)["entropy"]


def unique_char_count(c) -> Column:
    c = _c(c)
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(
        F.size(F.array_distinct(F.split(c, ""))))


def longest_token_length(c) -> Column:
    toks = F.split(_c(c), TOKEN_SEPARATOR)
    return F.coalesce(F.array_max(F.transform(toks, lambda t: F.length(t))), F.lit(0))


def entropy_risk(ent: Column) -> Column:
    """Risk bucket of an entropy value: low / medium / high."""
    return (F.when(ent < ENTROPY_LOW, "low")
            .when(ent < ENTROPY_HIGH, "medium").otherwise("high"))


def display_truncate(c, width: int = DISPLAY_WIDTH) -> Column:
    c = _c(c)
    return F.when(F.length(c) > width,
                  F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)


def keyword_hits(c, keywords) -> Column:
    """Number of distinct keywords contained (case-insensitive substring)."""
    low = F.lower(_c(c))
    return sum((F.instr(low, F.lit(k)) > 0).cast("int") for k in keywords)


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.when(den != 0, den), F.lit(0.0)).cast("double")


def feature_columns(url_col: str = "url", stats: tuple[str, str] | None = None) -> list[Column]:
    """The 40 lexical features of ``url_col`` in FEATURE_COLS order.  For long
    texts ``stats`` names two columns with ``char_stats_long`` of the text and of
    its lexical host; entropies and distinct characters are read from them."""
    u = F.col(url_col)
    host = lexical_host(u)
    path = lexical_path(u)
    n = F.length(u)
    num_digits = count_matches(u, r"\p{Nd}")
    num_special = count_matches(u, SPECIAL_PATTERN)
    vowels = count_matches(u, "[aeiouAEIOU]")
    consonants = count_matches(u, CONSONANT_PATTERN)
    letters = count_matches(u, "[a-zA-Z]")
    sub_count = count_matches(host, r"\.")
    big = "bigint"
    exprs = {
        "url_length": n.cast(big),
        "domain_length": F.length(host).cast(big),
        "path_length": F.length(path).cast(big),
        "subdomain_count": sub_count.cast(big),
        "num_dots": count_matches(u, r"\.").cast(big),
        "num_digits": num_digits.cast(big),
        "num_hyphens": count_matches(u, "-").cast(big),
        "num_special_chars": num_special.cast(big),
        "https_flag": u.startswith("https").cast(big),
        "contains_ip": host.rlike(IPV4_PATTERN).cast(big),
        "num_underscores": count_matches(u, "_").cast(big),
        "num_equals": count_matches(u, "=").cast(big),
        "num_ampersands": count_matches(u, "&").cast(big),
        "num_percent": count_matches(u, "%").cast(big),
        "num_semicolons": count_matches(u, ";").cast(big),
        "num_tilde": count_matches(u, "~").cast(big),
        "num_plus": count_matches(u, r"\+").cast(big),
        "num_asterisk": count_matches(u, r"\*").cast(big),
        "num_hash": count_matches(u, "#").cast(big),
        "vowel_count": vowels.cast(big),
        "consonant_count": consonants.cast(big),
        "letter_count": letters.cast(big),
        "has_port": u.rlike(r":\p{Nd}+").cast(big),
        "entropy": F.col(stats[0])["entropy"] if stats else shannon_entropy(u),
        "domain_entropy": F.col(stats[1])["entropy"] if stats else shannon_entropy(host),
        "unique_char_ratio": _ratio(F.col(stats[0])["distinct"] if stats else unique_char_count(u), n),
        "digit_ratio": _ratio(num_digits, n),
        "special_char_ratio": _ratio(num_special, n),
        "query_param_count": count_matches(u, "[&?]").cast(big),
        "longest_token_length": longest_token_length(u).cast(big),
        "vowel_ratio": _ratio(vowels, n),
        "consonant_ratio": _ratio(consonants, n),
        "letter_ratio": _ratio(letters, n),
        "suspicious_keyword_count": count_matches(u, KEYWORD_PATTERN).cast(big),
        "contains_at": u.contains("@").cast(big),
        "double_slash_count": F.greatest(count_matches(u, "//") - 1, F.lit(0)).cast(big),
        "is_shortened": host.rlike(SHORTENER_PATTERN).cast(big),
        "has_exe_or_zip": u.rlike(ARCHIVE_PATTERN).cast(big),
        "suspicious_tld": host.rlike(SUSPICIOUS_TLD_PATTERN).cast(big),
        "multiple_subdomains": (sub_count > 2).cast(big),
    }
    return [exprs[name].alias(name) for name in FEATURE_COLS]


def with_lexical_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """``build_features``: append the 40 features (one narrow projection)."""
    return df.select("*", *feature_columns(url_col))
