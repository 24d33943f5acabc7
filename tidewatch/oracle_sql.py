"""DuckDB SQL text used as the independent oracle of the Spark queries.

Only string templates live here; the Spark side never executes them.
"""

from __future__ import annotations

from .constants import FEATURE_COLS
from .constants import (ARCHIVE_PATTERN, CONSONANT_PATTERN, KEYWORD_PATTERN, SHORTENER_PATTERN,
                        SPECIAL_PATTERN, SUSPICIOUS_TLD_PATTERN)
from .functions.lexical import HOST_PATTERN, PATH_PATTERN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cnt(c: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {q(pattern)})) AS BIGINT)"


def entropy(c: str) -> str:
    p = f"((length({c}) - length(replace({c}, ch, ''))) / length({c}))"
    return (f"(CASE WHEN length({c}) = 0 THEN 0.0 ELSE "
            f"list_sum(list_transform(list_distinct(string_split({c}, '')), "
            f"lambda ch: -{p} * log2({p}))) END)")


def ratio(num: str, den: str) -> str:
    return f"COALESCE(CAST({num} AS DOUBLE) / NULLIF({den}, 0), 0.0)"


def features(u: str = "url", host: str = "host", path: str = "path") -> dict[str, str]:
    """SQL of the 40 features given column names of url, host and path."""
    n = f"length({u})"
    digits = cnt(u, r"\p{Nd}")
    special = cnt(u, SPECIAL_PATTERN)
    vowels = cnt(u, "[aeiouAEIOU]")
    cons = cnt(u, CONSONANT_PATTERN)
    letters = cnt(u, "[a-zA-Z]")
    sub = cnt(host, r"\.")
    b = lambda e: f"CAST({e} AS BIGINT)"
    m = {
        "url_length": b(n),
        "domain_length": b(f"length({host})"),
        "path_length": b(f"length({path})"),
        "subdomain_count": sub,
        "num_dots": cnt(u, r"\."),
        "num_digits": digits,
        "num_hyphens": cnt(u, "-"),
        "num_special_chars": special,
        "https_flag": b(f"starts_with({u}, 'https')"),
        "contains_ip": b(f"regexp_matches({host}, {q(r'\b(?:\d{1,3}\.){3}\d{1,3}\b')})"),
        "num_underscores": cnt(u, "_"),
        "num_equals": cnt(u, "="),
        "num_ampersands": cnt(u, "&"),
        "num_percent": cnt(u, "%"),
        "num_semicolons": cnt(u, ";"),
        "num_tilde": cnt(u, "~"),
        "num_plus": cnt(u, r"\+"),
        "num_asterisk": cnt(u, r"\*"),
        "num_hash": cnt(u, "#"),
        "vowel_count": vowels,
        "consonant_count": cons,
        "letter_count": letters,
        "has_port": b(f"regexp_matches({u}, {q(r':\p{Nd}+')})"),
        "entropy": entropy(u),
        "domain_entropy": entropy(host),
        "unique_char_ratio": ratio(
            f"(CASE WHEN {n} = 0 THEN 0 ELSE len(list_distinct(string_split({u}, ''))) END)", n),
        "digit_ratio": ratio(digits, n),
        "special_char_ratio": ratio(special, n),
        "query_param_count": cnt(u, "[&?]"),
        "longest_token_length": b(
            f"COALESCE(list_max(list_transform(regexp_split_to_array({u}, "
            f"{q(r'[^\p{L}\p{N}_]+')}), lambda t: length(t))), 0)"),
        "vowel_ratio": ratio(vowels, n),
        "consonant_ratio": ratio(cons, n),
        "letter_ratio": ratio(letters, n),
        "suspicious_keyword_count": cnt(u, KEYWORD_PATTERN),
        "contains_at": b(f"contains({u}, '@')"),
        "double_slash_count": b(f"greatest({cnt(u, '//')} - 1, 0)"),
        "is_shortened": b(f"regexp_matches({host}, {q(SHORTENER_PATTERN)})"),
        "has_exe_or_zip": b(f"regexp_matches({u}, {q(ARCHIVE_PATTERN)})"),
        "suspicious_tld": b(f"regexp_matches({host}, {q(SUSPICIOUS_TLD_PATTERN)})"),
        "multiple_subdomains": b(f"{sub} > 2"),
    }
    assert list(m) == FEATURE_COLS
    return m


def host_path_select(u: str = "url") -> str:
    return (f"regexp_extract({u}, {q(HOST_PATTERN)}, 1) AS host, "
            f"regexp_extract({u}, {q(PATH_PATTERN)}, 1) AS path")


def with_lex_host_path(src: str, u: str = "url") -> str:
    """``src`` plus the lexical-regex host and path as ``host_lex`` and ``path``."""
    return (f"SELECT *, regexp_extract({u}, {q(HOST_PATTERN)}, 1) AS host_lex, "
            f"regexp_extract({u}, {q(PATH_PATTERN)}, 1) AS path FROM ({src})")


def features_select(u: str = "url", round_digits: int | None = 9) -> str:
    parts = []
    for name, e in features(u).items():
        if round_digits is not None and "CAST" not in e[:5]:
            e = f"round({e}, {round_digits}) + 0.0"
        parts.append(f"{e} AS {name}")
    return ",\n  ".join(parts)


def host_sql(u: str = "url") -> str:
    rest = f"regexp_replace({u}, {q(r'^(?:[A-Za-z0-9+\-.]+:)?//')}, '')"
    auth = f"regexp_extract({rest}, '^([^/?#]*)', 1)"
    nouser = f"list_last(string_split({auth}, '@'))"
    v6 = f"regexp_extract({nouser}, '^(\\[[^\\]]*\\])', 1)"
    v4 = f"rtrim(translate(regexp_extract({nouser}, '^([^:]*)', 1), '\u3002\uff0e\uff61', '...'), '.')"
    return f"(CASE WHEN {v6} <> '' THEN {v6} ELSE {v4} END)"


def suffix_ctes(src: str, key: str = "page_id") -> str:
    """CTEs ending in ``dom`` = src columns + host, registered_domain, tld, stem.

    Independent formulation: explode candidate suffixes, equi-join the rule
    lines, aggregate per row.
    """
    from .sources.suffix_rules import psl_section_sql
    return f"""
psl AS ({psl_section_sql()}),
rl AS (SELECT DISTINCT lower(rule) AS rule FROM psl),
hs AS (SELECT s.*, {host_sql('s.url')} AS host FROM ({src}) s),
lb AS (SELECT {key} AS rk, host, string_split(lower(host), '.') AS labs, string_split(host, '.') AS olabs FROM hs),
cd AS (SELECT rk, k, array_to_string(list_slice(labs, len(labs) - k + 1, len(labs)), '.') AS c,
              array_to_string(list_slice(labs, len(labs) - k + 2, len(labs)), '.') AS p
       FROM lb, range(1, 12) t(k) WHERE k <= len(labs)),
ck AS (SELECT rk, k, c AS key, 'n' AS mode FROM cd
       UNION ALL SELECT rk, k, '*.' || p, 'w' FROM cd WHERE k >= 2
       UNION ALL SELECT rk, k, '!' || c, 'e' FROM cd),
mt AS (SELECT ck.rk, max(CASE WHEN mode IN ('n', 'w') THEN k END) AS mlen,
              max(CASE WHEN mode = 'e' THEN k - 1 END) AS elen
       FROM ck JOIN rl ON rl.rule = ck.key GROUP BY ck.rk),
sl AS (SELECT lb.*, CASE WHEN (regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') AND NOT regexp_matches(host, '(^|\\.)(0[0-9]|[0-9]{{4}}|[3-9][0-9]{{2}}|2[6-9][0-9]|25[6-9])'))
                             OR regexp_matches(host, '^\\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\\]$') THEN 0
                        ELSE coalesce(mt.elen, mt.mlen, 0) END AS slen,
              (regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') AND NOT regexp_matches(host, '(^|\\.)(0[0-9]|[0-9]{{4}}|[3-9][0-9]{{2}}|2[6-9][0-9]|25[6-9])'))
                OR regexp_matches(host, '^\\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\\]$') AS is_ip, len(olabs) AS n
       FROM lb LEFT JOIN mt ON lb.rk = mt.rk),
sx AS (SELECT rk,
              CASE WHEN slen > 0 THEN array_to_string(list_slice(olabs, n - slen + 1, n), '.') ELSE '' END AS tld,
              CASE WHEN is_ip THEN host WHEN n > slen THEN olabs[n - slen] ELSE '' END AS stem
       FROM sl),
dom AS (SELECT hs.*, CASE WHEN sx.stem <> '' THEN sx.stem || '.' || sx.tld ELSE sx.tld END AS registered_domain,
               sx.tld, sx.stem
        FROM hs JOIN sx ON hs.{key} = sx.rk)"""


def split_sql(src: str, class_col: str, key: str, nested: bool = True) -> str:
    """Rows of ``src`` plus ``split`` by md5-ordered exact class quotas."""
    val = ("WHEN rk <= n * 70 // 100 + (n - n * 70 // 100) // 2 THEN 'val' " if nested else "")
    return (f"SELECT * EXCLUDE (rk, n), CASE WHEN rk <= n * 70 // 100 THEN 'train' {val}ELSE 'test' END AS split "
            f"FROM (SELECT *, rank() OVER (PARTITION BY {class_col} ORDER BY md5('42' || CAST({key} AS VARCHAR)), "
            f"{key}) AS rk, count(*) OVER (PARTITION BY {class_col}) AS n FROM ({src}))")


def lit(v) -> str:
    return q(v) if isinstance(v, str) else str(v)


def reputation_sql(src: str, key: str, parent: str, class_col: str, classes, out_cols,
                   digits: int = 9) -> str:
    """Reputation columns for every row of ``src`` (which has ``split``)."""
    k = len(classes)
    cnt = ", ".join(f"sum(CASE WHEN {class_col} = {lit(c)} THEN 1 ELSE 0 END) AS c{i}"
                    for i, c in enumerate(classes))
    pri = ", ".join(f"sum(CASE WHEN {class_col} = {lit(c)} THEN 1 ELSE 0 END) / count(*) AS p{i}"
                    for i, c in enumerate(classes))
    ent = " + ".join(f"(CASE WHEN ds.c{i} > 0 THEN (ds.c{i} / ds.n) * log2(ds.c{i} / ds.n) ELSE 0 END)"
                     for i in range(k))
    r = (lambda e: f"round({e}, {digits}) + 0.0") if digits is not None else (lambda e: e)
    sel = [f"s.{c}" for c in out_cols]
    sel += ["CAST(coalesce(ds.n, 0) AS BIGINT) AS domain_frequency",
            f"{r(f'coalesce(-({ent}), 0.0)')} AS domain_class_entropy"]
    for i in range(k):
        tp = f"coalesce(ps.c{i} / ps.n, pr.p{i})"
        dp = f"coalesce(ds.c{i} / ds.n, {tp})"
        sel += [f"CAST(coalesce(ds.c{i}, 0) AS BIGINT) AS domain_class_{i}_count",
                f"{r(tp)} AS tld_class_{i}_prob", f"{r(dp)} AS domain_class_{i}_prob",
                f"{r(dp)} AS R_graph_class_{i}"]
    return f"""src AS ({src}),
tr AS (SELECT * FROM src WHERE split = 'train'),
ds AS (SELECT {key} AS k, count(*) AS n, {cnt} FROM tr GROUP BY {key}),
ps AS (SELECT {parent} AS k, count(*) AS n, {cnt} FROM tr GROUP BY {parent}),
pr AS (SELECT {pri} FROM tr)
SELECT {', '.join(sel)} FROM src s LEFT JOIN ds ON s.{key} = ds.k LEFT JOIN ps ON s.{parent} = ps.k CROSS JOIN pr"""
