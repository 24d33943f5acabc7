"""Public-suffix rule table (ICANN section) as a small Spark DataFrame.

The rule list is fixed reference data of ~7k lines.  It is read from the
system copy when present, else from the copy that ships inside the
httpclient jar of every PySpark installation.  Each key row carries three
flags: a normal rule ``key``, a wildcard rule ``*.key`` and an exception
rule ``!key``.
"""

from __future__ import annotations

import glob
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession

SYSTEM_PSL = "/usr/share/publicsuffix/public_suffix_list.dat"
BEGIN_ICANN = "===BEGIN ICANN DOMAINS==="
END_ICANN = "===END ICANN DOMAINS==="


def _jar_psl_text() -> str | None:
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "httpclient-*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            for name in z.namelist():
                if name.endswith("public-suffix-list.txt"):
                    return z.read(name).decode("utf-8")
    return None


def psl_text(path: str | None = None) -> str:
    if path is None and os.path.exists(SYSTEM_PSL):
        path = SYSTEM_PSL
    if path is not None:
        with open(path, encoding="utf-8") as f:
            return f.read()
    text = _jar_psl_text()
    if text is None:
        raise FileNotFoundError("no public suffix list available")
    return text


def parse_rules(text: str, icann_only: bool = True) -> list[tuple[str, bool, bool, bool]]:
    """``(key, is_rule, is_wild_parent, is_exception)`` per distinct key."""
    if icann_only and BEGIN_ICANN in text:
        text = text[text.index(BEGIN_ICANN):text.index(END_ICANN)]
    flags: dict[str, list[bool]] = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("//"):
            continue
        rule = line.split()[0].lower()
        if rule.startswith("!"):
            flags.setdefault(rule[1:], [False, False, False])[2] = True
        elif rule.startswith("*."):
            flags.setdefault(rule[2:], [False, False, False])[1] = True
        else:
            flags.setdefault(rule, [False, False, False])[0] = True
    # hosts may be written in punycode: add the ASCII (IDNA) form of every
    # internationalised rule key with the same flags
    for k, v in list(flags.items()):
        if not k.isascii():
            try:
                ascii_key = ".".join(lab.encode("idna").decode("ascii") for lab in k.split("."))
            except UnicodeError:
                continue
            cur = flags.setdefault(ascii_key, [False, False, False])
            flags[ascii_key] = [a or b for a, b in zip(cur, v)]
    return [(k, *v) for k, v in sorted(flags.items())]


_PARSED: dict = {}
_FRAMES: dict = {}


def suffix_rules(spark: SparkSession, path: str | None = None,
                 icann_only: bool = True) -> tuple[DataFrame, int]:
    """Rule DataFrame and the deepest candidate (labels) a rule can match."""
    key = (path, icann_only)
    if key not in _PARSED:
        _PARSED[key] = parse_rules(psl_text(path), icann_only)
    fkey = (spark.sparkContext.applicationId, key)
    if fkey not in _FRAMES:
        rows = _PARSED[key]
        depth = max(k.count(".") + 1 + (1 if w else 0) for k, _, w, _ in rows)
        df = spark.createDataFrame(
            rows, "rule_key string, is_rule boolean, is_wild_parent boolean, is_exception boolean")
        _FRAMES[fkey] = (df.cache(), depth)  # a few hundred KB, reused by every suffix join
    return _FRAMES[fkey]


def psl_section_sql(path: str = SYSTEM_PSL) -> str:
    """DuckDB SQL producing ``(rule)`` lines of the ICANN section."""
    return (f"SELECT trim(split_part(trim(line), ' ', 1)) AS rule FROM ("
            f"SELECT unnest(string_split(substr(content, strpos(content, '{BEGIN_ICANN}'), "
            f"strpos(content, '{END_ICANN}') - strpos(content, '{BEGIN_ICANN}')), chr(10))) AS line "
            f"FROM read_text('{path}')) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '//')")
