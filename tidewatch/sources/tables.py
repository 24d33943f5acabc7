"""Input tables.

``url_table`` turns the driver's ``pages`` table into the reference's
``(url, type)`` table.  The class column is derived by a portable rule that is
written once for Spark and once as SQL, so both engines label identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
          "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def page_type() -> F.Column:
    """Class label of a page (fixed rule, mirrored by PAGE_TYPE_SQL)."""
    u, pid = F.col("url"), F.col("page_id")
    return (F.when(u.like("%spam-farm%") | u.like("%cheap-pills%"), "phishing")
            .when(pid % 10 == 0, "defacement")
            .when(pid % 10 == 1, "malware")
            .otherwise("benign"))


PAGE_TYPE_SQL = ("CASE WHEN url LIKE '%spam-farm%' OR url LIKE '%cheap-pills%' "
                 "THEN 'phishing' WHEN page_id % 10 = 0 THEN 'defacement' "
                 "WHEN page_id % 10 = 1 THEN 'malware' ELSE 'benign' END")


# URL shapes that the pages lack, by remainder of the page id: every page keeps
# its row, some get another URL.  {p} is the page id.  Allowed domains, guard
# rules, unseen domains, hosts with port, octets, user, upper case, trailing
# dot, wildcard and exception suffixes, shorteners, archives.
URL_SHAPES = {
    0: ("http://www.google.com/search?q=", ""),
    1: ("https://docs.github.com/en/", "/"),
    2: ("http://paypal-verification-secure-login", ".com/login.php"),
    3: ("http://x", "qm.biz/session/payload.exe"),
    4: ("http://192.168.10.7:8080/admin;a=1~b+c*d?x=1&y=%20#", ""),
    5: ("https://user@shop.co.uk//cart//item", "/"),
    6: ("http://bit.ly/", ""),
    7: ("http://files.new.site.xyz/a", ".zip"),
    8: ("http://WWW.Example.COM./Path", ""),
    9: ("http://a.b.foo.ck/p", ""),
    10: ("http://www.ck/q_", ""),
    11: ("http://999.999.999.999/z", ""),
    12: ("https://login.bank-account.example.org/verify?id=", "&go=1"),
}
_SHAPES = 29  # prime to the class rule's 10


def page_url() -> F.Column:
    """URL of a page under the shapes above (fixed rule, mirrored by PAGE_URL_SQL)."""
    expr = F.col("url")
    for r, (head, tail) in URL_SHAPES.items():
        expr = F.when(F.col("page_id") % _SHAPES == r,
                      F.concat(F.lit(head), F.col("page_id").cast("string"), F.lit(tail))).otherwise(expr)
    return expr


PAGE_URL_SQL = ("CASE " + " ".join(
    f"WHEN page_id % {_SHAPES} = {r} THEN '{head}' || CAST(page_id AS VARCHAR) || '{tail}'"
    for r, (head, tail) in reversed(URL_SHAPES.items())) + " ELSE url END")


def url_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, url, type)``; the html column is pruned at the scan."""
    return (read_table(spark, sf_dir, "pages")
            .select("page_id", page_url().alias("url"), page_type().alias("type")))


# SQL form of url_table for the DuckDB oracle.
URLS_SQL = f"SELECT page_id, {PAGE_URL_SQL} AS url, {PAGE_TYPE_SQL} AS type FROM pages"


def dirty_url_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``url_table`` as a raw file may look: padded, upper-case, unknown and
    missing labels, missing and blank URLs (fixed rule, mirrored by DIRTY_SQL)."""
    p = F.col("page_id") % 13
    t = (F.when(p == 1, F.concat(F.lit("  "), F.upper("type"), F.lit(" "))).when(p == 2, F.lit("unknown"))
         .when(p == 3, F.lit(None)).otherwise(F.col("type")))
    u = F.when(p == 4, F.lit(None)).when(p == 5, F.lit(" \t ")).otherwise(F.col("url"))
    return url_table(spark, sf_dir).select("page_id", u.alias("url"), t.alias("type"))


DIRTY_SQL = ("SELECT page_id, CASE WHEN page_id % 13 = 4 THEN NULL WHEN page_id % 13 = 5 THEN ' ' || chr(9) || ' ' "
             "ELSE url END AS url, CASE WHEN page_id % 13 = 1 THEN '  ' || upper(type) || ' ' "
             "WHEN page_id % 13 = 2 THEN 'unknown' WHEN page_id % 13 = 3 THEN NULL ELSE type END AS type "
             f"FROM ({URLS_SQL})")


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a 4-class label ``quality*2 + toxic``, or 'unlabelled'."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "text", F.coalesce((F.col("quality") * 2 + F.col("toxic")).cast("int").cast("string"),
                                     F.lit("unlabelled")).alias("target"))
