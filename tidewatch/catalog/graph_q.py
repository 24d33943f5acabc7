"""Queries over the URL-domain-suffix graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle_sql as S
from ..constants import FEATURE_COLS
from ..functions.lexical import feature_columns
from ..operators import graph as GR
from ..plans.prepare import labelled_urls
from ..session import materialize
from . import query, rounded
from .reputation_q import LABELLED_SQL

_LF_SQL = ("SELECT l.* EXCLUDE (host_lex, path), " + ", ".join(
    f"CAST({e} AS DOUBLE) AS {n}" for n, e in S.features("url", "host_lex", "path").items())
    + f" FROM ({S.with_lex_host_path(LABELLED_SQL)}) l")


def _r6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


def _lf(spark, sf_dir):
    u = labelled_urls(spark, sf_dir)
    return u.select(*u.columns, *[c.cast("double").alias(n) for c, n in zip(feature_columns("url"), FEATURE_COLS)])


@query("graph_edges", f"""WITH l AS ({LABELLED_SQL}),
e AS (SELECT CAST(page_id AS VARCHAR) AS src, registered_domain AS dst, 'url_domain' AS edge_type FROM l
      UNION ALL SELECT DISTINCT registered_domain, tld, 'domain_tld' FROM l)
SELECT src, dst, edge_type FROM e UNION ALL SELECT dst, src, 'rev_' || edge_type FROM e""")
def graph_edges(spark, sf_dir):
    """URL->domain, distinct domain->suffix, and reverse edges."""
    return GR.graph_edges(labelled_urls(spark, sf_dir))


@query("graph_size", f"""SELECT CAST(count(*) AS BIGINT) AS url_nodes,
  CAST(count(DISTINCT registered_domain) AS BIGINT) AS domain_nodes, CAST(count(DISTINCT tld) AS BIGINT) AS tld_nodes,
  CAST(count(DISTINCT (registered_domain, tld)) AS BIGINT) AS domain_tld_edges, CAST(count(*) AS BIGINT) AS url_domain_edges
FROM ({LABELLED_SQL})""")
def graph_size(spark, sf_dir):
    """A10: node and edge counts."""
    return GR.graph_size(labelled_urls(spark, sf_dir))


@query("domain_profile", "SELECT registered_domain, CAST(count(*) AS BIGINT) AS dom_n, "
       + ", ".join(f"{_r6(f'avg({c})')} AS dom_{c}" for c in FEATURE_COLS)
       + f" FROM ({_LF_SQL}) GROUP BY registered_domain")
def domain_profile(spark, sf_dir):
    """Mean lexical profile per registered domain (all splits)."""
    p = GR.domain_profile(_lf(spark, sf_dir), FEATURE_COLS)
    return rounded(p.select("registered_domain", "dom_n", *[f"dom_{c}" for c in FEATURE_COLS]), 6)


_PROF_SQL = ("SELECT registered_domain, " + ", ".join(f"avg({c}) AS dom_{c}" for c in FEATURE_COLS)
             + f" FROM ({_LF_SQL}) GROUP BY registered_domain")


@query("global_profile", "SELECT " + ", ".join(f"{_r6(f'avg(dom_{c})')} AS glob_{c}" for c in FEATURE_COLS)
       + f" FROM ({_PROF_SQL}) WHERE registered_domain IN (SELECT registered_domain FROM ({LABELLED_SQL}) WHERE split = 'train')")
def global_profile(spark, sf_dir):
    """Unweighted mean of the profiles of domains seen in train."""
    lf = _lf(spark, sf_dir)
    p = GR.domain_profile(lf, FEATURE_COLS)
    return rounded(GR.global_profile(p, lf.filter(F.col("split") == "train"), FEATURE_COLS), 6)


_TP_SQL = ("SELECT tld, " + ", ".join(f"avg(dom_{c}) AS tld_{c}" for c in FEATURE_COLS)
           + f" FROM (SELECT DISTINCT registered_domain, tld FROM ({LABELLED_SQL})) e JOIN ({_PROF_SQL}) p USING (registered_domain) GROUP BY tld")
_SHOW = FEATURE_COLS


@query("neighbor_mean", "SELECT l.page_id, " + ", ".join(f"{_r6(f'p.dom_{c}')} AS dom_{c}" for c in _SHOW)
       + ", " + ", ".join(f"{_r6(f't.tld_{c}')} AS tld_{c}" for c in _SHOW)
       + f" FROM ({LABELLED_SQL}) l LEFT JOIN ({_PROF_SQL}) p USING (registered_domain) LEFT JOIN ({_TP_SQL}) t USING (tld)")
def neighbor_mean(spark, sf_dir):
    """G4 + G5: two mean-aggregation hops (URL <- domain <- {URLs, suffix})."""
    p = GR.propagate(_lf(spark, sf_dir), FEATURE_COLS, spread=F.xxhash64("url"))
    return rounded(p.select("page_id", *[f"dom_{c}" for c in _SHOW], *[f"tld_{c}" for c in _SHOW]), 6)


_CS_PROF = ("SELECT path_key, count(*) AS n, " + ", ".join(f"sum({c}) AS s_{c}, avg({c}) AS a_{c}" for c in _SHOW)
            + f" FROM ({_LF_SQL}) WHERE split = 'train' GROUP BY path_key")
_CS_GLOB = "SELECT " + ", ".join(f"avg(a_{c}) AS g_{c}" for c in _SHOW) + f" FROM ({_CS_PROF})"


@query("cold_start", "SELECT q.page_id, p.n IS NULL AS domain_unseen, " + ", ".join(
    _r6(f"CASE WHEN p.n IS NULL THEN g.g_{c} ELSE (p.s_{c} + q.{c}) / (p.n + 1) END") + f" AS cs_{c}" for c in _SHOW)
    + f" FROM ({_LF_SQL}) q LEFT JOIN ({_CS_PROF}) p USING (path_key) CROSS JOIN ({_CS_GLOB}) g WHERE q.split <> 'train'")
def cold_start(spark, sf_dir):
    """val/test URLs scored against the train graph: known keys fold the
    URL into their mean, unseen keys take the global profile."""
    lf = _lf(spark, sf_dir)
    train = lf.filter(F.col("split") == "train")
    prof = materialize(GR.domain_profile(train, _SHOW, domain="path_key"), "cold_profile")
    glob = GR.global_profile(prof, train, _SHOW, domain="path_key")
    q = lf.filter(F.col("split") != "train").select("page_id", "path_key", *_SHOW)
    cs = GR.cold_start(q, prof, glob, _SHOW, domain="path_key")
    return rounded(cs.select("page_id", "domain_unseen", *[f"cs_{c}" for c in _SHOW]), 6)


_GS_PROF = ("SELECT registered_domain, tld, split, " + ", ".join(FEATURE_COLS) + f" FROM ({_LF_SQL})")
_DOM_T = ("SELECT registered_domain, count(*) AS n, " + ", ".join(f"sum({c}) AS s_{c}, avg({c}) AS a_{c}" for c in FEATURE_COLS)
          + f" FROM ({_GS_PROF}) WHERE split = 'train' GROUP BY registered_domain")
_TLD_T = ("SELECT tld, " + ", ".join(f"avg(a_{c}) AS t_{c}" for c in FEATURE_COLS)
          + f" FROM (SELECT DISTINCT registered_domain, tld FROM ({_GS_PROF}) WHERE split = 'train') e JOIN ({_DOM_T}) d USING (registered_domain) GROUP BY tld")
_GLOB_T = "SELECT " + ", ".join(f"avg(a_{c}) AS g_{c}" for c in FEATURE_COLS) + f" FROM ({_DOM_T})"


@query("cold_start_serving", "SELECT q.page_id, d.n IS NULL AS domain_unseen, t.tld IS NULL AS suffix_unseen, " + ", ".join(
    _r6(f"CASE WHEN d.n IS NULL THEN g.g_{c} ELSE (d.s_{c} + q.{c}) / (d.n + 1) END") + f" AS dom_{c}" for c in FEATURE_COLS)
    + ", " + ", ".join(_r6(f"coalesce(t.t_{c}, g.g_{c})") + f" AS tld_{c}" for c in FEATURE_COLS)
    + f" FROM ({_LF_SQL}) q LEFT JOIN ({_DOM_T}) d USING (registered_domain) LEFT JOIN ({_TLD_T}) t ON q.tld = t.tld "
    f"CROSS JOIN ({_GLOB_T}) g WHERE q.split <> 'train'")
def cold_start_serving(spark, sf_dir):
    """G6 as served: registered domain and suffix of val/test URLs against the
    train graph; an unseen domain or suffix takes the global profile."""
    from ..operators.skew import skew_safe_left_join
    lf = _lf(spark, sf_dir)
    train = lf.filter(F.col("split") == "train")
    prof = materialize(GR.domain_profile(train, FEATURE_COLS), "cold_domains")
    glob = materialize(GR.global_profile(prof, train, FEATURE_COLS), "cold_global")
    tlds = GR.tld_profile(prof, train, FEATURE_COLS)
    q = lf.filter(F.col("split") != "train").select("page_id", "registered_domain", "tld", *FEATURE_COLS)
    cs = skew_safe_left_join(GR.cold_start(q, prof, glob, FEATURE_COLS), tlds, "tld", "tld_n", F.xxhash64("page_id"))
    cs = cs.crossJoin(F.broadcast(glob))  # one row
    return rounded(cs.select("page_id", "domain_unseen", F.col("tld_n").isNull().alias("suffix_unseen"),
                             *[F.col(f"cs_{c}").alias(f"dom_{c}") for c in FEATURE_COLS],
                             *[F.coalesce(f"tld_{c}", f"glob_{c}").alias(f"tld_{c}") for c in FEATURE_COLS]), 6)


# weights of an eight-output layer by a rule, for both engines
_OUT, _IN = 8, len(FEATURE_COLS)
_WL = [[((i * 7 + j * 3) % 11 - 5) / 1000 for j in range(_IN)] for i in range(_OUT)]
_WR = [[((i * 5 + j * 2) % 7 - 3) / 1000 for j in range(_IN)] for i in range(_OUT)]
_B = [(i % 3 - 1) / 10 for i in range(_OUT)]


def _layer_sql(i: int) -> str:
    terms = [f"CAST({_WL[i][j]!r} AS DOUBLE) * p.dom_{c} + CAST({_WR[i][j]!r} AS DOUBLE) * l.{c}" for j, c in enumerate(FEATURE_COLS)]
    return _r6(f"greatest({' + '.join(terms)} + CAST({_B[i]!r} AS DOUBLE), 0.0)") + f" AS h_{i}"


@query("graph_layer", "SELECT l.page_id, " + ", ".join(_layer_sql(i) for i in range(_OUT))
       + f" FROM ({_LF_SQL}) l JOIN ({_PROF_SQL}) p USING (registered_domain)")
def graph_layer(spark, sf_dir):
    """One layer relu(W_l * mean + b + W_r * x) over every URL, mean over its
    domain, weights from a one-row table."""
    from ..operators.skew import skew_safe_left_join
    lf = _lf(spark, sf_dir)
    prof = materialize(GR.domain_profile(lf, FEATURE_COLS), "layer_domains")
    prof = prof.select("registered_domain", "dom_n", F.array(*[f"dom_{c}" for c in FEATURE_COLS]).alias("mean"))
    weights = spark.createDataFrame([(_WL, _WR, _B)], "w_mean array<array<double>>, w_self array<array<double>>, bias array<double>")
    x = lf.select("page_id", "registered_domain", F.array(*FEATURE_COLS).alias("x"))
    j = skew_safe_left_join(x, prof, "registered_domain", "dom_n", F.xxhash64("page_id")).crossJoin(F.broadcast(weights))
    h = GR.linear_layer("mean", "x", "w_mean", "w_self", "bias")
    return rounded(j.select("page_id", h.alias("h")).select(
        "page_id", *[F.element_at("h", i + 1).alias(f"h_{i}") for i in range(_OUT)]), 6)


@query("two_hop", f"""WITH l AS ({LABELLED_SQL}), q AS (SELECT page_id, registered_domain FROM l WHERE split = 'test'),
d AS (SELECT DISTINCT registered_domain FROM q)
SELECT DISTINCT node_type, node FROM (
  SELECT 'url' AS node_type, CAST(page_id AS VARCHAR) AS node FROM q
  UNION ALL SELECT 'domain', registered_domain FROM d
  UNION ALL SELECT 'url', CAST(page_id AS VARCHAR) FROM l WHERE registered_domain IN (SELECT registered_domain FROM d)
  UNION ALL SELECT 'tld', tld FROM l WHERE registered_domain IN (SELECT registered_domain FROM d))""")
def two_hop(spark, sf_dir):
    """Nodes within two hops of the test URLs."""
    u = labelled_urls(spark, sf_dir)
    return GR.two_hop_nodes(u, u.filter(F.col("split") == "test"))


@query("graph_nodes", f"""WITH l AS (SELECT *, CAST(target <> 0 AS DOUBLE) AS rk FROM ({LABELLED_SQL})),
n AS (SELECT 'url' AS node_type, url AS node, CAST(1 AS BIGINT) AS degree, rk AS mean_risk FROM l
      UNION ALL SELECT 'domain', registered_domain, count(*) + 1, avg(rk) FROM l GROUP BY registered_domain
      UNION ALL SELECT 'tld', tld, count(DISTINCT registered_domain), avg(rk) FROM l GROUP BY tld)
SELECT node_type, node, CAST(degree AS BIGINT) AS degree, round(mean_risk, 9) + 0.0 AS mean_risk,
       round(round({S.entropy('node')}, 3), 9) + 0.0 AS entropy FROM n""")
def graph_nodes(spark, sf_dir):
    """Node attributes (entropy, degree, mean risk) for neighbourhood views."""
    u = labelled_urls(spark, sf_dir)
    return rounded(GR.graph_nodes(u, F.col("target") != 0))


def _ngram_sql(buckets: int) -> str:
    w = lambda i: f"CAST(('0x' || substr(md5(gram), {8 * i + 1}, 8))::BIGINT AS BIGINT)"
    m = "0"
    for i in range(4):
        m = f"(({m}) * 4294967296 + {w(i)}) % {buckets}"
    return f"""WITH k AS (SELECT DISTINCT host AS key, regexp_replace(host, '^\\.+|\\.+$', '', 'g') AS s FROM ({LABELLED_SQL})),
g2 AS (SELECT key, substr(s, i, 2) AS gram FROM k, range(1, (SELECT max(length(s)) + 1 FROM k)) t(i) WHERE i <= length(s) - 1),
g3 AS (SELECT key, substr(s, i, 3) AS gram FROM k, range(1, (SELECT max(length(s)) + 1 FROM k)) t(i) WHERE i <= length(s) - 2),
g1 AS (SELECT key, substr(s, i, 1) AS gram FROM k, range(1, (SELECT max(length(s)) + 1 FROM k)) t(i) WHERE i <= length(s) AND length(s) < 2),
g AS (SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g1),
c AS (SELECT key, CAST({m} AS INTEGER) AS bucket, count(*) AS c FROM g GROUP BY ALL)
SELECT key, bucket, round(c / sum(c) OVER (PARTITION BY key), 9) + 0.0 AS weight FROM c"""


@query("tld_ngram_hash", _ngram_sql(64))
def tld_ngram_hash(spark, sf_dir):
    """U4: L1-normalised 2/3-gram hash histogram (64 buckets) of each host."""
    u = labelled_urls(spark, sf_dir).select("host").distinct()
    return rounded(GR.ngram_hash(u, "host", 64))


def _embeddings(spark, sf_dir):
    from ..sources.tables import read_table
    return read_table(spark, sf_dir, "embeddings")


@query("embedding_neighbor_mean", """SELECT label AS dst, CAST(pos - 1 AS INTEGER) AS pos,
  round(avg(CAST(v AS DOUBLE)), 6) + 0.0 AS mean, CAST(count(*) AS BIGINT) AS n
FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
GROUP BY label, pos""")
def embedding_neighbor_mean(spark, sf_dir):
    """G4 on vector features: element-wise mean embedding of each label node
    over its member vectors (vec -> label edges)."""
    m = GR.mean_vectors(_embeddings(spark, sf_dir), "label", "embedding")
    return rounded(m.select(F.col("label").alias("dst"), F.posexplode("mean").alias("pos", "mean"), "n"), 6)


@query("embedding_hop_back", """WITH m AS (SELECT label, list(mean ORDER BY pos) AS centre FROM (
    SELECT label, pos, avg(CAST(v AS DOUBLE)) AS mean FROM (
      SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY label, pos) GROUP BY label)
SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), m.centre), 6) + 0.0 AS cos_to_centre
FROM embeddings e JOIN m ON e.label = m.label""")
def embedding_hop_back(spark, sf_dir):
    """G5 on vectors: second hop back to each vector, its cosine similarity to
    the mean of its label node."""
    from ..operators.skew import skew_safe_left_join
    emb = _embeddings(spark, sf_dir)
    centres = GR.mean_vectors(emb, "label", "embedding", out="centre").select("label", "centre")
    j = skew_safe_left_join(emb, centres, "label", None, F.xxhash64("vec_id")).filter(F.col("centre").isNotNull())
    return rounded(j.select("vec_id", "label", GR.cosine(F.col("embedding").cast("array<double>"),
                                                         "centre").alias("cos_to_centre")), 6)
