"""Queries over the typed graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FEATURE_COLS
from ..operators import graph as GR
from ..operators import typed_graph as T
from ..plans.prepare import labelled_urls
from ..session import materialize
from . import query, rounded
from .graph_q import _LF_SQL, _PROF_SQL, _lf, _ngram_sql
from .reputation_q import LABELLED_SQL

# weights of a four-output layer an edge type, by a rule that SQL can state too
OUT, SUFFIX = 4, 16
WIDTH = {"url": len(FEATURE_COLS), "domain": len(FEATURE_COLS), "tld": SUFFIX}
TYPES = [("url_domain", "url", "domain"), ("domain_tld", "domain", "tld"), ("rev_url_domain", "domain", "url"), ("rev_domain_tld", "tld", "domain")]


def _weights(spark):
    rows = []
    for e, (name, src, dst) in enumerate(TYPES):
        rows.append((name, dst, [[((e * 13 + o * 7 + j * 3) % 11 - 5) / 1000 for j in range(WIDTH[src])] for o in range(OUT)],
                     [[((e * 5 + o * 5 + j * 2) % 7 - 3) / 1000 for j in range(WIDTH[dst])] for o in range(OUT)],
                     [((e + o) % 3 - 1) / 10 for o in range(OUT)]))
    return spark.createDataFrame(rows, "edge_type string, dst_type string, w_mean array<array<double>>, w_self array<array<double>>, bias array<double>")


def _nodes(spark, sf_dir):
    """URLs with their features, domains with their mean features, suffixes with their n-gram vector."""
    lf = _lf(spark, sf_dir)
    prof = GR.domain_profile(lf, FEATURE_COLS).filter("registered_domain IS NOT NULL")
    tlds = lf.select("tld").filter("tld IS NOT NULL").distinct()
    part = lambda df, kind, key, x: df.select(F.lit(kind).alias("node_type"), F.col(key).cast("string").alias("node"), x.alias("x"))
    nodes = part(lf, "url", "page_id", F.array(*FEATURE_COLS)).unionByName(
        part(prof, "domain", "registered_domain", F.array(*[f"dom_{c}" for c in FEATURE_COLS]))).unionByName(
        part(tlds, "tld", "tld", GR.ngram_hash_vector("tld", SUFFIX)))
    return materialize(nodes, "typed_nodes")


def _unpivot(src: str, kind: str, key: str, prefix: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS node_type, CAST({key} AS VARCHAR) AS node, {j} AS pos, {prefix}{c} AS v FROM {src}"
                              for j, c in enumerate(FEATURE_COLS))


_EDGES_SQL = f"""l AS ({LABELLED_SQL}),
e0 AS (SELECT 'url_domain' AS et, 'url' AS st, CAST(page_id AS VARCHAR) AS s, 'domain' AS dt, registered_domain AS d FROM l
       UNION ALL SELECT DISTINCT 'domain_tld', 'domain', registered_domain, 'tld', tld FROM l),
e AS (SELECT * FROM e0 UNION ALL SELECT 'rev_' || et, dt, d, st, s FROM e0)"""

_TYPED_SQL = f"""WITH {_EDGES_SQL}, lf AS ({_LF_SQL}), pr AS ({_PROF_SQL}),
ng AS ({_ngram_sql(SUFFIX).replace('SELECT DISTINCT host AS key, regexp_replace(host,', 'SELECT DISTINCT tld AS key, regexp_replace(tld,')}),
n AS ({_unpivot('lf', 'url', 'page_id')} UNION ALL {_unpivot('pr', 'domain', 'registered_domain', 'dom_')}
      UNION ALL SELECT 'tld', key, bucket, weight FROM ng),
a AS (SELECT DISTINCT node_type, node FROM n UNION SELECT 'tld', tld FROM l),
ty(ei, et, dt) AS (VALUES {', '.join(f"({i}, '{n}', '{d}')" for i, (n, _, d) in enumerate(TYPES))}),
c AS (SELECT et, dt, d, count(*) AS k FROM e GROUP BY ALL),
m AS (SELECT e.et, e.dt, e.d, n.pos, sum(n.v) AS v FROM e JOIN n ON n.node_type = e.st AND n.node = e.s GROUP BY ALL),
mm AS (SELECT m.et, m.dt, m.d, ty.ei, o, sum(((ty.ei * 13 + o * 7 + pos * 3) % 11 - 5) / 1000.0::DOUBLE * v / c.k) AS y
       FROM m JOIN c USING (et, dt, d) JOIN ty USING (et, dt), range({OUT}) r(o) GROUP BY ALL),
ss AS (SELECT n.node_type, n.node, ty.ei, o, sum(((ty.ei * 5 + o * 5 + pos * 2) % 7 - 3) / 1000.0::DOUBLE * v) AS y
       FROM n JOIN ty ON ty.dt = n.node_type, range({OUT}) r(o) GROUP BY ALL),
cv AS (SELECT a.node_type, a.node, r.o, coalesce(mm.y, 0) + coalesce(ss.y, 0) + ((ty.ei + r.o) % 3 - 1) / 10.0::DOUBLE AS y
       FROM a JOIN ty ON ty.dt = a.node_type CROSS JOIN range({OUT}) r(o)
       LEFT JOIN mm ON mm.ei = ty.ei AND mm.d = a.node AND mm.o = r.o
       LEFT JOIN ss ON ss.ei = ty.ei AND ss.node_type = a.node_type AND ss.node = a.node AND ss.o = r.o),
z AS (SELECT node_type, node, o, greatest(avg(y), 0.0) AS y FROM cv GROUP BY ALL)
SELECT node_type, node, {', '.join(f'round(max(y) FILTER (o = {i}), 6) + 0.0 AS h_{i}' for i in range(OUT))} FROM z GROUP BY node_type, node"""


@query("graph_layer_typed", _TYPED_SQL)
def graph_layer_typed(spark, sf_dir):
    """One round over all four edge types for every URL, domain and suffix node."""
    h = T.typed_layer(_nodes(spark, sf_dir), T.typed_edges(labelled_urls(spark, sf_dir)), _weights(spark))
    return rounded(h.select("node_type", "node", *[F.get("x", F.lit(i)).alias(f"h_{i}") for i in range(OUT)]), 6)


@query("neighbourhood", f"""WITH RECURSIVE {_EDGES_SQL},
r AS (SELECT 'url' AS t, CAST(page_id AS VARCHAR) AS n, 0 AS k FROM l WHERE split = 'test'
      UNION SELECT e.dt, e.d, r.k + 1 FROM r JOIN e ON e.st = r.t AND e.s = r.n WHERE r.k < 3)
SELECT t || ':' || n AS node, CAST(min(k) AS INTEGER) AS distance FROM r GROUP BY t, n""")
def neighbourhood(spark, sf_dir):
    """Every node within three edges of the test URLs, with its distance."""
    u = labelled_urls(spark, sf_dir)
    seeds = u.filter("split = 'test'").select(T.node_key("url", F.col("page_id")).alias("node"))
    return T.neighbourhood(T.typed_edges(u), seeds, depth=3)
