"""One registered query per operator, over the whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, merkle, mixing, pii, token_files, toxicity, whitening
from .common import WORD, documents
from .exact_dedup import mark_copies
from .language_id import held_out, identify
from .near_dedup import near_components
from .packing import pack
from .repeated_spans import repeated_spans

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _pii_sql() -> str:
    """Offsets from the pieces between matches, validators in list functions; no Spark semantics used."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = (f"list_sum([CASE WHEN (i % 2) = 0 THEN (CASE WHEN 2*x > 9 THEN 2*x-9 ELSE 2*x END) ELSE x END "
            f"for x, i in [CAST(c AS INT) for c in string_split(reverse({digits}), '')]]) % 10 = 0")
    turned = "replace(v, ' ', '')[5:] || replace(v, ' ', '')[1:4]"
    mod97 = ("list_reduce(list_prepend(0::BIGINT, [(CASE WHEN ascii(c) <= 57 THEN ascii(c)-48 ELSE ascii(c)-55 END)::BIGINT "
             f"for c in string_split({turned}, '')]), lambda a, b: (CASE WHEN b < 10 THEN a*10+b ELSE a*100+b END) % 97) = 1")
    valid = {
        "email": "true",
        "ip": f"regexp_matches(v, '{pii.IP_VALID}')",
        "card": f"(CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {luhn} ELSE false END)",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"(length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND {mod97})",
        "ssn": f"NOT regexp_matches(v, '{pii.SSN_NEVER}')",
    }
    parts = []
    for n, k in enumerate(pii.KINDS):
        keep = valid[k.name]
        if not k.base:
            near = f"lower(right(before, {pii.NEAR}) || ' ' || left(after, {pii.NEAR}))"
            score = (f"round({k.score} + CASE WHEN regexp_matches({near}, '{k.context}') THEN {pii.RAISE} ELSE 0 END"
                     f" - CASE WHEN regexp_matches(right(before,1) || left(after,1), '{k.joined}') THEN {pii.LOWER_BY} ELSE 0 END, 3)")
            keep += f" AND {score} >= {pii.THRESHOLD}"
        parts.append(f"""
SELECT doc_id, {n} AS ord, '{k.name}' AS kind, {str(k.base).lower()} AS base, s, s + length(v) AS e FROM (
  SELECT doc_id, m[i] AS v, p[i] AS before, p[i+1] AS after,
         list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i-1]]), 0) AS s
  FROM (SELECT doc_id, m, p, unnest(range(1, len(m)+1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{k.plain}') AS m, string_split_regex(t, '{k.plain}') AS p FROM d)))
WHERE {keep}""")
    text = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS)
    names = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
sp AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY ord, s) FILTER (base) AS b,
      string_agg({text}, ',' ORDER BY ord, s) AS al FROM sp GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(b, '')) AS base_sha256, coalesce(al, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id"""


@query("op1_pii", _pii_sql())
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pii.find_pii(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [F.size(f"pii.{k.name}").cast("long").alias(f"n_{k.name}") for k in pii.KINDS]
    base = F.concat(*[F.col(f"pii.{k.name}") for k in pii.KINDS if k.base])
    spans = F.concat(*[F.col(f"pii.{k.name}") for k in pii.KINDS])
    return t.select("doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"),
                    pii.digest(spans).alias("spans"))


@query("op2_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
WINDOW g AS (PARTITION BY n)""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir).select("doc_id", "text"), keep="largest", columns=["doc_id"])


def _mixing_sql() -> str:
    """Word positions by a window; the tree one source a step; permutation one round a step."""
    rounds = ", ".join(f"({i}, {k}, {a}, {c})" for i, (k, a, c) in enumerate(mixing.round_keys()))

    def choose(n, k):
        return f"(lgamma(greatest({n}, 0) + 1) - lgamma(greatest({k}, 0) + 1) - lgamma(greatest({n} - ({k}), 0) + 1))"
    weight = f"exp({choose('g', 'k')} + {choose('(n - g)', '(d - k)')} - {choose('n', 'd')})"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn FROM s),
w AS (SELECT *, [5, 2, 1][(rn % 3 + 1)::INT] AS weight, 3 * sz AS ceiling FROM r),
f AS (SELECT *, ceiling / weight AS full_at FROM w),
l AS (SELECT *, ((SELECT sum(sz) FROM s) - coalesce(sum(ceiling) OVER (ORDER BY full_at, rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(weight) OVER (ORDER BY full_at, rn
         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
o AS (SELECT *, (SELECT level FROM l WHERE full_at >= level ORDER BY full_at, rn LIMIT 1) AS share FROM l),
t AS (SELECT source, sz, rn, CASE WHEN share IS NULL OR full_at < share THEN ceiling::DOUBLE ELSE share * weight END AS target
      FROM o),
b AS (SELECT *, round(target)::BIGINT AS take, ceil(round(target) / {mixing.BLOCK_WORDS})::BIGINT AS blocks,
             ('0x' || substr(md5(coalesce('mix-1:key:' || source, 'mix-1:null')), 1, 7))::BIGINT AS key FROM t),
q AS (SELECT list(blocks ORDER BY rn) AS quotas FROM b),
tree AS (SELECT 0 AS level, 0 AS node, quotas, 1 AS i, list_sum(quotas)::BIGINT AS n,
                ((list_sum(quotas) + 1) // 2)::BIGINT AS d, []::BIGINT[] AS l FROM q
  UNION ALL
  SELECT level + (i > len(quotas))::INT, CASE WHEN i > len(quotas) THEN node * 2 + side ELSE node END,
         CASE WHEN i > len(quotas) THEN half ELSE quotas END, CASE WHEN i > len(quotas) THEN 1 ELSE i + 1 END,
         CASE WHEN i > len(quotas) THEN list_sum(half)::BIGINT ELSE n - g END,
         CASE WHEN i > len(quotas) THEN ((list_sum(half) + 1) // 2)::BIGINT ELSE d - x END,
         CASE WHEN i > len(quotas) THEN [] ELSE list_append(l, x) END
  FROM (SELECT *, CASE WHEN n <= 0 OR d <= 0 OR g <= 0 THEN 0 WHEN d >= n THEN g WHEN g >= n THEN d
                       ELSE least(hi, lo + len(list_filter(range(1, hi - lo + 2), lambda j: list_sum(list_transform(
                         range(lo, lo + j), lambda k: {weight})) < u))) END AS x,
               CASE WHEN side = 0 THEN l ELSE list_transform(l, lambda v, j: quotas[j] - v) END AS half
        FROM (SELECT *, coalesce(quotas[i], 0) AS g, greatest(0, d - (n - coalesce(quotas[i], 0))) AS lo,
                     least(coalesce(quotas[i], 0), d) AS hi,
                     (('0x' || substr(md5('mix-1:' || level || ':' || node || ':' || (i - 1)), 1, 13))::BIGINT + 0.5::DOUBLE)
                       / {1 << 52}::DOUBLE AS u
              FROM tree, (SELECT unnest([0, 1]) AS side) WHERE level < {mixing.LEVELS}))
  WHERE i > len(quotas) OR side = 0),
leaf AS (SELECT node, unnest(quotas) AS quota, generate_subscripts(quotas, 1) - 1 AS rn
         FROM tree WHERE level = {mixing.LEVELS} AND i = 1),
upto AS (SELECT rn, node, sum(quota) OVER (PARTITION BY rn ORDER BY node) AS upper FROM leaf),
rounds(step, k, a, c) AS (VALUES {rounds}),
perm AS (SELECT rn, unnest(range(blocks)) AS block, blocks, key, unnest(range(blocks)) AS x, 0 AS step FROM b
  UNION ALL
  SELECT rn, block, blocks, key, CASE WHEN (greatest(x, y) * a + c + key) % {mixing.PRIME} * 2 > {mixing.PRIME} THEN y ELSE x END,
         step + 1
  FROM (SELECT p.*, a, c, ((k + key - x) % blocks + blocks) % blocks AS y FROM perm p JOIN rounds USING (step))),
dealt AS (SELECT p.rn, block, count(*) FILTER (upper <= x) AS shard FROM perm p JOIN upto u ON p.rn = u.rn
          WHERE step = {mixing.ROUNDS} GROUP BY p.rn, block),
p AS (SELECT d.*, b.sz, b.rn, b.target, b.take,
             sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
             row_number() OVER () AS line
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT line, rn, copy, copy * sz + start AS at, least(size, greatest(take - copy * sz - start, 0))::BIGINT AS words
      FROM p, (SELECT unnest(range({mixing.LIMIT + 1})) AS copy)),
a AS (SELECT line, sum(words) AS taken, string_agg(copy || ':' || shard || ':' || words, ',' ORDER BY copy) AS draws
      FROM c JOIN dealt ON c.rn = dealt.rn AND c.at // {mixing.BLOCK_WORDS} = dealt.block WHERE words > 0 GROUP BY line)
SELECT doc_id, size::BIGINT AS size, sz AS source_size, target, coalesce(taken, 0)::BIGINT AS taken,
       coalesce(draws, '') AS draws FROM p LEFT JOIN a ON p.line = a.line"""


@query("op7_mixing", _mixing_sql())
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``draws`` tells the shard of each reading: copy:shard:words, joined by commas."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    told = F.transform("draws", lambda p: F.concat_ws(":", p["copy"], p["shard"], p["words"]))
    return mixing.mix(docs, columns=["doc_id"]).withColumn("draws", F.array_join(told, ","))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))


@query("op9_minhash_near_dedup", rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
       ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END)) AS sh FROM d),
c AS (SELECT sh, len(sh) AS n, min(doc_id) AS rep FROM s GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep
       AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS a, rep AS b FROM c WHERE n > 0 UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(k.least, s.doc_id) AS component_id,
       s.doc_id = coalesce(k.least, s.doc_id) AS kept
FROM s JOIN c ON s.sh = c.sh LEFT JOIN k ON len(s.sh) > 0 AND k.a = c.rep""")
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir).select("doc_id", "text")).drop("key")


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs, columns=["doc_id"]).withColumn("held_out", held_out("doc_id"))


@query("op8_ann", """
WITH v AS (SELECT vec_id, row_number() OVER () AS line, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
           AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
           AND len([x for x in embedding if x <> 0]) > 0),
p AS (SELECT q.line, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.line <> c.line),
r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    t = toxicity.score(docs, toxicity.learn(docs, labels), columns=["doc_id"])
    return t.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_files.token_index(token_files.write_token_files(docs))


@query("op3_suffix_array_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS x
      FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 199, 0))) AS p FROM d)),
r AS (SELECT doc_id, p FROM w WHERE x IN (SELECT x FROM w GROUP BY x HAVING count(*) > 1)),
g AS (SELECT *, CASE WHEN p <= lag(p) OVER o + 200 THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, run),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb
      FROM s GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN aa IS NULL THEN h ELSE array_to_string(
         [substr(h, 2 * f + 1, 2 * ((aa || [len(h) // 2])[i] - f)) for f, i in [0] || bb], '') END)) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id""")
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return repeated_spans(docs, columns=["doc_id"]).drop("spans")


def _merkle_sql() -> str:
    """Levels by recursion, siblings by a self-join, CRC-32 bit by bit, proofs folded along a list."""
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    plain = [field(c) for c in merkle.FIELDS]
    cut = [field("replace(text, chr(10), '')") if c == "text" else field(c) for c in merkle.FIELDS]
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] "
           "for c in string_split(doc_id::VARCHAR, '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) "
           "WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)")

    def levels(name, base):
        return f"""{name}(tree, level, pos, n, h) AS (SELECT tree, 0, pos, n, h FROM {base} UNION ALL
  SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1
  GROUP BY tree, level, pos // 3, n)"""

    def beside(name, lv):
        return f"""{name} AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|'
  || coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS s FROM {lv} a JOIN {lv} b
  ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos)"""
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
  sha256({' || '.join(plain)}) AS h,
  CASE WHEN {crc} & 1 = 1 AND text IS NOT NULL THEN sha256({' || '.join(cut)}) END AS changed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS pos,
      count(*) OVER (PARTITION BY tree) AS n FROM d),
{levels('lv', 'l')},
t AS (SELECT '' AS tree, tree AS src, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
{levels('tv', 't')},
{beside('ls', 'lv')},
{beside('ts', 'tv')},
p AS (SELECT l.rid, 0 AS part, ls.level, ls.s FROM l JOIN ls ON l.tree = ls.tree AND l.pos // (3 ** ls.level)::BIGINT = ls.pos
      UNION ALL SELECT l.rid, 1, ts.level, ts.s FROM l JOIN t ON l.tree = t.src JOIN ts ON t.pos // (3 ** ts.level)::BIGINT = ts.pos),
q AS (SELECT rid, list(s ORDER BY part, level) AS path FROM p GROUP BY rid),
r AS (SELECT l.*, t.h AS subroot, (SELECT h FROM tv WHERE n = 1) AS root, coalesce(path, []) AS path
      FROM l JOIN t ON l.tree = t.src LEFT JOIN q ON l.rid = q.rid),
f AS (SELECT *, list_reduce(list_prepend(coalesce(changed, h), path),
      lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded FROM r)
SELECT doc_id, h AS leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
       folded AS folded_root, folded = root AS verified FROM f"""


@query("op11_merkle_manifest", _merkle_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))


@query("op12_bpe_reuse")
def op12_bpe_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), columns=["doc_id"], decoded="decoded")
    return t.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.by_component(whitening.whiten(vectors, columns=["vec_id"]))
