"""URL -> domain -> suffix graph as edge and node DataFrames.

No graph library is needed: the graph has fixed depth, so neighbourhood
means are joins plus grouped averages.  Nodes keep their string keys (no
driver-side id dictionaries); feature vectors are plain columns so every
mean is a built-in ``avg`` with partial aggregation before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import shannon_entropy


def url_domain_edges(df: DataFrame, url_key: str = "page_id", domain: str = "registered_domain") -> DataFrame:
    """G1: one edge per URL row."""
    return df.select(F.col(url_key).cast("string").alias("src"), F.col(domain).alias("dst"),
                     F.lit("url_domain").alias("edge_type"))


def domain_tld_edges(df: DataFrame, domain: str = "registered_domain", tld: str = "tld") -> DataFrame:
    """Distinct domain -> suffix edges (partial + final hash aggregate)."""
    return df.select(F.col(domain).alias("src"), F.col(tld).alias("dst")).distinct().withColumn(
        "edge_type", F.lit("domain_tld"))


def with_reverse(edges: DataFrame) -> DataFrame:
    """Add reverse edges (type prefixed ``rev_``)."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                       F.concat(F.lit("rev_"), F.col("edge_type")).alias("edge_type"))
    return edges.unionByName(rev)


def graph_edges(df: DataFrame, url_key: str = "page_id") -> DataFrame:
    return with_reverse(url_domain_edges(df, url_key).unionByName(domain_tld_edges(df)))


def graph_size(df: DataFrame, url_key: str = "page_id") -> DataFrame:
    """A10: node and edge counts, rolled up from one (domain, suffix) aggregate."""
    from ..session import materialize
    pairs = materialize(df.groupBy("registered_domain", "tld").agg(F.count(F.lit(1)).alias("n")), "graph_pairs")
    full = F.col("registered_domain").isNotNull() & F.col("tld").isNotNull()
    one = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("url_nodes"),
                    F.count(F.when(full, 1)).alias("domain_tld_edges"))
    doms = pairs.select("registered_domain").distinct().agg(F.count("registered_domain").alias("domain_nodes"))
    tlds = pairs.select("tld").distinct().agg(F.count("tld").alias("tld_nodes"))
    # three one-row frames
    return one.crossJoin(F.broadcast(doms)).crossJoin(F.broadcast(tlds)).select(
        "url_nodes", "domain_nodes", "tld_nodes", "domain_tld_edges", F.col("url_nodes").alias("url_domain_edges"))


def neighbor_mean(nodes: DataFrame, edges: DataFrame, key: str, feature_cols,
                  prefix: str = "nbr", src: str = "src", dst: str = "dst") -> DataFrame:
    """Element-wise mean of the source nodes' features per destination.

    ``nodes`` holds ``key`` plus feature columns; the result holds ``dst``,
    ``{prefix}_n`` and ``{prefix}_sum_<c>`` / ``{prefix}_<c>`` per feature
    (sums are kept so a new neighbour can be folded in later: G6).
    """
    j = edges.select(src, dst).join(nodes.withColumnRenamed(key, src), src)
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_n")]
    aggs += [F.sum(c).alias(f"{prefix}_sum_{c}") for c in feature_cols]
    aggs += [F.avg(c).alias(f"{prefix}_{c}") for c in feature_cols]
    return j.groupBy(dst).agg(*aggs)


def domain_profile(df: DataFrame, feature_cols, domain: str = "registered_domain") -> DataFrame:
    """Mean feature vector per domain over all rows, with sums and count.
    One grouped aggregate: partial sums are combined map-side, so a domain
    with a third of all rows costs one partial row per task."""
    aggs = [F.count(F.lit(1)).alias("dom_n")]
    aggs += [F.sum(F.col(c).cast("double")).alias(f"dom_sum_{c}") for c in feature_cols]
    aggs += [F.avg(F.col(c).cast("double")).alias(f"dom_{c}") for c in feature_cols]
    return df.groupBy(domain).agg(*aggs)


def global_profile(profile: DataFrame, train: DataFrame, feature_cols,
                   domain: str = "registered_domain") -> DataFrame:
    """Unweighted mean of domain profiles over domains seen in train."""
    seen = profile.join(train.select(domain).distinct(), domain, "left_semi")
    return seen.agg(*[F.avg(f"dom_{c}").alias(f"glob_{c}") for c in feature_cols])


def tld_profile(profile: DataFrame, df: DataFrame, feature_cols,
                domain: str = "registered_domain", tld: str = "tld") -> DataFrame:
    """Mean of the domain profiles attached to each suffix (hop through the
    suffix node); at most one row per public suffix."""
    d2t = domain_tld_edges(df, domain, tld)
    nodes = profile.select(domain, *[F.col(f"dom_{c}").alias(c) for c in feature_cols])
    m = neighbor_mean(nodes, d2t, domain, feature_cols, prefix="tld")
    return m.withColumnRenamed("dst", tld).select(tld, "tld_n", *[f"tld_{c}" for c in feature_cols])


def propagate(df: DataFrame, feature_cols, domain: str = "registered_domain", tld: str = "tld",
              spread: Column | None = None, profile: DataFrame | None = None,
              suffix_profile: DataFrame | None = None) -> DataFrame:
    """Per URL ``[x, mean over its domain, mean over its suffix]``.

    Closed form of two mean-aggregation hops on the URL-domain-suffix graph
    from pre-aggregates; the domain and the suffix lookup are skew-safe (a
    wildcard rule makes any label a suffix, so the suffix table has no bound).
    """
    from ..session import materialize
    from .skew import hot_keys_of, skew_safe_left_join
    # the profile is read three times (suffix means, hot keys, lookup): write it once
    prof = profile if profile is not None else materialize(domain_profile(df, feature_cols, domain),
                                                           "domain_profile")
    tp = suffix_profile if suffix_profile is not None else tld_profile(prof, df, feature_cols, domain, tld)
    keep = prof.select(domain, "dom_n", *[f"dom_{c}" for c in feature_cols])
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in df.columns])
    hot = hot_keys_of(df, [domain, tld])
    out = skew_safe_left_join(df, keep, domain, "dom_n", spread, hot=hot[domain])
    return skew_safe_left_join(out, tp, tld, "tld_n", F.xxhash64(spread), hot=hot[tld])


def cold_start(query: DataFrame, profile: DataFrame, glob: DataFrame, feature_cols,
               domain: str = "registered_domain", spread: Column | None = None,
               hot: DataFrame | None = None) -> DataFrame:
    """Domain-side mean for URLs scored against a fixed graph.

    A known domain folds the query URL in as one more neighbour,
    ``(sum + x) / (n + 1)``; an unknown domain takes the global profile.
    Each URL is scored against base graph + itself, so the result does not
    depend on which other URLs share the batch.
    """
    from .skew import skew_safe_left_join
    p = profile.select(domain, "dom_n", *[f"dom_sum_{c}" for c in feature_cols])
    spread = spread if spread is not None else F.xxhash64(*[F.col(c) for c in query.columns])
    # a popular domain in the query batch must not land on one reducer
    j = skew_safe_left_join(query, p, domain, "dom_n", spread, hot=hot).crossJoin(F.broadcast(glob))  # one row
    cols = [F.col(c) for c in query.columns] + [F.col("dom_n").isNull().alias("domain_unseen")]
    for c in feature_cols:
        cols.append(F.when(F.col("dom_n").isNull(), F.col(f"glob_{c}"))
                    .otherwise((F.col(f"dom_sum_{c}") + F.col(c)) / (F.col("dom_n") + 1))
                    .alias(f"cs_{c}"))
    return j.select(*cols)


def two_hop_nodes(graph: DataFrame, query: DataFrame, url_key: str = "page_id",
                  domain: str = "registered_domain", tld: str = "tld") -> DataFrame:
    """Distinct nodes within two hops of the query URLs.

    hop 1: the query URLs' domains; hop 2: every URL of those domains and
    their suffixes.  One skew-safe semi join; no per-domain loops.
    """
    from .skew import skew_safe_semi_join
    q = query.select(url_key, domain).distinct()
    doms = q.select(domain).distinct()
    near = skew_safe_semi_join(graph.select(url_key, domain, tld), doms, domain, F.xxhash64(url_key))
    urls2 = near.select(url_key)
    tlds = near.select(tld).distinct()
    return (q.select(F.lit("url").alias("node_type"), F.col(url_key).cast("string").alias("node"))
            .unionByName(doms.select(F.lit("domain").alias("node_type"), F.col(domain).alias("node")))
            .unionByName(urls2.select(F.lit("url").alias("node_type"), F.col(url_key).cast("string").alias("node")))
            .unionByName(tlds.select(F.lit("tld").alias("node_type"), F.col(tld).alias("node")))
            .distinct())


def graph_nodes(df: DataFrame, risk: Column, url_key: str = "page_id", url: str = "url",
                domain: str = "registered_domain", tld: str = "tld") -> DataFrame:
    """Node table ``(node_type, node, entropy, degree, mean_risk)``.

    URL degree is 1 (its domain); a domain's degree counts its URLs plus its
    suffix; a suffix's degree counts its domains.  Risk of a URL is ``risk``;
    of a domain / suffix the mean over its URLs.
    """
    r = df.select(url_key, url, domain, tld, risk.cast("double").alias("_risk"))
    urls = r.select(F.lit("url").alias("node_type"), F.col(url).alias("node"),
                    F.lit(1).cast("long").alias("degree"), F.col("_risk").alias("mean_risk"))
    doms = r.groupBy(domain).agg((F.count(F.lit(1)) + 1).alias("degree"), F.avg("_risk").alias("mean_risk")) \
        .select(F.lit("domain").alias("node_type"), F.col(domain).alias("node"), "degree", "mean_risk")
    tl = r.groupBy(tld).agg(F.countDistinct(domain).alias("degree"), F.avg("_risk").alias("mean_risk")) \
        .select(F.lit("tld").alias("node_type"), F.col(tld).alias("node"), "degree", "mean_risk")
    allnodes = urls.unionByName(doms).unionByName(tl)
    return allnodes.withColumn("entropy", F.round(shannon_entropy(F.col("node")), 3))


def ngram_hash(df: DataFrame, col: str, buckets: int, sizes=(2, 3), key: str | None = None) -> DataFrame:
    """U4: character n-gram hashing of a string into ``buckets`` bins,
    L1-normalised, long form ``(key, bucket, weight)``.

    Outer dots are stripped; single characters are used when no n-gram of
    the given sizes exists; an empty string yields no rows (zero vector).
    md5 mod ``buckets`` is evaluated by Horner's rule over four 32-bit words
    (the 128-bit value does not fit a decimal).
    """
    key = key or col
    s = F.regexp_replace(F.col(col), r"^\.+|\.+$", "")
    n = F.length(s)

    def grams(k):
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, k))) \
            .otherwise(F.array().cast("array<string>"))
    all_g = F.concat(*[grams(k) for k in sizes])
    singles = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, 1))) \
        .otherwise(F.array().cast("array<string>"))
    g = F.when(F.size(all_g) > 0, all_g).otherwise(singles)
    e = df.select(F.col(key).alias("key"), F.explode(g).alias("gram"))
    h = F.md5(F.col("gram"))
    m = F.lit(0).cast("long")
    for w in range(4):
        word = F.conv(F.substring(h, 8 * w + 1, 8), 16, 10).cast("long")
        m = F.pmod(m * F.lit(1 << 32) + word, F.lit(buckets))
    e = e.withColumn("bucket", m.cast("int"))
    c = e.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("_c"))
    from pyspark.sql import Window
    tot = F.sum("_c").over(Window.partitionBy("key"))
    return c.select("key", "bucket", (F.col("_c") / tot).alias("weight"))


def dense_index(df: DataFrame, order_cols, out_col: str = "node_id", partitions: int | None = None) -> DataFrame:
    """Dense 0-based ids in the total order ``order_cols`` without a
    single-task sort: rows are range-partitioned by the order, a per-partition
    count table (one row per partition) gives each partition's offset, and
    ids are ranks inside a partition plus its offset.  ``order_cols`` must
    make the order total (end with a unique key)."""
    from pyspark.sql import Window
    from ..session import materialize
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = materialize(df.repartitionByRange(n, *order_cols)
                         .withColumn("_pid", F.spark_partition_id()), "dense_index")
    counts = parted.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_pid", F.coalesce(F.sum("_c").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(*order_cols)
    # offsets: one row per partition, broadcast
    return (parted.join(F.broadcast(offs), "_pid")
            .withColumn(out_col, (F.col("_off") + F.row_number().over(w) - 1).cast("long"))
            .drop("_pid", "_off"))


def neighbor_mean_vectors(nodes: DataFrame, edges: DataFrame, key: str, vec_col: str,
                          src: str = "src", dst: str = "dst") -> DataFrame:
    """G4 for array-valued node features: element-wise mean of the source
    vectors per destination, long form ``(dst, pos, mean, n)``.  Each vector
    element is one row of a grouped average, so a destination with a third of
    all sources is still combined map-side."""
    j = edges.select(src, dst).join(nodes.select(F.col(key).alias(src), vec_col), src)
    e = j.select(dst, F.posexplode(vec_col).alias("pos", "v"))
    return e.groupBy(dst, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"),
                                     F.count(F.lit(1)).alias("n"))


def mean_vectors(df: DataFrame, group: str, vec_col: str, out: str = "mean") -> DataFrame:
    """Element-wise mean vector per group, ``(group, n, out)``: one vector
    summary a task and group (combined map-side), no row per element."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(group, array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v"))
    return v.groupBy(group).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("_m")).select(
        group, "n", vector_to_array("_m").alias(out))


def linear_layer(mean, x, w_mean, w_self, bias) -> Column:
    """G4's layer ``relu(W_l * mean + b + W_r * x)`` on array columns; the
    weights are arrays of rows (one per output) and may come from a table."""
    def dot(row, v):
        return F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    mean, x, w_mean, w_self, bias = (F.col(c) if isinstance(c, str) else c for c in (mean, x, w_mean, w_self, bias))
    return F.transform(bias, lambda b, i: F.greatest(
        dot(F.get(w_mean, i), mean) + b + dot(F.get(w_self, i), x), F.lit(0.0)))


def collect_vectors(long: DataFrame, key: str = "dst", value: str = "mean", out: str = "vec") -> DataFrame:
    """Long ``(key, pos, value)`` back to one array per key (length = the
    vector dimension, a fixed bound)."""
    return long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_s")).select(
        key, F.transform("_s", lambda s: s[value]).alias(out))


def cosine(a, b) -> Column:
    """Cosine similarity of two equal-length numeric arrays."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.try_divide(dot, na * nb)


def once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once, whatever ``then`` reads it for: inside higher-order
    functions a repeated expression is evaluated again each time."""
    return F.transform(F.array(value), then)[0]


def _md5_mod(g: Column, buckets: int) -> Column:
    """md5(g) mod buckets by Horner's rule over four 32-bit words."""
    def horner(h):
        m = F.lit(0).cast("long")
        for w in range(4):
            word = F.conv(F.substring(h, 8 * w + 1, 8), 16, 10).cast("long")
            m = F.pmod(m * F.lit(1 << 32) + word, F.lit(buckets))
        return m
    return once(F.md5(g), horner)


def ngram_hash_vector(c, buckets: int, sizes=(2, 3)) -> Column:
    """U4, row-wise form: the same L1-normalised n-gram hash histogram as
    ``ngram_hash`` but as an ARRAY<DOUBLE> of length ``buckets`` computed with
    expressions only (no aggregation), so it also runs inside a stream.
    Used as the suffix node's features: seen and unseen suffixes get the
    same deterministic embedding."""
    c = F.col(c) if isinstance(c, str) else c

    def indices(s):
        n = F.length(s)

        def grams(k):
            return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(s, i, k))) \
                .otherwise(F.array().cast("array<string>"))
        all_g = F.concat(*[grams(k) for k in sizes])
        singles = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, 1))) \
            .otherwise(F.array().cast("array<string>"))
        g = once(all_g, lambda a: F.when(F.size(a) > 0, a).otherwise(singles))
        return F.transform(g, lambda x: _md5_mod(x, buckets))

    def shares(idx):
        total = F.size(idx)
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)),
                           lambda b: F.when(total > 0, F.size(F.filter(idx, lambda x: x == b)) / total)
                           .otherwise(F.lit(0.0)))
    # each step is read many times by the next one: computed once a row
    return once(once(F.regexp_replace(c, r"^\.+|\.+$", ""), indices), shares)


def with_suffix_vector(df: DataFrame, tld: str = "tld", buckets: int = 16, prefix: str = "tldv") -> DataFrame:
    """Append ``{prefix}_0..{prefix}_{buckets-1}``: the suffix's n-gram hash embedding."""
    v = ngram_hash_vector(tld, buckets)
    return df.withColumn("_tv", v).select(
        *df.columns, *[F.element_at("_tv", i + 1).alias(f"{prefix}_{i}") for i in range(buckets)])
