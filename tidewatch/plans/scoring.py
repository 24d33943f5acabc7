"""End-to-end URL scoring (R2) for batch tables and streams.

``fit_engines`` learns everything serving needs from a labelled table:
the lexical model (M1), the graph dimensions (domain profile with sums,
suffix profile, global profile) and the graph model (M2).  ``score`` applies
them to any URL DataFrame, batch or streaming: URL normalising (C5, in
training and serving alike), lexical features, cold-start graph features (G6),
blend and renormalise (F5), rule guard (R1), allow-list vector (J4/J6), verdict
(U8/U9).  The input is read once: allowed rows take their vector at the end
instead of a branch of their own.  Every step is a projection or a join with a
static table, so the same plan runs inside a Structured Streaming query
without state.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FEATURE_COLS, SERVING_ALPHA
from ..functions.lexical import feature_columns
from ..functions.probs import argmax, blend, class_name, confidence, normalise_exact, prob_map
from ..operators import graph as GR
from ..operators import guard as G
from ..operators.boosting import BoostedTrees
from ..operators.clean import normalise_url
from ..operators.skew import hot_keys_of, skew_safe_left_join
from ..operators.suffix import with_registered_domain
from ..operators.versions import KeyedSums
from ..session import bucketed_table, materialize
from . import models as MD


@dataclass
class Engines:
    lexical: PipelineModel | BoostedTrees
    graph: PipelineModel
    dim_domain: DataFrame      # registered_domain, dom_n, dom_sum_*, dom_*
    dim_tld: DataFrame         # tld, tld_*
    glob: DataFrame            # one row glob_*
    alpha: float = SERVING_ALPHA


def with_features(df: DataFrame, url_col: str = "url", normalise: bool = False) -> DataFrame:
    """``df`` with the 40 features as doubles, of the URL or of its normalised form."""
    cols = df.columns
    if normalise:
        df, url_col = df.withColumn("_norm_url", normalise_url(url_col)), "_norm_url"
    return df.select(*cols, *[c.cast("double").alias(n) for c, n in
                              zip(feature_columns(url_col), FEATURE_COLS)])


def fit_engines(labelled: DataFrame, alpha: float = SERVING_ALPHA, rf_trees: int = 20,
                mlp_iter: int = 40, mlp_seeds=(42, 7), lexical: str = "forest",
                slices_path: str | None = None) -> Engines:
    """Train M1 (``lexical``: forest or boosted) and M2 on ``split == 'train'`` (of the MLP
    candidates the one with the lowest validation log loss stays; with ``slices_path`` the best
    slice of one training that can be resumed there); build the serving dims."""
    # the feature table is read by every step below: compute the 40 features once
    lf = materialize(with_features(labelled, normalise=True), "feature_table", partition_by=["split"])
    train = lf.filter(F.col("split") == "train")
    lex = MD.train_boosted_model(train) if lexical == "boosted" else MD.train_lexical_model(train, num_trees=rf_trees)
    # The serving dimensions are written once and read back (pruned scans)
    # bucketed by their key, so that lookups move the URLs only
    prof = bucketed_table(GR.domain_profile(lf, FEATURE_COLS), "dim_domain", "registered_domain")
    tp = bucketed_table(GR.tld_profile(prof, lf, FEATURE_COLS), "dim_tld", "tld")
    glob = materialize(GR.global_profile(prof, train, FEATURE_COLS), "global_profile")
    prop = GR.propagate(lf, FEATURE_COLS, spread=F.xxhash64("url"), profile=prof, suffix_profile=tp)
    prop = GR.with_suffix_vector(prop, "tld", MD.SUFFIX_BUCKETS)
    gcols = MD.graph_feature_cols()
    # iterative training reads its input once per iteration: cut the lineage
    prop = materialize(prop, "graph_features", partition_by=["split"])
    gtrain = prop.filter(F.col("split") == "train")
    gval = prop.filter(F.col("split") == "val")
    if slices_path:
        gmodel, _ = MD.train_graph_in_slices(gtrain, gval, gcols, slices_path)
    else:
        gmodel, _ = MD.select_graph_model(gtrain, gval, gcols, candidates=tuple((mlp_iter, sd) for sd in mlp_seeds))
    return Engines(lex, gmodel, prof, tp, glob, alpha)


def refreshed(eng: Engines, profile: KeyedSums) -> Engines:
    """The engines with the domain profile as a kept table has it now."""
    return replace(eng, dim_domain=profile.profile())


def save_engines(eng: Engines, path: str) -> None:
    """S6 + S7: persist models and dimension tables under ``path``."""
    MD.save_model(eng.lexical, f"{path}/lexical_model")
    eng.graph.write().overwrite().save(f"{path}/graph_model")
    eng.dim_domain.write.mode("overwrite").parquet(f"{path}/dim_domain")
    eng.dim_tld.write.mode("overwrite").parquet(f"{path}/dim_tld")
    eng.glob.write.mode("overwrite").parquet(f"{path}/global_profile")
    eng.dim_domain.sparkSession.createDataFrame([(float(eng.alpha),)], "alpha double") \
        .write.mode("overwrite").parquet(f"{path}/alpha")


def load_engines(spark, path: str) -> Engines:
    return Engines(MD.load_model(f"{path}/lexical_model"), PipelineModel.load(f"{path}/graph_model"),
                   spark.read.parquet(f"{path}/dim_domain"), spark.read.parquet(f"{path}/dim_tld"),
                   spark.read.parquet(f"{path}/global_profile"),
                   spark.read.parquet(f"{path}/alpha").first()["alpha"])


def verdict(df: DataFrame, p: str = "p_final", classes: bool = False) -> DataFrame:
    """U8 + U9 of a vector column: class name (largest unrounded probability,
    ties to the first), confidence in percent and, asked for, the class -> probability map."""
    extra = [prob_map(p).alias("class_probabilities")] if classes else []
    return df.select("*", class_name(argmax(p)).alias("predicted_class"),
                     confidence(p).alias("confidence_score"), *extra)


def graph_probs_cold(feats: DataFrame, eng: Engines, keep: list[str]) -> DataFrame:
    """Graph engine on rows with features and registered domain: ``p_graph`` and ``domain_unseen``."""
    # the URL joins its domain as one more neighbour
    spread = F.xxhash64(*[F.col(c) for c in keep])
    hot = hot_keys_of(feats, ["registered_domain", "tld"])
    cs = GR.cold_start(feats, eng.dim_domain, eng.glob, FEATURE_COLS, spread=spread, hot=hot["registered_domain"])
    cs = skew_safe_left_join(cs, eng.dim_tld, "tld", "tld_n", F.xxhash64(spread), hot=hot["tld"])
    cs = cs.crossJoin(F.broadcast(eng.glob))  # one row
    # an unseen suffix falls back to the global profile
    cs = cs.select(*[c for c in cs.columns if not c.startswith(("cs_", "tld_", "glob_"))],
                   *[F.col(f"cs_{c}").alias(f"dom_{c}") for c in FEATURE_COLS],
                   *[F.coalesce(F.col(f"tld_{c}"), F.col(f"glob_{c}")).alias(f"tld_{c}") for c in FEATURE_COLS])
    cs = GR.with_suffix_vector(cs, "tld", MD.SUFFIX_BUCKETS)
    return MD.graph_probs(eng.graph, cs, MD.graph_feature_cols())


def score(urls: DataFrame, eng: Engines, url_col: str = "url", normalise: bool = True,
          debug: bool = False, classes: bool = False) -> DataFrame:
    """Score every row of ``urls`` (batch or streaming); input columns are
    kept, so rows stay keyed by the caller's id, never by position."""
    keep = urls.columns
    d = with_registered_domain(urls, url_col=url_col)
    d = G.flag_allowed(d, "registered_domain")
    d = d.withColumn("_feat_url", normalise_url(url_col) if normalise else F.col(url_col))
    d = d.withColumn("status", F.when(F.col("is_allowed") | F.col("_feat_url").rlike(r"(?U)\S"), "ok")
                     .otherwise("invalid"))
    d = MD.lexical_probs(eng.lexical, with_features(d, "_feat_url"))
    scored = graph_probs_cold(d, eng, keep)
    scored = scored.withColumn("p_blend", normalise_exact(blend("p_lex", "p_graph", eng.alpha)))
    scored = scored.withColumn("is_unseen", F.col("domain_unseen"))
    scored = scored.withColumn("guard_rule", G.guard_rule(url_col, "is_unseen"))
    # an allowed URL takes the fixed vector; a blank one keeps its row, with status 'invalid' and no vector
    scored = scored.withColumn("p_final", F.when(F.col("is_allowed"), G.allow_vector()).when(
        F.col("status") == "ok", G.apply_guard("p_blend", F.col("guard_rule"))))
    dbg = ["p_lex", "p_graph", "p_blend", "guard_rule", "is_unseen"] if debug else []
    shown = [F.when(~F.col("is_allowed"), F.col(c)).alias(c) for c in dbg]
    out = scored.select(*keep, "registered_domain", "is_allowed", "p_final", "status", *shown)
    return verdict(out, classes=classes)
