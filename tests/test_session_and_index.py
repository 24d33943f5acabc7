from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import graph as GR
from tidewatch.operators import split
from tidewatch.session import input_signature, recommended_conf


def test_recommended_conf_scales_with_input():
    small = recommended_conf(10 << 30, 1000)
    big = recommended_conf(100 << 40, 1000)
    assert int(small["spark.sql.shuffle.partitions"]) == 2000  # at least two waves of cores
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_dense_index_equals_global_row_number(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("first_id"),
                                 F.concat(F.lit("d"), F.col("id").cast("string")).alias("key"))
    got = {r.key: r.node_id for r in GR.dense_index(df, ["first_id", "key"], partitions=7).collect()}
    w = Window.orderBy("first_id", "key")
    ref = {r.key: r.rn - 1 for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == ref


def test_bernoulli_split_fractions(spark):
    df = spark.range(20000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("k"))
    c = {r.split: r.n for r in split.bernoulli_split(df, "k").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert abs(c["train"] / 20000 - 0.70) < 0.02 and abs(c["val"] / 20000 - 0.15) < 0.02


def test_input_signature_follows_the_files(spark, tmp_path):
    p = f"{tmp_path}/t.parquet"
    spark.range(5).write.parquet(p)
    a = input_signature(p)
    assert a == input_signature(f"{p}") and a != input_signature(f"{tmp_path}/other.parquet")
    spark.range(6).write.mode("overwrite").parquet(p)
    assert input_signature(p) != a


def test_unkeyed_stages_are_released(spark):
    import os
    from tidewatch import session
    session.release_stages(spark)
    df = session.materialize(spark.range(3), "t")
    path = df.inputFiles()[0].replace("file://", "")
    kept = session.materialize(spark.range(3), "k", key=("x",))
    assert os.path.exists(path) and session.release_stages(spark) == 1
    assert not os.path.exists(path) and kept.count() == 3


def test_a_cluster_needs_a_shared_checkpoint_folder():
    import pytest
    from types import SimpleNamespace
    from tidewatch import session
    conf = SimpleNamespace(get=lambda k, d=None: d)
    for master, local in (("local[4]", True), ("local", True), ("local-cluster[1,1,512]", False), ("yarn", False)):
        assert session.is_local(master) == local
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="yarn")
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc))


def test_settings_of_the_user_stay():
    """A submitted session with its own settings keeps them; what is unset is filled in."""
    import os
    import subprocess
    import sys
    code = ("from tidewatch.session import get_session; s = get_session('local[1]');"
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.adaptive.skewJoin.enabled'),"
            "s.conf.get('spark.sql.session.timeZone'))")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=400 --conf spark.ui.enabled=false "
                        "--conf spark.sql.adaptive.skewJoin.enabled=false pyspark-shell"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True, timeout=120)
    assert "GOT 400 false UTC" in out.stdout, out.stderr[-500:]


def test_alpha_zero_is_a_weight():
    from tidewatch.constants import SERVING_ALPHA
    from tidewatch.plans.jobs import _alpha
    assert _alpha(0.0) == 0.0 and _alpha(None) == SERVING_ALPHA
