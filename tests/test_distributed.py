import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import distributed as D
from threadloom import session
from threadloom.sources.derived import Forum


@pytest.mark.parametrize("n", [1, 2, 3, 10, 501])
def test_ranks_are_exact(spark, n):
    rng = random.Random(n)
    values = [rng.choice([0, 5, -7, rng.randrange(10**13), -rng.randrange(10**8)]) for _ in range(n)]
    rows = [("a", v) for v in values] + [("b", None), ("c", 4)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    upper = {r["k"]: r["m"] for r in D.upper_median(df, ["k"], "v", "m").collect()}
    middle = {r["k"]: r["m"] for r in D.interpolated_median(df, ["k"], "v", "m").collect()}
    assert upper == {"a": sorted(values)[n // 2], "c": 4}
    assert middle == {"a": float(np.median(np.array(values, dtype="float64"))), "c": 4.0}
    assert D.upper_median(df.filter("k = 'a'"), [], "v", "m").first()["m"] == sorted(values)[n // 2]


def test_positions_of_a_dominant_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"),
        F.hash("id").alias("v"),
        "id",
    )
    got = D.positions(df.repartition(7), ["g"], [F.desc("v"), F.asc("id")]).toPandas()
    want = df.toPandas().sort_values(["g", "v", "id"], ascending=[True, False, True])
    want["position"] = want.groupby("g").cumcount()
    both = got.merge(want, on=["g", "v", "id"])
    assert len(both) == 5000 and (both.position_x == both.position_y).all()


def test_running_total(spark):
    df = spark.range(3000).select("id", (F.hash("id") % 100).alias("v"))
    got = D.running_total(df.repartition(5), [F.desc("id")], "v", "t").toPandas().sort_values("id", ascending=False)
    assert (got.t.to_numpy() == got.v.cumsum().to_numpy()).all()


@pytest.mark.parametrize("share", [1, 5, 1000])
def test_lookup_keeps_all_rows(spark, share):
    facts = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.concat(F.lit("n"), "k"))
    got = D.lookup_by_key(facts, dim, "k", "n", 2000, heavy_share=share).toPandas()
    assert len(got) == 2000 and (got.name == "n" + got.k.astype(str)).all()


def test_first_n_is_cut_before_the_shuffle(spark, capsys):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    D.first_n(df, ["g"], [F.desc("id")], 2).explain()
    plan = capsys.readouterr().out
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_shuffles_start_with_more_partitions_for_more_input(spark, tmp_path, monkeypatch):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(session, "_PARTITION_BYTES", 1000)
    try:
        (tmp_path / "small").mkdir()
        (tmp_path / "large").mkdir()
        (tmp_path / "small" / "t").write_bytes(b"x" * 10)
        (tmp_path / "large" / "t").write_bytes(b"x" * 90_500)
        least = session.partition_by_size(spark, str(tmp_path / "small"))
        assert least >= int(spark.conf.get("spark.sql.shuffle.partitions"))
        Forum(spark, str(tmp_path / "large"))
        assert int(spark.conf.get(name)) == max(least, 91)
        assert session.partition_by_size(spark, str(tmp_path / "small")) == max(least, 91)  # never lowered
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_light_keys_are_looked_up_by_shuffle(spark):
    facts = spark.range(3000).select((F.col("id") % 1500).alias("k"), "id")
    dim = spark.range(1500).select(F.col("id").alias("k"), (2 + F.col("id") % 2).alias("n"), (F.col("id") * 10).alias("v"))
    found = D.lookup_by_key(facts, dim, "k", "n", 3000)
    assert found.filter("v = k * 10").count() == 3000
    # Only the heavy keys are broadcast, once for each side.
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("BroadcastHashJoin") == 2
