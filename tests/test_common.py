import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.operators import common as co


def _skewed(spark, n=3000, seed=1):
    rng = random.Random(seed)
    data = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(30)}", i, rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(data, "g string, id long, v long").repartition(8)


def test_distributed_rank_equals_window(spark):
    df = _skewed(spark)
    got = co.distributed_rank(df, ["g"], [F.desc("v"), F.asc("id")])
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), F.asc("id"))))
    assert got.count() == 3000
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_distributed_rank_global_and_null_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id long")
    got = co.distributed_rank(df, ["g"], [F.desc("id")]).collect()
    assert {(r.g, r.id, r["rank"]) for r in got} == {(None, 1, 2), (None, 2, 1), ("a", 3, 1)}
    ranks = [r["rank"] for r in co.distributed_rank(_skewed(spark), [], [F.asc("v"), F.asc("id")]).orderBy("v", "id").collect()]
    assert ranks == list(range(1, 3001))


def test_top_k_prunes_before_the_shuffle(spark):
    df = _skewed(spark)
    got = co.top_k(df, ["g"], [F.desc("v"), F.asc("id")], 3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert got.filter("g = 'hot'").count() == 3
    large = co.top_k(df, ["g"], [F.desc("v"), F.asc("id")], 1100)
    assert large.filter("g = 'hot'").count() == min(1100, df.filter("g = 'hot'").count())


def test_metric_ranks(spark):
    df = spark.createDataFrame([("a", "x", 3, 1), ("b", "x", 3, 9), ("c", "y", 5, 2)], "k string, p string, m long, n long")
    got = co.metric_ranks(df, "k", ["m", "n"], (None, "p"), {"n": F.col("m") >= 4}).collect()
    ranks = {(r.k, r.scope, r.metric): (r["rank"], r.pool) for r in got}
    assert ranks[("c", "all", "m")] == (1, 3) and ranks[("a", "all", "m")] == (2, 3) and ranks[("b", "all", "m")] == (3, 3)
    assert ranks[("c", "all", "n")] == (1, 1) and ("a", "all", "n") not in ranks
    assert ranks[("b", "p", "m")] == (2, 2)


def test_interval_join_against_brute_force(spark):
    rng = random.Random(3)
    points = [("hot" if rng.random() < 0.5 else "b", i, rng.randrange(1000)) for i in range(300)]
    ranges = [("hot" if rng.random() < 0.5 else "b", j, s, s + rng.randrange(0, 200)) for j, s in enumerate(rng.randrange(1000) for _ in range(60))]
    p = spark.createDataFrame(points, "k string, i long, pos long")
    r = spark.createDataFrame(ranges, "k string, j long, s long, e long")
    joined = co.interval_join(p, r, "k", "pos", "s", "e", width=64)
    want = sorted((i, j) for k, i, pos in points for k2, j, s, e in ranges if k == k2 and s <= pos < e)
    assert sorted((x.i, x.j) for x in joined.collect()) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_forward_asof_against_brute_force(spark):
    rng = random.Random(5)
    left = [("hot" if rng.random() < 0.5 else "b", i, rng.randrange(500)) for i in range(200)]
    right = [("hot" if rng.random() < 0.5 else "b", rng.randrange(500)) for _ in range(40)]
    right = sorted(set(right))
    l = spark.createDataFrame(left, "k string, i long, pos long")
    r = spark.createDataFrame([(k, p, p * 10) for k, p in right], "k string, rp long, val long")
    got = {x.i: x.val for x in co.forward_asof(l, r, "k", "pos", "rp", "val", width=32).collect()}
    want = {i: min((p * 10 for k2, p in right if k2 == k and p > pos), default=None) for k, i, pos in left}
    assert got == want


def test_pinned_columns_are_not_copied_into_filters(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    plan = co.pinned(df, words=F.regexp_count("t", F.lit("\\S+"))).filter("words > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_ratio_defaults(spark):
    df = spark.createDataFrame([(1, 0), (3, 4), (1, None)], "a long, b long")
    assert [r.x for r in df.select(co.ratio(F.col("a"), F.col("b"), 50.0, 100).alias("x")).collect()] == [50.0, 75.0, 50.0]


def test_lookup_frame_keeps_nulls_and_its_size(spark):
    rows = [("a", 1.0, None, True), ("b", None, 2, None)]
    got = co.lookup_frame(spark, rows, "k string, x double, n int, f boolean")
    assert got.filter("x IS NULL").count() == 1 and got.filter("n IS NULL").count() == 1
    assert [tuple(r) for r in got.orderBy("k").collect()] == rows
    assert "LocalTableScan" in got._jdf.queryExecution().executedPlan().toString()
    assert co.lookup_frame(spark, [], "k string").count() == 0


def test_ranks_are_long_and_group_joins_keep_all_rows(spark):
    df = _skewed(spark)
    ranked = co.distributed_rank(df, ["g"], [F.asc("id")])
    assert dict(ranked.dtypes)["rank"] == "bigint"
    groups = df.groupBy("g").agg(F.count("id").alias("n"))
    assert co.join_groups(df, groups, ["g"]).count() == df.count()
