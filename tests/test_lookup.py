from pyspark.sql import functions as F

from kerbline.operators import lookup as joins


def bag(df):
    return sorted(map(str, df.collect()))


def tables(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string"))
    fact = spark.range(3000).select("id", key.alias("k"))
    dim = spark.createDataFrame([("hot", 1), (None, 2), ("5", 3), ("8", 4), ("unused", 5)], "k string, v int")
    return fact, dim


def test_large_tables_give_the_same_as_small_ones(spark):
    fact, dim = tables(spark)
    small = joins.lookup(fact, dim, ["k"])
    large = joins.lookup(fact, dim, ["k"], max_rows=2)
    assert small.count() == large.count() == 3000
    assert bag(small) == bag(large)
    values = {r.k: r.v for r in small.where("k is null or k in ('hot', '5', '11')").select("k", "v").distinct().collect()}
    assert values == {None: 2, "hot": 1, "5": 3, "11": None}


def test_wide_rows_of_hot_keys(spark, monkeypatch):
    fact, dim = tables(spark)
    expected = bag(joins.lookup(fact, dim, ["k"]))
    monkeypatch.setattr(joins, "fits_broadcast", lambda *args: False)
    assert bag(joins.lookup(fact, dim, ["k"])) == expected


def test_several_keys(spark):
    fact = spark.createDataFrame([("a", 1), ("a", None), ("b", 1)], "x string, y int")
    dim = spark.createDataFrame([("a", 1, "p"), ("a", None, "q")], "x string, y int, z string")
    for limit in (10, 0):
        got = {(r.x, r.y): r.z for r in joins.lookup(fact, dim, ["x", "y"], max_rows=limit).collect()}
        assert got == {("a", 1): "p", ("a", None): "q", ("b", 1): None}


def test_spread_join_copies_nothing_into_the_result(spark):
    many = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise("cold").alias("k"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, v int")
    assert bag(joins.spread_join(many, few, "k", "id", small=True)) == bag(joins.spread_join(many, few, "k", "id", small=False))


def test_measure(spark):
    assert joins.measured(spark.range(10)) == (10, True)
    assert joins.measured(spark.range(10), max_rows=9) == (10, False)
    wide = spark.range(1).select(F.repeat(F.lit("x"), 70 * 1024 * 1024).alias("w"))
    assert joins.measured(wide) == (1, False)


def test_only_hot_keys_are_sharded(spark):
    many = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    shards = {r.k: r["_shards"] for r in joins._hot_shards(many, ["k"]).collect()}
    assert shards == {"hot": 334}
    few = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    copies = joins._copied(few, joins._hot_shards(many, ["k"]), ["k"]).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in copies} == {"hot": 334, "1": 1}
    plan = joins.spread_join(many, few, "k", "id", small=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Cartesian" not in plan
