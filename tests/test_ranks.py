from pyspark.sql import functions as F

from halyard.operators import assign, verify
from halyard.operators.ranks import global_rank


def test_places_over_many_ranges(spark):
    ids = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("id"), F.lit("x").alias("chunk"))
    rows = global_rank(ids, [F.col("id").desc()], "place")
    assert rows.columns == ["id", "chunk", "place"]
    assert rows.filter("place <> 4999 - id").count() == 0 and rows.count() == 5000
    assert sorted((r["chunk"], r["count"]) for r in verify.chunks(ids, [F.col("id")], 1500).groupBy("chunk").count().collect()) == [
        (0, 1500), (1, 1500), (2, 1500), (3, 500)
    ]


def test_ties_nulls_one_value_and_no_rows(spark):
    tied = spark.createDataFrame([(1, "b"), (None, "a"), (1, "c"), (1, "b")], "k int, v string")
    rows = assign.number_from(tied, 10, [F.col("k"), F.col("v")], "id").orderBy("id").collect()
    assert [(r["id"], r["k"], r["v"]) for r in rows] == [(10, None, "a"), (11, 1, "b"), (12, 1, "b"), (13, 1, "c")]
    assert global_rank(tied.filter("false"), [F.col("k")], "n").collect() == []


def test_plan_has_no_window_over_all_rows(spark):
    rows = global_rank(spark.range(100).toDF("id"), [F.col("id")], "n")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    window = plan.index("Window [")
    assert "Aggregate [_range" in plan[window:]
