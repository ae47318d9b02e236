from pyspark.sql import functions as F

from wordloom.llm.topn import latest, top_n


def test_order_of_nulls_nans_and_ties(spark):
    rows = [(1, 5, 2.0, 1), (1, 4, 2.0, 1), (1, 6, None, 0), (1, 7, float("inf"), 0), (None, 1, 1.0, 0), (2, 1, 0.0, None), (2, 2, 0.0, 3), (1, 6, None, 0)]
    df = spark.createDataFrame(rows, "g int, item int, score double, rank int").withColumnRenamed("rank", "n")
    order = [F.col("score").desc_nulls_first(), F.col("n").desc_nulls_last(), F.col("item").asc()]
    got = [(r.g, r.rank, r.item) for r in top_n(df.distinct(), ["g"], order, 3).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 6), (1, 2, 7), (1, 3, 4), (None, 1, 1), (2, 1, 2), (2, 2, 1)], key=repr)
    assert top_n(df.where("false"), ["g"], order, 3).collect() == []


def test_latest_takes_nulls_last_and_a_second_column(spark):
    df = spark.createDataFrame([(1, None, 9, "a"), (1, 3, 1, "b"), (1, 3, 2, "c"), (2, None, None, "d")], "k int, at int, id int, v string")
    assert sorted(r.v for r in latest(df, ["k"], ["at", "id"]).collect()) == ["c", "d"]


def test_the_group_limit_stands_before_and_after_the_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 as g", "id").write.parquet(str(tmp_path / "t"))
    df = top_n(spark.read.parquet(str(tmp_path / "t")), ["g"], [F.desc("id")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
