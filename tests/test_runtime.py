from pyspark.sql import functions as F

from noteloom import runtime


def test_lookup_join_splits_hot_keys(spark):
    facts = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 300).alias("k"), "id")
    dim = facts.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    plain = facts.join(dim, "k")
    split = runtime.lookup_join(facts, dim, ["k"], weight="n", hot_share=10, dim_rows=runtime.BROADCAST_ROWS + 1)
    small = runtime.lookup_join(facts, dim, ["k"], weight="n")
    assert sorted(map(tuple, split.select("id", "v").collect())) == sorted(map(tuple, plain.select("id", "v").collect()))
    assert sorted(map(tuple, small.select("id", "v").collect())) == sorted(map(tuple, plain.select("id", "v").collect()))


def test_bounded_rows(spark):
    assert len(runtime.bounded_rows(spark.range(5), 5)) == 5
    assert runtime.bounded_rows(spark.range(6), 5) is None


def test_bucketed_sums_need_no_shuffle(spark):
    table = runtime.stage_bucketed(spark.range(1000).withColumn("v", F.col("id") % 7), "id", 4)
    plan = table.groupBy("id", "v").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_search_plan_has_one_shuffle(spark):
    from noteloom.operators.text_index import build_index
    from noteloom.operators.text_search import text_search

    docs = spark.createDataFrame([(i, f"word{i} common text") for i in range(50)], "id int, text string")
    queries = spark.createDataFrame([(1, "word3 common"), (2, "word4")], "query_id int, text string")
    found = text_search(queries, build_index(docs, "id", "text"), docs, "text", 3, 0.3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") >= 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Exchange hashpartitioning(id" not in plan
    assert {(r.query_id, r.id) for r in found.where("rank = 1").collect()} == {(1, 3), (2, 4)}


def test_staged_tables_can_be_dropped(spark):
    other = spark.newSession()
    path = runtime._run_dir(other)
    runtime.stage(other.range(3))
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(fs_path)
    runtime.stage_bucketed(other.range(3), "id", 2)
    runtime.drop_staged(other)
    assert not fs.exists(fs_path)
    assert not [t for t in other.catalog.listTables() if t.name.startswith("noteloom_staged_")]


def test_lookup_join_broadcasts_the_most_frequent_keys(spark, monkeypatch):
    """Most rows of a skewed table stay where they are, although no key holds a thousandth of them; the broadcast is bounded."""
    monkeypatch.setattr(runtime, "HOT_ROWS", 2500)
    often = spark.range(40_000).select((F.col("id") % 2000).alias("k"))
    facts = often.unionByName(spark.range(4000).select((F.col("id") + 2000).alias("k")))
    dim = facts.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    sent = []
    plain = F.broadcast
    monkeypatch.setattr(runtime.F, "broadcast", lambda df: sent.append(df.count()) or plain(df))
    split = runtime.lookup_join(facts, dim, ["k"], weight="n", how="left", dim_rows=runtime.BROADCAST_ROWS + 1)
    assert sent == [2000, 2000]
    assert split.count() == 44_000 and split.where("v = k * 10").count() == 44_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_are_broadcast_by_bytes_too(spark, monkeypatch):
    """Few long rows are as heavy as many short ones; what is too large is not broadcast by Spark's guess from file sizes either."""
    side = spark.range(1000).select("id", F.repeat(F.lit("path/"), 20).alias("path"), F.lit(1).alias("n"))
    facts = spark.range(5000).select((F.col("id") % 1500).alias("id"))
    want = facts.join(side, "id").count()
    small = runtime.lookup_join(facts, side, ["id"], weight="n", how="left")
    assert "BroadcastHashJoin" in _plan(facts.join(runtime.checked(side), "id")) and "BroadcastHashJoin" in _plan(small)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 50_000)
    met = facts.join(runtime.checked(side), "id")
    assert "BroadcastHashJoin" not in _plan(met) and met.count() == want
    apart = runtime.lookup_join(facts, side.withColumn("n", F.when(F.col("id") < 3, 10_000).otherwise(1)), ["id"], weight="n", how="left")
    assert "SortMergeJoin" in _plan(apart) and apart.where("path is not null").count() == want and apart.count() == 5000
