"""The helpers that operators share, with a hot key and with groups that reach over batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm.common import dropped, grouped, join_by_key, made, scratch, written


def test_join_by_key_with_a_hot_key(spark):
    left = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"))
    right = left.filter("k is not null and k <> 'k1'").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = {r.id: r.most for r in join_by_key(left, right, "k", "n", F.col("id"), 2000).collect()}
    want = {r.k: r.most for r in right.collect()}
    assert got == {r.id: want.get(r.k) for r in left.collect()}
    assert join_by_key(left, right.limit(0), "k", "n", F.col("id"), 2000).filter("most is not null").isEmpty()


def test_groups_reach_over_batches():
    keys = [1, 1, 2, 2, 2, 3, 4, 4]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a:b], "v": list(range(a, b))}) for a, b in ((0, 3), (3, 3), (3, 4), (4, 8))]
    got = [(g["k"][0].as_py(), g["v"].to_pylist()) for g in grouped(batches, ["k"])]
    assert got == [(1, [0, 1]), (2, [2, 3, 4]), (3, [5]), (4, [6, 7])]
    assert list(grouped([], ["k"])) == []


def test_tables_go_to_the_shared_folder(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
    assert written(spark.range(3), "t").count() == 3


def test_tables_are_dropped_but_for_those_kept(spark):
    import os

    since = len(made())
    a, b = written(spark.range(3), "a"), written(spark.range(4), "b")
    paths = made()[since:]
    dropped(spark, since, (paths[1],))
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, True]
    assert made()[since:] == [paths[1]] and b.count() == 4 and a.columns == ["id"]


def test_pipeline_leaves_its_result_alone(spark, tmp_path):
    import os

    import corpus_pipeline

    rows = [(i, f"the one and the other {i} went to town with a dog and {i * 7} cats", "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    since = len(made())
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = made()[since:]
    assert out.count() > 0 and len(left) == 1 and os.path.exists(left[0].removeprefix("file://"))
