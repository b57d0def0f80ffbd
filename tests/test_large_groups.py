"""Groups so large that their pairs cannot be made one by one."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import features, matching, sample
from tablewright.plans import files_queries
from tablewright.plans.registry import Tables
from tablewright.session import new_path
from tablewright.sources import files


def test_matches_of_one_large_key_are_counted_without_making_them(spark):
    n = 300_000
    left = spark.range(n + 5).select(F.when(F.col("id") >= n, F.col("id")).alias("k"), F.lit("x").alias("v"))
    right = spark.range(n + 3).select(F.when(F.col("id") >= n, F.col("id")).alias("k"), F.lit(1).alias("v"), F.lit(2).alias("w"))
    assert tuple(matching.exact_match_summary(left, right, ["k"]).first()) == (n * n + 3, "k", 4)


def test_counted_matches_are_those_of_the_match(spark):
    left = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (None, None), (2, "b")], "k int, m string")
    right = spark.createDataFrame([(1, "a", 0), (None, None, 1), (None, None, 2), (3, "b", 3)], "k int, m string, z int")
    for columns in (["k"], ["k", "m"], ["m"]):
        want = matching.match_summary(matching.exact_match(left, right, columns), columns).first()
        assert matching.exact_match_summary(left, right, columns).first() == want
    assert matching.exact_match_summary(left, right.filter("z = 3"), ["k"]).first()["matches"] == 0


def counted(spark, df):
    """The table, and an accumulator of how many of its rows were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def test_pairs_are_made_once_for_large_tables(spark):
    pairs, made = counted(spark, spark.range(2000).select(F.col("id").alias("ltable_id"), (F.col("id") * 7 % 900).alias("rtable_id"), (F.col("id") % 2).cast("int").alias("label")))
    tables = [spark.range(60_000).select("id", F.concat(F.lit(side), "id").alias("name")) for side in "ab"]
    rows = matching.pair_join(pairs, *tables).collect()
    assert len(rows) == 2000 and made.value == 2000
    assert {(r["ltable_id"], r["name_A"], r["name_B"]) for r in rows} == {(i, f"a{i}", f"b{i * 7 % 900}") for i in range(2000)}


def test_labelled_pairs_are_made_once_for_all_splits(spark, monkeypatch):
    found = []
    monkeypatch.setattr(files_queries, "labelled_pairs", lambda t, make=files_queries.labelled_pairs: found.append(counted(spark, make(t))) or found[-1][0])
    files_queries.pair_folder(Tables(spark, "/root/testdata/sf0.001"))
    assert found[0][1].value == found[0][0].count()


def test_splits_are_drawn_as_from_the_joined_rows(spark):
    """A pair without a record is no row, so it is not drawn either."""
    folder = new_path(spark, "splits")
    for side in "AB":
        files.sink_csv(spark.range(1, 200).select("id", F.concat(F.lit(side), "id").alias("name")), f"{folder}/table{side}.csv")
    pairs = spark.range(300).select(F.col("id").alias("ltable_id"), (F.col("id") * 7 % 250).alias("rtable_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    files.sink_csv(pairs, f"{folder}/train.csv")
    files.sink_csv(pairs.filter("ltable_id < 30"), f"{folder}/test.csv")
    key = ["ltable_id", "rtable_id"]
    rows = files.load_splits(spark, folder)
    train = sample.balance_classes(rows.filter("split = 'train'"), "label", key)
    want = sample.shuffle_rows(sample.sample_data(train, key, 20), key).unionByName(rows.filter("split = 'test'"), allowMissingColumns=True)
    got = files.read_data(spark, folder, class_balanced=True, max_train_samples=20)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert files.read_data(spark, folder, shuffle=False).columns == rows.columns


def test_mutual_information_reads_the_rows_once(spark):
    df, made = counted(spark, spark.range(4000).selectExpr("id * 37 % 101 / 8D AS a", "id % 17 AS b", "CAST(id * 5 % 3 AS STRING) AS y"))
    got = {r["feature"]: r["importance"] for r in features.mutual_information(df, ["a", "b"], "y", bucket_rows=20).collect()}
    assert made.value == 4000
    whole = {r["feature"]: r["importance"] for r in features.mutual_information(df, ["a", "b"], "y").collect()}
    assert got == pytest.approx(whole, rel=1e-9)
