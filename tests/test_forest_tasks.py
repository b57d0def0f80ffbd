"""The forest's tasks hold a bounded number of rows, however the table is stored."""

from tablewright.operators import features


def test_one_partition_is_dealt_over_tasks(spark, monkeypatch):
    seen = []
    fit = features.RandomForestClassifier.fit
    monkeypatch.setattr(features.RandomForestClassifier, "fit", lambda self, df: seen.append(df.rdd.glom().map(len).collect()) or fit(self, df))
    df = spark.range(0, 3000, 1, 1).selectExpr("id % 10 AS x", "id * 7 % 13 AS y", "CAST(id % 10 > 4 AS STRING) AS label")
    monkeypatch.setattr(features, "FOREST_ROWS", 500, raising=False)
    scores = {r["feature"]: r["importance"] for r in features.forest_importance(df, ["x", "y"], "label", trees=5).collect()}
    assert sum(seen[0]) == 3000 and max(seen[0]) <= 600
    assert scores["x"] > 0.9
