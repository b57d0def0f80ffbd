"""Small fixtures with known answers, errors, and round trips."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from tablewright.functions import numbers, tables, text
from tablewright.functions.columns import common_columns, drop_rename, reorder_columns, select_by_type
from tablewright.functions.probability import gamma_p, kurtosis_z, normal_cdf, skew_z
from tablewright.operators import distribution, examples, features, impute, matching, metrics, power, profile, rules, scale, smart, structure
from tablewright.operators.missing import blanks_to_null, columns_with_missing
from tablewright.plans.prepare import prepare_table, run_request
from tablewright.session import new_path
from tablewright.sources import files


@pytest.fixture(scope="module")
def holed(spark):
    schema = "row_id int, numeric1 double, numeric2 double, category string, all_missing double"
    rows = [(0, 1.0, 10.0, "A", None), (1, 2.0, None, "B", None), (2, None, 30.0, None, None), (3, 4.0, None, "B", None), (4, 5.0, 50.0, "C", None)]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("method, first, second", [("mean", 3.0, 30.0), ("median", 3.0, 30.0), ("most_frequent", 1.0, 10.0), ("constant", 0.0, 0.0)])
def test_simple_fills(holed, method, first, second):
    done, used = impute.impute(holed, method)
    rows = {r["row_id"]: r for r in done.collect()}
    assert used == ["numeric1", "numeric2", "category", "all_missing"] and done.columns == holed.columns
    assert rows[2]["numeric1"] == first and rows[1]["numeric2"] == second and rows[2]["category"] == "B"
    assert rows[0]["all_missing"] == (0.0 if method == "constant" else None)


@pytest.mark.parametrize("method", ["mean", "knn", "iterative"])
@pytest.mark.parametrize("how", [None, "standard", "minmax"])
def test_imputation_keeps_present_cells(holed, method, how):
    done, _ = impute.impute(holed, method, ["numeric1", "numeric2"], how)
    for old, new in zip(holed.orderBy("row_id").collect(), done.orderBy("row_id").collect()):
        for c in ("numeric1", "numeric2"):
            assert new[c] is not None and (old[c] is None or new[c] == pytest.approx(old[c]))


def test_scaled_constant(holed):
    for how, want in (("standard", 3.0), ("minmax", 1.0)):
        done, _ = impute.impute(holed, "constant", ["numeric1"], how)
        assert done.filter("row_id = 2").first()["numeric1"] == want


def test_unknown_names_are_refused(holed):
    for call in (
        lambda: impute.impute(holed, "invalid_method"),
        lambda: impute.impute(holed, "mean", ["nope"]),
        lambda: scale.fit_scale(holed, "nope"),
        lambda: power.fit_transform(holed, "nope"),
        lambda: features.select_features(holed, "category", method="nope"),
        lambda: metrics.task_metrics(holed, "category", "category", "nope"),
        lambda: power.inverse_transform(holed, None),
        lambda: features.feature_transform(holed, None),
        lambda: matching.exact_match(holed, holed.toDF(*"vwxyz")),
        lambda: matching.exact_match(holed, holed, ["nope"]),
        lambda: run_request({"operation": "nope"}, holed),
        lambda: examples.generate_prompt(holed, "row_id", "manual"),
        lambda: power.fit_power(holed.withColumn("z", F.lit(-1.0)), "box-cox", ["z"]),
    ):
        with pytest.raises(ValueError):
            call()


def test_nothing_missing_changes_nothing(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert impute.impute(df) == (df, []) or impute.impute(df)[1] == []
    assert smart.impute_smart(df, "a", ["a"]) == (df, {})
    assert columns_with_missing(df) == []


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 3.0)], "id int, x double")
    assert [r["x"] for r in impute.impute(df, "mean", ["x"])[0].orderBy("id").collect()] == [1.0, 2.0, 2.0, 3.0]


def test_numeric_text_profile(spark):
    columns = "ID int, Name string, Age string, Score string, Income string, Temperature string, Scientific string, Mixed string, Empty string, Constant string"
    rows = [
        (1, "Ann", "25", "85.5%", "$50,000", "36.6", "1.2e-3", "123", None, "100"),
        (2, "Bob", "30", "92.0%", "$60,000", "37.2", "2.5e+4", "abc", None, "100"),
        (3, "Cid", None, "78.3%", "$75,000", None, "3.7e2", "45.6", None, "100"),
        (4, "Dee", "35", None, None, "36.8", "1.1e-5", "def", None, "100"),
        (5, "Eve", "28", "88.7%", "$45,000", "36.5", None, "ghi", None, "100"),
    ]
    got = {r["column"]: r for r in profile.numeric_profile(spark.createDataFrame(rows, columns), min_ratio=0.6).collect()}
    kinds = {
        "ID": "native_numeric", "Age": "integer", "Score": "percentage", "Income": "decimal", "Temperature": "decimal",
        "Scientific": "scientific", "Constant": "integer", "Mixed": "integer", "Name": "non_numeric", "Empty": "non_numeric",
    }
    assert {c: got[c]["detected_format"] for c in kinds} == kinds
    assert {c for c in kinds if got[c]["is_numeric"]} == set(kinds) - {"Mixed", "Name", "Empty"}
    assert got["Mixed"]["numeric_ratio"] == pytest.approx(0.4) and got["Age"]["na_ratio"] == pytest.approx(0.2)


def test_number_spellings(spark):
    cases = {
        "1": "integer", " -7 ": "integer", ".5": "decimal", "1e5": "scientific", "1,234": "decimal", "$5": "currency", "5 €": "currency",
        "5%": "percentage", "1d": None, "1_000": None, "inf": "decimal", "": None, "abc": None, "-": None, "$50,000": "decimal", "1.2.3": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["f"] for r in df.withColumn("f", numbers.classify_numeric_format("v")).collect()}
    assert got == cases


def test_value_rules(spark):
    rows = [
        ("John Smith (USA)", "1,234.5 pts", "2023/01/15", "2020-2023", "$50,000", "98.5%"),
        ("Maria Garcia (ESP)", "987.0pts", "2023-02-20", "2019/20", "$75,000.00", "87.3%"),
        ("Liu Wei (CHN)", "2,345.8 pts", "23/03/2023", "2021-22", "$100,000", "92.8%"),
    ]
    df = spark.createDataFrame(rows, ["player", "score", "day", "span", "prize", "form"])
    spec = structure.ValueRules({"player": "country"}, ["day"], ["score", "prize", "form"], {"span": ("start", "end")})
    got = structure.normalize_table(df, spec).collect()
    assert [tuple(r) for r in got] == [
        ("John Smith", 1234.5, "2023-01-15", "2020-2023", 50000.0, pytest.approx(0.985), "USA", 2020, 2023),
        ("Maria Garcia", 987.0, "2023-02-20", "2019/20", 75000.0, pytest.approx(0.873), "ESP", 2019, 2020),
        ("Liu Wei", 2345.8, "2023-03-23", "2021-22", 100000.0, pytest.approx(0.928), "CHN", 2021, 2022),
    ]


def test_general_format(spark):
    values = [0.0, 1.0, -2.5, 1 / 3, 123456.0, 1234567.0, 0.0001, 0.00001234567, 1e-10, 99999.96, 1e20, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(text.general_format(F.col("v"))).collect()]
    assert got == [f"{v:.6g}" for v in values]
    row = spark.createDataFrame([([1.0, float("nan"), None, 2.25],)], "a array<double>").select(
        text.serialize_sequence("a").alias("x"), text.serialize_sequence("a", ",", add_index=True).alias("y")
    )
    assert tuple(row.first()) == ("1.nan.nan.2.25", "0: 1 , 1: nan , 2: nan , 3: 2.25")


def test_reply_with_apostrophes(spark):
    replies = [("a", 'normalized_table = [["n"], ["O\'Hara"], ]'), ("b", "[['n'], ['x']]"), ("c", "no table"), ("d", "[]"), ("e", '[["n"]]')]
    df = spark.createDataFrame(replies, "id string, reply string")
    assert {(r["id"], r["n"]) for r in tables.rows_to_table(df, ["id"], "reply", ["n"]).collect()} == {("a", "O'Hara"), ("b", "x")}


def test_names_and_types(spark):
    assert structure.normalized_names(["ID", "Unit Price", "Total-Cost", "my col!", "First Name", "Title"]) == [
        "id", "price", "price_1", "my_col", "name", "name_1",
    ]
    rows = [(str(i), f"{i}.5", "x" if i % 2 else "y", f"2024-01-{i + 1:02d}", f"t{i}", None) for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string")
    want = {"a": "int64", "b": "float64", "c": "category", "d": "datetime", "e": "string"}
    assert structure.inferred_types(df) == want == structure.inferred_types(df, sample=5, order_col="a") | {"c": "category"}
    done, _ = structure.infer_types(df)
    assert [t for _, t in done.dtypes][:3] == ["bigint", "double", "string"] and done.filter("d IS NULL").isEmpty()


def test_matching_of_duplicates_and_nulls(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, None, 6)], "id int, name string, v int")
    b = spark.createDataFrame([(8, "x", 7), (9, None, 7), (10, "x", 7)], "id int, name string, w int")
    got = matching.exact_match(a, b, ["name"])
    assert got.columns == ["id_1", "name", "v", "id_2", "w"]
    assert {(r["id_1"], r["id_2"]) for r in got.collect()} == {(1, 8), (1, 10), (2, 9)}
    with pytest.raises(ValueError):
        matching.self_match(a, ["id", "name"], ["id"], drop_identity=True)
    assert matching.self_match(b, ["name"], ["id"], drop_identity=True).count() == 2


def test_distribution_anchors(spark):
    for values, want in (([2, 8, 0, 4, 1, 9, 9, 0], 0.446263853741970), (list(range(1, 9)), 1.010804860917779)):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        z = df.agg(skew_z(F.lit(float(len(values))), F.skewness("x")).alias("z")).first()["z"]
        assert z == pytest.approx(want, abs=1e-9)
    df = spark.range(20).select(F.col("id").cast("double").alias("x"))
    assert df.agg(kurtosis_z(F.lit(20.0), F.kurtosis("x")).alias("z")).first()["z"] == pytest.approx(-1.705810415212206)
    cdf = spark.createDataFrame([(v,) for v in (-3.0, -0.5, 0.0, 1.96)], "x double").select("x", normal_cdf(F.col("x")).alias("p"))
    assert all(r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / 2**0.5), abs=1e-6) for r in cdf.collect())
    assert gamma_p(1.0, np.array([0.5, 3.0])) == pytest.approx(1 - np.exp([-0.5, -3.0]))
    assert gamma_p(0.5, np.array([0.2, 4.0])) == pytest.approx([math.erf(0.2**0.5), math.erf(2.0)])


def test_families_are_recognised(spark):
    rng = np.random.default_rng(2)
    data = {"normal": rng.normal(5, 2, 4000), "uniform": rng.uniform(3, 9, 4000), "exponential": rng.exponential(2, 4000)}
    df = spark.createDataFrame([tuple(float(v[i]) for v in data.values()) for i in range(4000)], list(data))
    got = {r["column"]: r["distribution_type"] for r in distribution.identify_distribution(df).collect()}
    assert got["normal"] == "normal" and got["uniform"] == "uniform" and got["exponential"] in ("exponential", "gamma")


def test_forest_marks_the_far_values(spark):
    values = [float(i % 50) for i in range(2000)] + [10_000.0] * 5
    df = spark.createDataFrame(list(enumerate(values)), "id int, x double")
    row = distribution.outliers_isoforest(df, ["id"], ["x"]).first()
    assert row["has_outliers"] and 5 <= row["n_outliers"] <= 0.1 * len(values) + 1
    few = distribution.outliers_isoforest(df.limit(9), ["id"], ["x"]).first()
    assert not few["has_outliers"]


@pytest.mark.parametrize("method", ["zscore", "minmax", "robust", "log10", "decimal"])
def test_scaling_and_back(spark, method):
    df = spark.createDataFrame([(i, float(i * i - 20)) for i in range(30)] + [(99, None)], "id int, x double")
    model = scale.fit_scale(df, method, ["x"])
    done = model.transform(df)
    back = {r["id"]: r["x"] for r in model.inverse(done).collect()}
    assert back[99] is None and all(back[i] == pytest.approx(i * i - 20) for i in range(30))


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 4.0), (3, None)], "id int, x double")
    assert [r["x"] for r in scale.normalize(df, "minmax", ["x"])[0].orderBy("id").collect()] == [0.0, 0.0, None]
    assert [r["x"] for r in scale.normalize(df, "zscore", ["x"])[0].collect()] == [None] * 3
    assert distribution.spatial_correlation(df, ["x"]).first()["spatial_correlation"] == 0.0


@pytest.mark.parametrize("method", power.METHODS)
def test_transforms_and_back(spark, method):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.lognormal(1, 0.6, 500))] + [(-1, None)], "id int, x double")
    done, model = power.fit_transform(df, method, ["x"])
    assert done.columns == df.columns and done.filter("id = -1").first()["x"] is None
    old, new = ({r["id"]: r["x"] for r in t.collect()} for t in (df, power.inverse_transform(done, model)))
    assert all(new[i] == pytest.approx(old[i], rel=1e-4) for i in range(500))
    if method in ("yeo-johnson", "box-cox", "quantile_normal"):
        assert abs(done.agg(F.avg("x")).first()[0]) < 0.05


def test_rules_in_a_circle(spark):
    spec = {"one": {"type": "AttrRelation", "source": ["a"], "target": ["b"]}, "two": {"type": "AttrRelation", "source": ["b"], "target": ["a"]}}
    rows = [(i, "p", "q") for i in range(6)] + [(6, "p", "x"), (7, "r", "q")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    done = rules.clean_rules(df, rules.expand_rules(spec))
    fixed = {r["id"]: (r["a"], r["b"]) for r in rules.repaired_table(done).collect()}
    assert set(fixed.values()) == {("p", "q")}
    log = {(r["id"], r["column"], r["old"], r["new"], r["cleaner"]) for r in rules.repair_log(done, ["id"]).collect()}
    assert log == {(6, "b", "x", "q", "one"), (7, "a", "r", "p", "two")}


def test_rule_lists(spark):
    spec = {
        "c1": {"type": "Date", "attr": ["t"], "format": "%I%M%P"},
        "c2": {"type": "AttrRelation", "source": ["fname", "lname"], "target": ["gender"]},
    }
    assert [(r.name, r.source, r.attr) for r in rules.expand_rules(spec)] == [("c1", "", "t"), ("c2", "fname", "gender"), ("c2", "lname", "gender")]
    rows = rules.rule_catalog(spark, spec, {"Date": "single"}).collect()
    assert [tuple(r) for r in rows] == [("Date_c1", "single", "attr:t\nformat:%I%M%P"), ("AttrRelation_c2", "unknown", "source:fname,lname\ntarget:gender")]
    chain = [rules.Rule("n2", "AttrRelation", "c", source="b"), rules.Rule("n1", "AttrRelation", "b", source="a")]
    assert [r.name for r in rules.ordered_rules(chain)[0]] == ["n1", "n2"]
    assert rules.rule_groups(rules.expand_rules(spec)) == {"c1": 1, "c2": 2}


def test_metric_quirks(spark):
    df = spark.createDataFrame([("yes", "yes"), ("yes", "no"), ("no", "no"), ("no", "no")], "gold string, pred string")
    row = metrics.task_metrics(df, "pred", "gold", "entity_matching").first()
    assert (row["precision"], row["recall"]) == (1.0, 0.5) and row["f1"] == pytest.approx(2 * 0.5 / 1.5)
    weak = spark.createDataFrame([(1, 1), (1, 0), (1, 0), (0, 1), (0, 1), (0, 1)], "g int, p int")
    row = metrics.binary_metrics(weak, "g", "p").first()
    assert row["f1"] == pytest.approx(2 * 0.25 / 3) and row["f1_standard"] > row["f1"]
    last = spark.createDataFrame([("yes", "thinking\n\nso: yes"), ("no", "yes\n\nmaybe")], "gold string, pred string")
    assert metrics.task_metrics(last, "pred", "gold", "error_detection").first()["accuracy"] == 0.5
    empty = metrics.task_metrics(df.limit(0), "pred", "gold", "entity_matching").first()
    assert empty["accuracy"] is None and empty["precision"] == 0.0


def test_files_and_splits(spark):
    folder = new_path(spark, "case")
    files.sink_csv(spark.createDataFrame([(1, "ant"), (2, "bee")], "id int, name string"), f"{folder}/tableA.csv")
    files.sink_csv(spark.createDataFrame([(7, "ant"), (8, None)], "id int, name string"), f"{folder}/tableB.csv")
    files.sink_csv(spark.createDataFrame([(1, 7, 1), (2, 8, 0)], "ltable_id int, rtable_id int, label int"), f"{folder}/train.csv")
    rows = {r["ltable_id"]: r for r in files.load_splits(spark, folder).collect()}
    assert rows[1]["text"] == "Product A is name: ant. Product B is name: ant. " and rows[1]["label_str"] == "Yes\n"
    assert rows[2]["text"] == "Product A is name: bee. Product B is name: nan. " and rows[2]["split"] == "train"
    assert {r["pos"] for r in files.read_data(spark, folder).collect()} == {0, 1}
    with pytest.raises(ValueError):
        files.load_splits(spark, f"{folder}/none")
    assert not files.validate_source(spark, f"{folder}/table.xlsx").first()["ok"]
    assert not files.validate_source(spark, f"{folder}/missing.csv").first()["ok"]
    assert files.validate_source(spark, f"{folder}/tableA.csv").first()["n_rows"] == 2
    inline = files.scan_inline(spark, [[1, "x"], [2, "y"]], ["a", "b"])
    path = files.sink_json_records(inline, f"{folder}/rows.json")
    assert files.scan_json(spark, path).count() == 2


def test_requests_and_preparation(spark, holed):
    assert run_request({"operation": "normalizer", "method": "minmax", "columns": []}, holed).columns == holed.columns
    assert run_request({"operation": "entity_matcher", "columns": ["row_id"]}, holed).count() == 5
    assert run_request({"operation": "imputer"}, holed).filter("numeric1 IS NULL").isEmpty()
    text_rows = [(str(i), None if i % 7 == 0 else f"{i % 13}", " " if i % 5 == 0 else "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(text_rows, "key string, amount string, kind string")
    done = prepare_table(df, "key", ["key"])
    assert all(r["missing_after"] == 0 for r in done.missing.collect()) and done.methods["kind"] == "most_frequent"
    assert dict(done.table.dtypes)["amount"] in ("double", "bigint") and done.table.count() == 60


def test_column_helpers(holed):
    assert drop_rename(holed, ["category", "nope"], {"numeric1": "n"}).columns == ["row_id", "n", "numeric2", "all_missing"]
    assert reorder_columns(holed, ["category"]).columns[0] == "category"
    assert common_columns(holed, holed.select("category", "row_id")) == ["row_id", "category"]
    assert select_by_type(holed, numeric=False).columns == ["category"]
    assert isinstance(blanks_to_null(holed).schema["category"].dataType, T.StringType)


def test_table_context_uses_other_columns(spark):
    rows = [(i, float(i % 40), None if i % 7 == 0 else 3.0 * (i % 40) + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    done, methods = smart.impute_smart(df, "id", ["id"], ["y"], context="table", outlier_methods=("z", "iqr"))
    got = {r["id"]: r for r in done.collect()}
    assert methods["y"] in ("knn", "iterative") and done.columns == df.columns
    assert all(abs(got[i]["y"] - (3.0 * (i % 40) + 1)) < 1.0 for i in range(0, 400, 7))


def test_character_references(spark):
    cases = {
        "No&#46; 5&#176;C": "No. 5°C", "&#x41;&#X42;": "AB", "&amp;#40;": "&#40;", "&lt;&eacute;&bogus;": "<é&bogus;",
        "&#99999999;&#0;&#xD800;": "&#99999999;&#0;&#xD800;", "&#128512;": "\U0001f600", "plain & simple": "plain & simple",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.d for r in df.select("t", text.decode_references("t").alias("d")).collect()}
    assert got == cases | {None: None}


def test_circular_rules_run_until_nothing_changes(spark):
    # Each round repairs one more link of the chain k0 -> k1 -> k2 -> k3, whose rules stand in the worst order.
    n = 4
    rows = [(i, *["good"] * n) for i in range(2)] + [(9, "good", *["bad"] * (n - 1))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"k{i} string" for i in range(n)))
    order = [rules.Rule(f"r{i}", "AttrRelation", f"k{i + 1}", source=f"k{i}") for i in reversed(range(n - 1))]
    order.append(rules.Rule("back", "AttrRelation", "k0", source=f"k{n - 1}"))
    done = rules.clean_rules(df, order).collect()
    assert all(r[f"k{i}"] == "good" for r in done for i in range(n))


def test_power_lambda_is_not_bounded(spark):
    u = np.random.default_rng(3).uniform(1, 2, 3000)
    near = power.fit_power(spark.createDataFrame([(float(v),) for v in u], "x double"), "box-cox").params["x"][0]
    far = power.fit_power(spark.createDataFrame([(float(v**0.05),) for v in u], "x double"), "box-cox").params["x"][0]
    assert far > 5 and far == pytest.approx(near / 0.05, rel=0.02)


def test_imputation_of_seventy_columns_with_holes(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 3))
    full = base @ rng.normal(size=(3, 70)) + 0.01 * rng.normal(size=(60, 70))
    holes = rng.random(full.shape) < 0.05
    rows = [(i, *[None if h else float(v) for v, h in zip(x, m)]) for i, (x, m) in enumerate(zip(full, holes))]
    names = [f"c{i}" for i in range(70)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names))
    done = np.array([list(r)[1:] for r in impute.impute_iterative(df, names, rounds=2).orderBy("id").collect()])
    assert np.isfinite(done).all() and np.array_equal(done[~holes], full[~holes])
    assert np.abs(done - full)[holes].mean() < 0.5 * np.abs(full - full.mean(0))[holes].mean()


def test_chained_regressions_by_passes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    x[:, 2] += x[:, 0] - x[:, 1]
    df = spark.createDataFrame([tuple(float(v) if rng.random() > 0.2 else None for v in r) for r in x], "a double, b double, c double")
    few, many = (impute.fit_iterative(df, ["a", "b", "c"], max_patterns=m).steps for m in (1000, 1))
    assert len(few) == len(many)
    for p, q in zip(few, many):
        assert p[0] == q[0] and p[1] == pytest.approx(q[1], abs=1e-9) and p[2] == pytest.approx(q[2], abs=1e-9)
