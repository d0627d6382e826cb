"""The feature registry on planted functions, and models that are trained, checked, saved and loaded."""

import math

import pytest
from pyspark.sql import functions as F

from tesserae.functions import features as f
from tesserae.operators import model


def vectors(spark, rows, schema):
    registry = f.registry()
    df = f.with_facts(spark.createDataFrame(rows, schema)).select(*[x.value.alias(x.name) for x in registry])
    return [r.asDict() for r in df.collect()]


def shown(row):
    return {k for k, x in row.items() if x}


def test_places_and_names(spark):
    registry = f.registry()
    assert len(registry) == len({x.name for x in registry}) == 224
    assert [x.name for x in registry[:4]] == ["fan_in", "fan_out", "call_depth", "is_cycle"]
    assert registry[-1].name == "has_parallel" and registry[16].name == "contains_use"
    assert len(f.names_hash([x.name for x in registry])) == 16


def test_a_function_without_facts_is_only_private(spark):
    assert [shown(r) for r in vectors(spark, [(1,)], "n int")] == [{"vis_private"}]
    assert [shown(r) for r in vectors(spark, [("", "", "", None)], "name string, file string, source string, params array<string>")] == [{"vis_private"}]


def test_planted_functions(spark):
    schema = "name string, file string, source string, is_public boolean, trait_impl string, container string, params array<string>, decorators array<string>, fan_in double"
    rust, hook, rails = vectors(spark, [
        ("fmt_self", "src/tests/a.rs", "fn f(&self) {\n  if x {\n  }\n}\n", True, "Display", "Display", ["&self"], None, 100.0),
        ("useState", "a.tsx", "x => y?", False, None, None, [], ["@Pytest.fixture"], 25.0),
        ("show", "a.rb", "def show\n render 1\n private", True, None, None, None, [], None),
    ], schema)
    assert {"has_receiver", "has_self", "type_and_trait_match", "is_rust_trait_impl", "is_override", "is_in_test_file", "has_borrow"} <= shown(rust)
    assert rust["fan_in"] == 1.0 and math.isclose(rust["cognitive_complexity"], 2 / 20) and math.isclose(rust["line_count"], 4 / 100) and math.isclose(rust["trait_name_length"], 7 / 20)
    assert {"is_react_hook", "has_closure", "has_question_mark", "has_decorator_pytest", "has_decorator_fixture", "starts_with_use"} <= shown(hook) and hook["fan_in"] == 0.5
    assert "is_react_component" not in shown(hook) and "is_rails_action" not in shown(rails)


@pytest.mark.parametrize("source, deepest", [("", 0), ("}\n}\n{", 1), ("{\n{\n}\n{\n{\n}", 3), ("{ }\n{ }", 0), (None, 0)])
def test_brace_depth(spark, source, deepest):
    assert spark.createDataFrame([(source,)], "s string").select(f.brace_depth(F.coalesce("s", F.lit("")))).first()[0] == deepest


def test_incompatible_registries(spark):
    a = spark.createDataFrame([(0, "x", "A"), (1, "y", "A")], "place int, name string, category string")
    b = spark.createDataFrame([(0, "x", "A"), (1, "y", "B"), (2, "z", "B")], "place int, name string, category string")
    assert f.incompatible(a, a).count() == 0
    assert sorted(map(tuple, f.incompatible(a, b).collect())) == [(1, "y:A", "y:B"), (2, None, "z:B")]


def test_train_save_load(spark, tmp_path):
    rows = spark.createDataFrame([(i, int(i % 10 > 4), float(i % 10), None if i % 7 == 0 else 1.0) for i in range(400)], "id long, y int, a double, b double")
    m = model.train(rows.filter("id < 200"), rows.filter("id >= 200").fillna(1.0), ["a", "b"], steps=30)
    assert model.problems(m) == ([], []) and 0.5 <= m["threshold"] <= 0.99 and m["figures"]["precision"] >= 0.9
    model.save(spark, m, str(tmp_path / "m"))
    again = model.load(spark, str(tmp_path / "m"), ["a", "b"])
    assert again == m
    p = {r.a: r.p for r in rows.fillna(1.0).select("a", model.score(again).alias("p")).collect()}
    assert p[9.0] > 0.5 > p[0.0]
    with pytest.raises(ValueError, match="features differ"):
        model.load(spark, str(tmp_path / "m"), ["a", "c"])


def test_train_without_validation_keeps_the_default(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (2, 0, 0.0)], "id long, y int, a double")
    assert model.train(rows, None, ["a"], steps=2)["threshold"] == model.THRESHOLD
    empty = model.train(rows.limit(0), rows.limit(0), ["a"], steps=2)
    assert empty["weights"] == [0.0] and empty["temperature"] == 1.0 and "no examples are recorded" in model.problems(empty)[1]


def test_legacy_model_and_unfit_ones(spark, tmp_path):
    spark.createDataFrame([('{"weights": [1.0, 2.0], "bias": 0.5}',)], "value string").coalesce(1).write.text(str(tmp_path / "old"))
    old = model.load(spark, str(tmp_path / "old"), ["a", "b"])
    assert old["features"] == ["a", "b"] and old["threshold"] == 0.92 and "model has no version" in model.problems(old)[1]
    bad = old | {"weights": [math.nan], "temperature": 0.0, "bias": math.inf}
    assert len(model.problems(bad)[0]) == 4


def test_feature_gaps(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 1, [3.0, 0.0]), ("a", 0, [0.0, 4.0]), ("b", 1, [5.0, 5.0])], "g string, y int, v array<double>")
    got = sorted(map(tuple, model.feature_gaps(df, ["g"], "y", "v", ["p", "q"]).collect()))
    assert got == [("a", "p", 2.0, 0.0), ("a", "q", 0.0, 4.0), ("b", "p", 5.0, None), ("b", "q", 5.0, None)]
    assert model.feature_gaps(df.limit(0), ["g"], "y", "v", ["p", "q"]).count() == 0
