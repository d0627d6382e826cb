"""Texts about functions, types and layers, and single decisions on a ledger, on small frames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.functions import lines as li
from tesserae.operators import report, state


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def strings(*values):
    return F.array(*map(F.lit, values)).cast("array<string>")


def test_compressed_function(spark):
    none = F.lit(None).cast("string")
    got = one(spark, li.compressed_function(F.lit("f"), F.lit("src/a/b.rs"), F.lit(7), F.lit(0.71), F.lit(True), F.lit("One\nTwo"), strings("x"), strings(), strings("g", "h")))
    assert got == "ƒ f 🔥 ∂\n  One\n  📍 b.rs:7\n  📥 x\n  📞 g → h\n\n"
    assert one(spark, li.compressed_function(F.lit("f"), F.lit("b.rs"), F.lit(7), F.lit(0.3), F.lit(False), none, strings(), strings("R"), strings())) == "ƒ f\n  📍 b.rs:7\n  📤 R\n\n"


def test_context_without_neighbours(spark):
    none = F.lit(None).cast("array<string>")
    got = one(spark, li.function_context(F.lit("a"), F.lit(1), F.lit(True), F.lit(False), F.lit(2.5), none, none, F.lit(None).cast("string"), none, strings("c")))
    assert got == "- File: a\n- Line: 1\n- Public: true\n- Async: false\n- Complexity: 2.50\n- Called by:\n  - c\n"


@pytest.mark.parametrize("text, names", [("HashMap<String, Vec<Order_2>>", ["HashMap", "Order_2", "Vec"]), ("&'a mut [u8; 16]", ["a"]), ("", []), ("Order, Order", ["Order"])])
def test_type_names(spark, text, names):
    assert one(spark, li.type_names(F.lit(text))) == names


def test_overlaps(spark):
    assert one(spark, li.callee_overlap(strings(), strings())) == 0 and one(spark, li.callee_overlap(strings("a", "b"), strings("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, li.return_overlap(strings(), strings())) == 1 and one(spark, li.return_overlap(strings("a"), strings())) == 0 and one(spark, li.return_overlap(strings("a", "a"), strings("a"))) == 1


@pytest.mark.parametrize("commit, known, seconds", [("1700000000", None, 1700000000), ("123", 5, 123), ("a" * 40, 9, 9), ("1" * 40, 9, 9), ("a" * 40, None, None), ("zz", 9, None), (None, 9, None), ("", 9, None)])
def test_commit_time(spark, commit, known, seconds):
    df = spark.createDataFrame([(commit, known)], "c string, k long")
    assert df.select(li.commit_time(F.col("c"), F.col("k"))).first()[0] == seconds


def test_chunk_size(spark):
    assert [one(spark, li.chunk_size(F.lit(n), 4)) for n in (0, 7, 80, 10**6)] == [1, 1, 10, 1000]


def test_layers_take_the_greatest(spark):
    f = spark.createDataFrame([("core", f"f{i}", i, float(i % 3)) for i in range(9)] + [("odd", "g", 100, 0.0)], "layer string, name string, node long, i double")
    got = {r.layer: r for r in report.layers(f, F.col("i")).collect()}
    assert got["core"].top == "f2, f5, f8" and got["core"].n == 9 and got["core"].colour == "#475569" and got["odd"].description == "Code under the `odd` module"
    h = 5381
    for b in b"odd":
        h = (h * 33 + b) % 2**32
    assert got["odd"].colour == f"hsl({h % 360}, 70%, 54%)"
    assert report.layers(f.limit(0), F.col("i")).count() == 0


def test_one_decision(spark):
    ledger = spark.createDataFrame([(3, "ab", "Pending", None, None, 0.5), (1, "ab", "Kept", "x", None, 0.5), (2, "xaby", "Pending", None, None, 0.9), (4, None, "Pending", None, None, 0.1)], "id long, name string, outcome string, notes string, outcome_date timestamp, confidence double")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = {r.id: (r.outcome, r.notes, r.outcome_date) for r in state.resolve_first(ledger, "ab", True, None, at).collect()}
    assert got == {1: ("Kept", "x", None), 2: ("Removed", "Removed by developer", datetime(2024, 1, 1)), 3: ("Pending", None, None), 4: ("Pending", None, None)}
    kept = state.resolve_first(ledger, "ab", False, "a false positive", at)
    assert [(r.id, r.label) for r in state.examples(kept).collect()] == [(2, "Alive")]
    assert sorted(map(tuple, state.resolve_first(ledger, "none", True, None, at).collect()), key=repr) == sorted(map(tuple, ledger.collect()), key=repr)
    assert state.resolve_first(ledger.limit(0), "ab", True, None, at).count() == 0


def test_commands_decide(spark, tmp_path, capsys):
    from tesserae import __main__ as commands

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "l.json").write_text('{"id": "1", "function_name": "go"}\n{"id": "2", "function_name": "gone", "outcome": "Removed"}\n')
    read = lambda n: {r.id: (r.function_name, r.outcome, r.notes, r.removed_commit) for r in commands.files.ledger(spark, str(tmp_path / n)).collect()}
    assert commands.decide(spark, str(tmp_path / "in"), "go", True, "c1", str(tmp_path / "a")) == 0
    assert read("a") == {"1": ("go", "Removed", "Removed by developer", "c1"), "2": ("gone", "Removed", None, None)}
    assert commands.decide(spark, str(tmp_path / "a"), "go", False, "x", str(tmp_path / "b")) == 1 and read("b") == read("a")
    assert commands.decide(spark, str(tmp_path / "a"), None, False, "x", None) == 2
