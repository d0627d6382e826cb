"""Every registered query of the library against its SQL, and the plans' shape."""

import pytest

from tesserae.plans.catalog import QUERIES, SQL

from .conftest import SMALL


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    if name not in SQL:
        assert got.columns
        got.count()
        return
    rows = duck.execute(SQL[name]).fetchall()
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(got.columns)
    mine = [tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect()]
    theirs = [tuple(map(plain, r)) for r in rows]
    assert sorted(map(repr, mine)) == sorted(map(repr, theirs))


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_llm():
    import re
    from pathlib import Path

    top = Path(__file__).resolve().parents[1] / "tesserae"
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["hist_buckets"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double>" in plan and "IsNotNull(o_totalprice)" in plan
