import pytest

from leafmill.plans import registry
from oracle import same


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, data, name):
    same(registry.QUERIES[name], registry.SQL[name], spark, data)


def test_pictures_are_png(spark, data):
    rows = registry.QUERIES["ink_pictures"](spark, data).collect()
    assert rows and all(r["kind"] == "png" for r in rows)


def test_entry(spark, data):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if data == "/root/testdata/sf0.001":
        assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_text_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in (root / "leafmill").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "leafmill.llm" not in path.read_text()
