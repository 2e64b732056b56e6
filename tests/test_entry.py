import importlib


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    names, sql = entry.queries(), entry.oracle_sql()
    assert {"p1_found", "p5_found", "p6_found"} <= names.keys()
    assert sql.keys() <= names.keys()
    assert entry.entry(spark).count() > 0
