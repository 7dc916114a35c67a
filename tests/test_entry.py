import __spark_entry__ as entry


def test_every_graph_query_has_sql():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {k for k in q if not (k.startswith("op") and k[2].isdigit()) and k != "pipeline"} <= set(sql)


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["id", "q"] and got.count() == 1500
