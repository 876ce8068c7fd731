import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40
