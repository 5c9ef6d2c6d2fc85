import __spark_entry__ as driver


def test_every_query_has_a_callable_and_sql_names_a_query(spark):
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert driver.entry(spark).columns == ["doc_id", "text"]
