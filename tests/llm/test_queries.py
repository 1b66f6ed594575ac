from attesta.llm import queries


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry_registers_all(spark):
    import __spark_entry__ as entry

    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
