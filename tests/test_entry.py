from textloom.plans import catalogue


def test_registered_sql_belongs_to_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_search_lines_are_bounded_and_ordered(spark):
    rows = catalogue.queries()["search_lines"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) <= 50 and [(r["doc_id"], r["line"]) for r in rows] == sorted((r["doc_id"], r["line"]) for r in rows)
