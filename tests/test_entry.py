import __spark_entry__ as entry


def test_some_queries_build_and_run(spark):
    names = ["state_at", "authority_fold", "keyset_page", "typed_view", "map_rows"]
    queries = entry.queries()
    for name in names:
        df = queries[name](spark, "/root/testdata/sf0.001")
        assert df.columns and df.count() >= 0


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
