import __spark_entry__ as entry


def test_every_query_of_the_core_has_a_name_once_and_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source1_entity_id", "matched_entity_ids"] and df.count() > 0
