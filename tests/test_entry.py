import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "conv_id", "turn", "combined", "score", "rank"]
    assert 0 < df.count() <= 400
