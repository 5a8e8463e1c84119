import __spark_entry__

FORBIDDEN = ("fraud", "scam", "risk_score", "probability", "danger", "verdict")


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert not any(t in c for c in df.columns for t in FORBIDDEN)
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q)
