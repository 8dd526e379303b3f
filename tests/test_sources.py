"""The row checks and the replay, over rows as queries pass them."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__ as entry
from skein.sources import replay
from tools.compare import normal

EVENTS = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string"


def events(spark, path, values):
    """An events table of a row each value, a second apart."""
    rows = [(i, i % 5, "error" if i % 3 == 0 else "view", v, datetime(2026, 1, 1) + timedelta(seconds=i // 2), f'{{"k": {i % 7}}}') for i, v in enumerate(values)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def by_sql(path, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    return normal(con.sql(entry.oracle_sql()[name]).df())


def test_validation_names_the_bad_rows(spark, tmp_path):
    sf = events(spark, tmp_path, [5.0, 0.0, -1.0, 2.5, 7.0])
    got = entry.queries()["validate_transactions"](spark, sf).toPandas()
    assert normal(got).equals(by_sql(sf, "validate_transactions"))
    assert got["problem"].notna().sum() == 2


def test_replay_is_the_first_valid_rows(spark, tmp_path):
    sf = events(spark, tmp_path, [-1.0 if i % 4 == 1 else 1.0 + i for i in range(700)])
    got = entry.queries()["replay_source"](spark, sf).toPandas()
    assert len(got) == 500 and normal(got).equals(by_sql(sf, "replay_source"))


def test_replay_keeps_the_first_valid_row_of_a_repeated_id(spark):
    names = "transaction_id, timestamp, merchant_id, card_fingerprint, bin, amount, device_fingerprint, ip_signature, auth_outcome, ts_us, label, more".split(", ")
    row = lambda i, amount, us: (i, datetime(2026, 1, 1) + timedelta(microseconds=us), "M", "C", "400001", amount, "D", "I", "approved", us, 1, "x")
    tx = spark.createDataFrame([row("A", -1.0, 1), row("A", 2.0, 5), row("A", 3.0, 9), row("B", 1.0, 3), row("C", float("nan"), 2), row(" ", 1.0, 4)], names)
    assert [tuple(r) for r in replay.replay(tx).orderBy("cursor").collect()] == [("B", 3, 1), ("A", 5, 2)]
    assert [r["transaction_id"] for r in replay.replay(tx, 1).collect()] == ["B"]
