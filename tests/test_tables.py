import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_funnel import events

from stepwell.plans import queries, rebuild
from stepwell.sources.events import read_log, read_store
from stepwell.streaming import bronze

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    tidy = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_rebuild_is_idempotent_and_clears_emptied_days(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bronze", "silver", "gold")]
    rebuild.append_bronze(events(spark, [("u", "vpv", "18 09:00"), ("u", "signup", "19 23:30")]), paths[0])
    config = rebuild.RebuildConfig("2026-08-18", "2026-08-19", "v1")
    first = sorted(map(tuple, rebuild.rebuild(spark, *paths, config, "2026-08-20 00:00:00").collect()), key=str)
    again = sorted(map(tuple, rebuild.rebuild(spark, *paths, config, "2026-08-20 00:00:00").collect()), key=str)
    assert first == again and len(first) == 2
    rebuild.overwrite_days(spark.read.parquet(paths[2]).where("event_date = date'2026-08-18'"), str(tmp_path / "copy"), "2026-08-18", "2026-08-19")
    rebuild.overwrite_days(spark.read.parquet(str(tmp_path / "copy")).limit(0), paths[2], "2026-08-19", "2026-08-19")
    assert [str(r[0]) for r in spark.read.parquet(paths[2]).select("event_date").distinct().collect()] == ["2026-08-18"]
    rebuild.publish(spark.read.parquet(paths[2]).withColumn("event_date", F.col("event_date")), str(tmp_path / "serving"), "2026-08-18", "v1")
    assert spark.read.parquet(str(tmp_path / "serving")).count() == 1
    with pytest.raises(ValueError):
        rebuild.RebuildConfig("2026-08-19", "2026-08-18", "v1")
    assert rebuild.days_of_interval("2026-08-18T23:15", "2026-08-19T00:15") == ["2026-08-18", "2026-08-19"]


def test_logs_and_stores(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a\n\nb\nc\n")
    assert [tuple(r) for r in read_log(spark, str(tmp_path / "log.txt"), 1).collect()] == [(2, "b"), (3, "c")]
    with pytest.raises(ValueError):
        read_log(spark, str(tmp_path / "log.txt"), -1)
    os.mkdir(tmp_path / "store")
    (tmp_path / "store" / "demo.ndjson").write_text('{"event_id":"e1"}\n{"event_id":"e1"}\n')
    with pytest.raises(ValueError):
        read_store(spark, str(tmp_path / "store"))


def test_stream_keeps_late_events_and_drops_replays(spark, tmp_path):
    rows = bronze.to_records(events(spark, [("u", "vpv", "18 09:00")]))
    late = bronze.to_records(events(spark, [("u", "vpv", "18 09:00"), ("u", "signup", "10 09:00")]))
    for batch in (rows, late):
        batch.write.mode("append").json(str(tmp_path / "log"))
        bronze.ingest_stream(bronze.read_records(spark, str(tmp_path / "log")), *[str(tmp_path / n) for n in ("bronze", "dead", "checkpoint")])
    assert spark.read.parquet(str(tmp_path / "bronze")).count() == 2
