"""Streams give the same rows in one batch, in many, and with files out of order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordweave.operators import telemetry
from recordweave.streaming import jobs

SCHEMA = "source_id bigint, at timestamp, seq bigint, failed boolean"
START = dt.datetime(2026, 1, 1)
ROWS = [(0 if i % 3 else 1 + i % 2, START + dt.timedelta(hours=5 * i), i, (i * 7) % 11 > 3 or i > 195) for i in range(200)]
ROWS += [(9, START, 500, False), (7, START + dt.timedelta(hours=1), 501, True)]
ORDERS = {"one": [[*range(6)]], "sorted": [[k] for k in range(6)], "newest_first": [[k] for k in range(5, -1, -1)]}


def land(spark, path, parts):
    size = -(-len(ROWS) // 6)
    for part in parts:
        rows = [r for k in part for r in ROWS[k * size : (k + 1) * size]]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return jobs.read_stream(spark, f"{path}/*.parquet", spark.read.parquet(path).schema, files_per_trigger=1)


@pytest.fixture(params=sorted(ORDERS))
def landed(spark, tmp_path, request):
    path = str(tmp_path / "runs")
    land(spark, path, ORDERS[request.param])
    return path


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_every_job_equals_batch(spark, landed):
    table = spark.read.parquet(landed)
    assert table.count() == len(ROWS)
    want = telemetry.breaker_state(table, F.lit(START), threshold=2).select("source_id", "failures", "state", "opened_at")
    assert rows(jobs.breaker(stream(spark, landed), threshold=2)) == rows(want)
    assert rows(jobs.dedup(stream(spark, landed), ["source_id", "failed"], "at").select("source_id", "failed")) == rows(
        table.select("source_id", "failed").distinct()
    )
    volume = jobs.volume(stream(spark, landed), "source_id", "at", slide_days=7)
    assert volume.agg(F.sum("volume")).first()[0] == 7 * len(ROWS)
    assert jobs.volume(stream(spark, landed), "source_id", "at").agg(F.sum("volume")).first()[0] == len(ROWS)
    silent = {r.source_id for r in jobs.silence_alerts(stream(spark, landed), "source_id", "at").collect()}
    assert silent == {9, 7}


def test_the_next_call_reads_only_new_files(spark, tmp_path):
    path, root = str(tmp_path / "runs"), str(tmp_path / "root")
    land(spark, path, [[0, 1, 2]])
    first = jobs.dedup(stream(spark, path), ["seq"], "at", root=root).count()
    land(spark, path, [[2, 3], [4, 5]])
    out = jobs.dedup(stream(spark, path), ["seq"], "at", window_days=40, root=root)
    assert first == 102 and out.count() == len(ROWS) == out.select("seq").distinct().count()


def test_breaker_cools_down(spark, tmp_path):
    path = str(tmp_path / "runs")
    land(spark, path, [[*range(6)]])
    end = START + dt.timedelta(hours=5 * 199)
    state = lambda minutes: {r.source_id: r.state for r in jobs.breaker(stream(spark, path), 2, now=str(end + dt.timedelta(minutes=minutes))).collect()}
    assert state(29)[0] == "open" and state(31 + 300)[0] == "half_open" and state(0)[9] == "closed"


def test_momentum_batch_by_batch(spark, landed):
    themed = lambda df: df.withColumn("theme", F.col("source_id").cast("string"))
    want = telemetry.momentum(telemetry.daily_volume(themed(spark.read.parquet(landed)), at="at"))
    got = jobs.moves(themed(stream(spark, landed)), "theme", "at")
    assert rows(got.select(*want.columns)) == rows(want)


def test_momentum_of_an_empty_folder(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "runs"))
    empty = jobs.read_stream(spark, str(tmp_path / "nothing*"), SCHEMA).withColumn("theme", F.lit("a"))
    assert jobs.moves(empty, "theme", "at").count() == 0
