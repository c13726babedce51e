"""Silences against their SQL where the logs run past the end of the queries' windows."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["D13_silence_inputs", "D14_silence_alerts"])
def test_hits_past_the_window_count(spark, tmp_path, name):
    for table in os.listdir(DATA):
        if table != "events.parquet":
            os.symlink(f"{DATA}/{table}", tmp_path / table)
    events = spark.read.parquet(f"{DATA}/events.parquet")
    late = events.where("event_type <> 'error'").withColumn("event_id", F.col("event_id") + 400_000)  # more than the look-back later
    events.unionByName(late).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    connection = duckdb.connect()
    for table in os.listdir(tmp_path):
        path = tmp_path / table
        connection.execute(f"create view {table.split('.')[0]} as select * from '{path if path.is_file() else f'{path}/*.parquet'}'")
    found = entry.queries()[name](spark, str(tmp_path))
    want = connection.execute(f"select {', '.join(found.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
