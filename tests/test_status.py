"""Task statuses of a stream: batches, repeats, late events, restarts and timers."""

import datetime as dt

from lexgraph.plans.corpus import ROCKS
from lexgraph.streaming import status

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "event_id string, task_id string, kind string, at timestamp, units long, error string"


def test_statuses(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    put = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    watch = status.Progress()
    spark.streams.addListener(watch)

    def run():
        stream = status.statuses(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "1 hour", "10 minutes")
        stream.writeStream.queryName("tasks").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        rows = status.latest(spark.read.parquet(str(tmp_path / "out"))).collect()
        return {r.task_id: (r.status, r.successful_units, r.failed_units, r.error) for r in rows}

    put(("1", "a", "submitted", at(0), 0, None), ("2", "b", "submitted", at(1), 0, None), ("3", "c", "submitted", at(2), None, None), (None, "z", "submitted", at(0), 0, None), ("9", None, "submitted", at(0), 0, None))
    assert run() == {"a": ("pending", 0, 0, None), "b": ("pending", 0, 0, None), "c": ("pending", 0, 0, None)}
    put(("4", "a", "started", at(3), 0, None), ("5", "a", "succeeded", at(4), 40, None), ("5", "a", "succeeded", at(4), 40, None), ("6", "b", "broken", at(5), 0, "no file"))
    assert run() == {"a": ("processing", 40, 0, None), "b": ("failed", 0, 0, "no file"), "c": ("pending", 0, 0, None)}
    put(("5", "a", "succeeded", at(4), 40, None), ("7", "a", "failed_units", at(6), 10, None), ("8", "a", "finished", at(7), 0, None), ("10", "b", "finished", at(8), 0, None))  # a repeat in a later batch; an end after the end
    assert run() == {"a": ("completed", 40, 10, None), "b": ("failed", 0, 0, "no file"), "c": ("pending", 0, 0, None)}
    put(("11", "d", "submitted", at(200), 0, None))  # time goes on: c has said nothing for more than an hour
    got = run()
    assert got["c"] == ("failed", 0, 0, status.SILENT) and got["d"] == ("pending", 0, 0, None) and got["a"] == ("completed", 40, 10, None)
    put(("12", "a", "succeeded", at(201), 5, None))  # counted after the end
    assert run()["a"] == ("completed", 45, 10, None)
    versions = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("task_id", "version").collect()]
    assert len(set(versions)) == len(versions)
    spark.streams.removeListener(watch)
    assert watch.rows.get("tasks", 0) >= 12
