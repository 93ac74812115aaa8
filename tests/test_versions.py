"""Versioned tables: what a reader sees during and after a change, and compaction."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from clientele.operators.sessionize import session_table
from clientele.sources import versions
from clientele.streaming import daily

SF_DIR = "/root/testdata/sf0.001"


def values(df):
    return sorted(r.v for r in df.collect())


def days(spark, *rows):
    return spark.createDataFrame(rows, "d string, v int").select(
        F.to_timestamp("d").alias("session_day"), "v", F.trunc(F.to_date("d"), "YEAR").alias("session_date"))


def test_a_reader_keeps_its_version_and_the_next_one_sees_the_new_days(spark, tmp_path):
    path = str(tmp_path / "t")
    first = days(spark, ("2000-01-01", 1), ("2000-06-01", 2), ("2001-01-01", 3), (None, 4))
    versions.replace_days(first, path, "session_date")
    before = versions.read(spark, path, first.schema)
    for _ in range(2):
        versions.replace_days(days(spark, ("2000-06-01", 9), (None, 5)), path, "session_date")
        assert values(versions.read(spark, path, first.schema)) == [1, 3, 5, 9]
    assert values(before) == [1, 2, 3, 4]
    assert versions.replace_days(first.limit(0), path, "session_date").number == 2
    read = versions.read(spark, path, first.schema).where("session_date = '2001-01-01'")
    assert values(read) == [3]
    assert "PartitionFilters: [isnotnull(session_date" in read._jdf.queryExecution().executedPlan().toString()


def test_a_change_that_is_broken_off_leaves_the_old_days(spark, tmp_path, monkeypatch):
    path, first = str(tmp_path / "t"), days(spark, ("2000-01-01", 1), ("2000-06-01", 2))
    versions.replace_days(first, path, "session_date")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        versions.replace_days(days(spark, ("2000-06-01", 9)), path, "session_date")
    monkeypatch.undo()
    assert values(versions.read(spark, path, first.schema)) == [1, 2]
    versions.replace_days(days(spark, ("2000-06-01", 9)), path, "session_date")
    assert values(versions.read(spark, path, first.schema)) == [1, 9]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    path, first = str(tmp_path / "t"), days(spark, ("2000-01-01", 1))
    versions.replace_days(first, path, "session_date")
    base = versions.current(spark, path)
    versions.replace_days(days(spark, ("2000-01-01", 2)), path, "session_date")
    with pytest.raises(Exception, match="[Ee]xists"):
        versions.commit(spark, path, base, base.folders)
    assert values(versions.read(spark, path, first.schema)) == [2]
    assert versions.versions(spark, path) == [0, 1]


def test_empty_tables_and_wrong_periods(spark, tmp_path):
    path, none = str(tmp_path / "t"), days(spark).limit(0)
    versions.replace_days(none, path, "session_date")
    assert values(versions.read(spark, path, none.schema)) == []
    with pytest.raises(ValueError):
        versions.replace_days(none.withColumn("session_date", F.lit("x")), path, "session_date")
    with pytest.raises(ValueError):
        versions.add_run(none, path, 0, fan_in=1)


def test_runs_stay_few_and_a_repeated_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = lambda runs: runs.groupBy("k").agg(F.sum("v").alias("v"))
    for n in range(14):
        rows = spark.createDataFrame([("a", 1), ("b", n)], "k string, v long")
        for _ in range(2):
            state = versions.add_run(rows, path, n, merge, fan_in=3, keep=2)
        levels = [f.level for f in state.folders]
        assert all(levels.count(level) < 3 for level in levels)
    # 14 = 1 * 9 + 1 * 3 + 2
    assert sorted(levels) == [0, 0, 1, 2]
    stored = merge(versions.read(spark, path, rows.schema))
    assert sorted(map(tuple, stored.collect())) == [("a", 14), ("b", sum(range(14)))]
    kept = {f.name for n in versions.versions(spark, path) for f in versions.load(spark, path, n).folders}
    assert {f"data/{n}" for n in os.listdir(f"{path}/data")} == kept and len(versions.versions(spark, path)) == 2


def test_compacted_sessions_are_those_of_the_batch_with_their_arrays(spark, tmp_path):
    raw = spark.read.parquet(f"{SF_DIR}/events.parquet").withColumn("user_id", F.col("user_id") % 3)
    source, out, fields = str(tmp_path / "in"), str(tmp_path / "out"), ["ts", "event_id", "value"]
    raw.repartition(4, "event_id").write.parquet(source)

    def run():
        return daily.run_batches(daily.read_events(spark, source, files_per_batch=1),
                                 lambda rows: daily.session_parts(rows, fields=fields), "s", out,
                                 merge=daily.merge_sessions, fan_in=2)

    columns = ["user_id", "session_start", "session_end", "n_events", "session"]
    merged, whole = daily.merge_sessions(run()).select(*columns), session_table(raw, fields=fields).select(*columns)
    assert merged.exceptAll(whole).count() == 0 and merged.count() == whole.count()
    assert daily.merge_sessions(run()).count() == whole.count()         # nothing new


def test_an_index_of_ids_stores_every_id_once_across_restarts(spark, tmp_path):
    """Copies in the same run, in a later run, out of order; a batch asks the state for its own rows only."""
    source, out = str(tmp_path / "in"), str(tmp_path / "log")
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").cache()
    asked = []

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            for state in event.progress.stateOperators:
                asked.append((event.progress.numInputRows, state.customMetrics["rocksdbGetCount"]))

        def onQueryTerminated(self, event):
            pass

    listener = Progress()
    spark.streams.addListener(listener)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = events.count()
    for n, (part, stored) in enumerate([("event_id % 2 = 0", None), ("true", rows), ("event_id % 100 = 7", rows)]):
        events.where(part).unionByName(events.where(part)).coalesce(1).write.mode("append").parquet(source)
        log = daily.read_events(spark, source).select(F.col("event_id").alias("id"), "ts")
        found = daily.indexed_sink(log, f"log{n}", out)
        assert found.count() == found.select("id").distinct().count()
        assert stored is None or found.count() == stored
    deadline = time.time() + 20
    while len([a for a in asked if a[0]]) < 3 and time.time() < deadline:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    came = [a for a in asked if a[0]]
    assert len(came) == 3 and all(gets <= 2 * number for number, gets in came)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
