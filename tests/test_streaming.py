from __future__ import annotations

from datetime import datetime, timedelta

from hiregrid.streaming import checks as S

SCHEMA = "id long, entity_id long, source string, status string, jobs_found long, checked_at timestamp"


def rows(n):
    t = datetime(2024, 1, 1)
    return [(i, i % 3, "ab"[i % 2], ["success", "zero", "error"][i % 3], i, t + timedelta(hours=5 * i)) for i in range(n)]


def write(spark, path, data, parts=1):
    spark.createDataFrame(data, SCHEMA).coalesce(parts).write.mode("append").parquet(path)


def drain(spark, df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_and_repeats(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, rows(24) + rows(4))
    stream = S.read_checks(spark, path, spark.createDataFrame([], SCHEMA).schema)
    assert len(drain(spark, S.without_repeats(stream), "once", "append")) == 24
    got = drain(spark, S.health_windows(S.read_checks(spark, path, stream.schema)), "windows")
    assert sum(r.checks for r in got) == 28 and sum(r.errors for r in got) == 8 + 1
    assert {(r.end - r.start) for r in got} == {timedelta(days=1)}


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "in")
    write(spark, path, [(0, 1, "a", "success", 1, datetime(2024, 1, 1, 0)), (1, 1, "a", "success", 2, datetime(2024, 1, 1, 5)), (2, 1, "a", "success", 3, datetime(2024, 1, 2, 0))])
    got = drain(spark, S.check_sessions(S.read_checks(spark, path, spark.createDataFrame([], SCHEMA).schema)), "sessions")
    assert sorted((r.checks, r.most_jobs) for r in got) == [(1, 3), (2, 2)]


def test_latest_state_by_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    data = rows(12)
    for i in range(0, 12, 4):
        write(spark, path, data[i : i + 4])
    stream = S.read_checks(spark, path, spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    q = S.keep_latest_state(stream, out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir())
    got = {(r.entity_id, r.source): r.id for r in spark.read.parquet(f"{out}/v={last}").collect()}
    want = {}
    for i, e, s, *_ in data:
        want[e, s] = i
    assert got == want and last == 2
