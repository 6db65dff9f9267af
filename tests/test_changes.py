"""The log of changes as a stream: replays, restarts, late and repeated changes give the rows of the batch; ingest in files of bounded rows."""

import datetime
import random

from pyspark.sql import functions as F

from claimlens.streaming import audit, changes

DAY = datetime.datetime(2024, 1, 1)


def write(spark, folder, rows):
    df = spark.createDataFrame(rows, audit.EVENTS).coalesce(1)
    df.write.mode("append").parquet(folder)


def run(spark, folder, path):
    log = changes.change_log(audit.feed(spark, folder, "*.parquet"))
    return {r.user_id: (r.active, r.role) for r in audit.latest_result(changes.latest_changes(log), "changes", ["user_id"], path).collect()}


def plain(rows):
    out = {}
    for e in sorted(rows, key=lambda r: r[0]):
        if e[2] is not None:
            active, role = out.get(e[2], (None, None))
            out[e[2]] = ("yes" if e[0] % 2 == 0 else "no", role) if e[0] % 3 == 0 else (active, "admin" if e[0] % 7 == 0 else "user")
    return out


def test_restarts_late_and_repeated_changes(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, DAY + datetime.timedelta(minutes=i), r.choice([1, 2, 3, 4, None]), "t", 1.0, "{}") for i in range(120)]
    r.shuffle(rows)  # later numbers come first
    folder, path = str(tmp_path / "feed"), str(tmp_path / "out")
    write(spark, folder, rows[:50])
    assert run(spark, folder, path) == plain(rows[:50])
    write(spark, folder, rows[50:90] + rows[:10])  # after a restart, with repeated ones
    assert run(spark, folder, path) == plain(rows[:90])
    write(spark, folder, rows[90:])
    assert run(spark, folder, path) == plain(rows)
    assert run(spark, folder, path) == plain(rows)  # nothing new
    assert run(spark, folder, str(tmp_path / "replayed")) == plain(rows)


def test_ingest_by_rows_and_batches(spark, tmp_path):
    folder, path, state = (str(tmp_path / x) for x in ("feed", "table", "state"))
    write(spark, folder, [(i, DAY, 1, "t", 1.0, "x" * 600) for i in range(250)])
    audit.ingest(audit.feed(spark, folder, "*.parquet"), path, state).awaitTermination()
    write(spark, folder, [(i, DAY, 1, "t", 1.0, None) for i in range(250, 260)])
    audit.ingest(audit.feed(spark, folder, "*.parquet"), path, state).awaitTermination()
    rows = spark.read.parquet(path)
    assert sorted(r.event_id for r in rows.collect()) == list(range(260)) and rows.agg(F.max(F.length("props"))).first()[0] == 500
    assert rows.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= audit.FLUSH_ROWS
    batches = rows.groupBy("batch").agg(F.countDistinct("flushed_at").alias("n"), F.min("flushed_at").alias("at")).orderBy("batch").collect()
    assert [b.n for b in batches] == [1, 1] and batches[0].at < batches[1].at
    assert rows.where("flushed_at is null or ts <> timestamp_ntz'2024-01-01'").count() == 0
