"""Row mutations as a stream: a log of changes keeps the newest value of each kind for each key, in state that survives restarts.

The state of a key is one row, however many changes it had. A change counts if its number is larger than that of the last one of its
kind, so that late and repeated changes do no harm. A key without changes for the retention leaves the state by an event-time
timer; its last row has been written by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimlens.streaming.audit import feed, latest_result
from claimlens.sources.tables import table

LATEST = "user_id long, active string, role string, n_changes long, changed_at timestamp"
STATE = "active_no long, active string, role_no long, role string, n_changes long, changed_at timestamp"
RETENTION_DAYS = 90
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestWins(StatefulProcessor):
    """The newest value of each kind of a key, written again whenever a change counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.latest.get() if self.latest.exists() else (-1, None, -1, None, 0, None)
        active_no, active, role_no, role, n, at = held
        before = n
        for part in rows:
            for number, what, value, when in zip(part["event_id"], part["what"], part["value"], part["at"]):
                if what == "active" and number > active_no:
                    active_no, active, n = int(number), value, n + 1
                elif what == "role" and number > role_no:
                    role_no, role, n = int(number), value, n + 1
                at = when if at is None or when > pd.Timestamp(at, tz=when.tz) else at
        if n == before:
            return
        at = pd.Timestamp(at)
        self.latest.update((active_no, active, role_no, role, n, at.to_pydatetime()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(at.timestamp() * 1000) + RETENTION_DAYS * 86_400_000)
        yield pd.DataFrame({"user_id": [key[0]], "active": [active], "role": [role], "n_changes": [n], "changed_at": [at]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        return iter(())

    def close(self) -> None:
        pass


def change_log(events: DataFrame) -> DataFrame:
    """Events as changes: every third one switches a user on or off, the others give a role."""
    k = F.col("event_id")
    what = F.when(k % 3 == 0, "active").otherwise("role")
    value = F.when(k % 3 == 0, F.when(k % 2 == 0, "yes").otherwise("no")).when(k % 7 == 0, "admin").otherwise("user")
    return events.where("user_id is not null").select("user_id", "event_id", what.alias("what"), value.alias("value"), "at")


def latest_changes(changes: DataFrame) -> DataFrame:
    """The rows of keys that change, as a stream in update mode. State lies in RocksDB, which holds more keys than memory does."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return changes.groupBy("user_id").transformWithStateInPandas(statefulProcessor=LatestWins(), outputStructType=LATEST, outputMode="Update", timeMode="EventTime")


def stream_user_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by state and role after the log has run through as a stream; who has no change is active and has the role of a user."""
    newest = latest_result(latest_changes(change_log(feed(spark, sf_dir))), "user-changes", ["user_id"])
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(newest, "user_id", "left")
    return users.groupBy(F.coalesce("active", F.lit("yes")).alias("active"), F.coalesce("role", F.lit("user")).alias("role")).agg(F.count("*").alias("n"))


QUERIES = {"stream_user_changes": stream_user_changes}
ORACLES = {
    "stream_user_changes": """
        WITH l AS (SELECT user_id, arg_max(event_id % 2 = 0, event_id) FILTER (event_id % 3 = 0) AS a, arg_max(event_id % 7 = 0, event_id) FILTER (event_id % 3 <> 0) AS r FROM events GROUP BY 1)
        SELECT CASE WHEN coalesce(a, true) THEN 'yes' ELSE 'no' END AS active, CASE WHEN coalesce(r, false) THEN 'admin' ELSE 'user' END AS role, count(*) AS n FROM customer LEFT JOIN l ON user_id = c_custkey GROUP BY 1, 2""",
}
