"""Event windows, run over a table as over a stream: the same functions serve both."""

from __future__ import annotations

from lectern.plans.base import query, table
from lectern.streaming import windows


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events").withColumn("ts", _utc("ts")), "ts", "1 hour", "1 day", ["event_type"], "value")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '6 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events").withColumn("ts", _utc("ts")), "ts", "6 hours", "1 day", ["user_id"])


def _utc(column):
    """Times without a zone are read as those of the session, which is UTC."""
    from pyspark.sql import functions as F

    return F.col(column).cast("timestamp")
