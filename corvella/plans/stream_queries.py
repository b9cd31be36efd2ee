"""Extension: window queries on events, as batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvella.streaming import windows as S

from .registry import query


@query("events", oracle="SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_tumbling_window(events):
    return S.tumbling(events, "ts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query("events", oracle="""
WITH d AS (SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS day FROM events, range(7) t(k))
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM d GROUP BY 1""")
def ext_sliding_window(events):
    return S.sliding(events, "ts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@query("events", oracle="""
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session_window(events):
    return S.sessions(events, "ts").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
