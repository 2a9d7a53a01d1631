"""Queries of streams, held against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.plans.registry import Tables, query
from strandflow.streaming import streams as S


def _events(t: Tables) -> DataFrame:
    return S.source(t.spark, f"{t.sf_dir}/events.parquet")


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query("stream_cm", "SELECT user_id % 4 AS ref, event_id % 4 AS pred, count(*) AS n FROM events GROUP BY ALL")
def stream_cm(t: Tables) -> DataFrame:
    rows = _events(t).select((F.col("user_id") % 4).alias("r"), (F.col("event_id") % 4).alias("p"))
    return S.drain(S.confusion(rows, "r", "p"))


@query("tumbling_window", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS \"start\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(t: Tables) -> DataFrame:
    return S.drain(S.windowed(_events(t), ["event_type"], "1 hour")).select(_stamp("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "sliding_window_events",
    """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS s, event_type, value FROM events, (VALUES (0), (1)) x(k))
    SELECT strftime(s, '%Y-%m-%d %H:%M') AS "start", event_type, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL""",
)
def sliding_window_events(t: Tables) -> DataFrame:
    return S.drain(S.windowed(_events(t), ["event_type"], "1 hour", "30 minutes")).select(_stamp("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    "session_islands",
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS "start", count(*) AS n FROM k GROUP BY user_id, k""",
)
def session_islands(t: Tables) -> DataFrame:
    return S.drain(S.sessions(_events(t), ["user_id"], "6 hours", late=None)).select("user_id", _stamp("start"), "n")
