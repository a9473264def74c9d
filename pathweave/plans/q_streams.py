"""Registered streaming queries (ST1-ST4), each run to completion over the events file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.ledger import count_by_status
from ..session import table_path
from ..sources.views import STATUS_LOG_V_SQL, read, with_ctes
from ..streaming import runs as S
from .registry import register, rounded

_TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_TS_SQL = "%Y-%m-%d %H:%M:%S.%f"


DELAY = "6 days"  # of the watermark

# The events as a feed: ten days of events arrive together; one event in 50 comes one batch late, one in 50 two batches late.
_ARRIVAL = "(datediff(ts, DATE '2024-01-01') div 10 + CASE event_id % 50 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 0 END)"
_FEED_SQL = """feed AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10
    + CASE event_id % 50 WHEN 7 THEN 2 WHEN 8 THEN 1 ELSE 0 END AS arrival FROM events)"""
# Watermark that drops rows of a batch: the greatest time of all batches before the one before it, less the delay.
_MARK_SQL = """numbered AS (SELECT *, dense_rank() OVER (ORDER BY arrival) AS b FROM feed),
tops AS (SELECT b, max(ts) AS top FROM numbered GROUP BY b),
marks AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 6 DAY AS mark FROM tops),
marked AS (SELECT numbered.*, mark, (SELECT max(top) - INTERVAL 6 DAY FROM tops) AS last_mark FROM numbered JOIN marks USING (b))"""


def _windows_sql(slides=(0,), size=1):
    """Every (row, window) pair; ``late``: the window was final when the row came."""
    return "win AS (" + " UNION ALL ".join(
        f"SELECT *, date_trunc('day', ts) - INTERVAL {k} DAY AS ws, mark IS NOT NULL AND date_trunc('day', ts) + INTERVAL {size - k} DAY <= mark AS late "
        f"FROM marked" for k in slides) + ")"


def _final_sql(columns, groups, slides=(0,), size=1):
    return (f"WITH {_FEED_SQL},\n{_MARK_SQL},\n{_windows_sql(slides, size)}\nSELECT strftime(ws, '{_TS_SQL}') AS window_start, {columns} FROM win "
            f"WHERE NOT late AND ws + INTERVAL {size} DAY <= last_mark GROUP BY ws, {groups}")


def _stream(spark, directory, schema, max_files=1):
    # Event-time windows are epoch-aligned; day windows mean UTC days.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return S.as_event_time(S.file_stream(spark, directory, schema, max_files_per_trigger=max_files))


def _events(spark, d, arrivals=_ARRIVAL):
    """The whole events table as a feed of micro-batches, with late ones among its rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = read(spark, d, "events")
    feed = table_path(spark, f"feeds/{uuid.uuid4().hex}")
    S.write_arrivals(events.withColumn("arrival", F.expr(arrivals)), "arrival", feed)
    return _stream(spark, feed, events.schema)


@register("st1_idempotent_ingest", f"""
SELECT event_id, strftime(ts, '{_TS_SQL}') AS ts, user_id, event_type, value FROM events""")
def st1_idempotent_ingest(spark, d):
    """One event in three is delivered a second time, in the batch after its first."""
    twice = f"explode(CASE WHEN event_id % 3 = 0 THEN array({_ARRIVAL}, {_ARRIVAL} + 1) ELSE array({_ARRIVAL}) END)"
    out = S.run_available_now(S.idempotent_ingest(_events(spark, d, twice)), "st1")
    return out.select("event_id", F.date_format("ts", _TS_FMT).alias("ts"), "user_id", "event_type", "value")


def _status_stream(spark, d):
    e = _events(spark, d)
    status = (F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed")
              .when(F.col("event_type") == "signup", "refused").otherwise("running"))
    return e.select(F.col("user_id").alias("run_id"), "ts", status.alias("status"))


@register("st2_live_status_counts", with_ctes(STATUS_LOG_V_SQL, """cur AS (SELECT run_id, max_by(status, ts) AS status
  FROM status_log_v GROUP BY 1)""", body="SELECT status, count(*) AS n FROM cur GROUP BY 1"))
def st2_live_status_counts(spark, d):
    return count_by_status(S.live_status(_status_stream(spark, d), "st2"))


_RATES = "event_type, count(*) AS n, round(avg(value), 6) AS mean_value"


def _rates(spark, d, name, **settings):
    out = S.run_available_now(S.windowed_rates(_events(spark, d), ["event_type"], watermark=DELAY, **settings), name)
    return rounded(out.select(F.date_format("window.start", _TS_FMT).alias("window_start"), "event_type", "n", "mean_value"))


@register("st3_daily_rates", _final_sql(_RATES, "event_type"))
def st3_daily_rates(spark, d):
    return _rates(spark, d, "st3")


@register("st3_sliding_rates", _final_sql(_RATES, "event_type", slides=(0, 1), size=2))
def st3_sliding_rates(spark, d):
    return _rates(spark, d, "st3s", size="2 days", slide="1 day")


@register("st3_late_rows", f"""
WITH {_FEED_SQL},
{_MARK_SQL},
{_windows_sql()}
SELECT strftime(ws, '{_TS_SQL}') AS window_start, event_id, event_type, value FROM win WHERE late""")
def st3_late_rows(spark, d):
    late = S.late_rows(_events(spark, d), "st3late", watermark=DELAY)
    return late.select(F.date_format("window.start", _TS_FMT).alias("window_start"), "event_id", "event_type", "value")


_VERSION = "'v' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) % 4 AS VARCHAR)"


@register("st4_provider_drift", _final_sql(
    f"'prov-' || CAST(user_id % 3 AS VARCHAR) AS provider, {_VERSION} AS version, count(*) AS n, {_VERSION} = 'v0' AS pinned",
    f"'prov-' || CAST(user_id % 3 AS VARCHAR), {_VERSION}"))
def st4_provider_drift(spark, d):
    e = _events(spark, d).select(
        "ts", F.concat(F.lit("prov-"), (F.col("user_id") % 3).cast("string")).alias("provider"),
        F.concat(F.lit("v"), (F.get_json_object("props", "$.k").cast("long") % 4).cast("string")).alias("version"))
    out = S.run_available_now(S.provider_drift(e, watermark=DELAY), "st4")
    return out.select(F.date_format("window.start", _TS_FMT).alias("window_start"), "provider", "version", "n",
                      (F.col("version") == "v0").alias("pinned"))
