"""Streaming queries: run to completion over files of the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.catalog.base import query, sql
from quillstat.plans.views import KEY_COLUMNS, statement, table
from quillstat.session import work_path
from quillstat.streaming import incremental, sessions


FILES = 4


def over_arrivals(spark, sf_dir, process, closing: bool = False):
    """Call ``process(stream)`` after each of several arrivals of events, all read by one stream: each is written by as many tasks as the table has splits, is up to
    eight minutes out of order and reaches into the next one. ``closing`` adds one event a day later, of a user of its own, which lets the watermark pass all others."""
    path = work_path(spark, "arriving")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(480_000_000))
    newest = events.agg(F.max("ts").alias("newest"))
    bounds = events.agg(F.min(arrival).alias("low"), F.max(arrival).alias("high")).first()
    file = F.least(F.lit(FILES - 1), F.floor((arrival - F.lit(bounds.low)) * FILES / F.lit(max(bounds.high - bounds.low, 1) if bounds.low is not None else 1)))
    parts = [events.filter(file == i) for i in range(FILES)]
    if closing:
        nulls = [F.lit(None).cast(t).alias(c) for c, t in events.dtypes if c not in ("user_id", "ts")]
        last = newest.select(F.lit(-1).cast(dict(events.dtypes)["user_id"]).alias("user_id"), (F.col("newest") + F.expr("INTERVAL 1 DAY")).alias("ts"), *nulls)
        parts.append(last.select(*events.columns))
    for part in parts:
        part.write.mode("append").parquet(path)
        process(spark.readStream.schema(events.schema).parquet(path))


def _wall_clock():
    """Session bounds as text, the same in every session time zone."""
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("session_start", "session_end")]


SESSIONS = ("e AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END nw FROM events), "
            "g AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM e), "
            "ss AS (SELECT user_id, MIN(ts) session_start, MAX(ts) + INTERVAL 30 MINUTE session_end, COUNT(*) n_events FROM g GROUP BY user_id, g)")


@query("session_activity", "SM1", f"WITH {SESSIONS} SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') session_start, strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') session_end, n_events FROM ss")
def session_activity(spark, sf_dir):
    out = sessions.session_activity(table(spark, sf_dir, "events"), "user_id", "ts")
    return out.select("user_id", *_wall_clock(), "n_events")


@query("session_activity_stream", "SM1", f"WITH {SESSIONS} SELECT user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S.%f') session_start, strftime(session_end, '%Y-%m-%d %H:%M:%S.%f') session_end, n_events FROM ss")
def session_activity_stream(spark, sf_dir):
    sessions.use_rocksdb(spark)
    path = work_path(spark, "sessions")
    over_arrivals(spark, sf_dir, lambda events: sessions.run_session_updates(sessions.session_updates(events, "user_id", "ts"), path))
    return sessions.current_sessions(spark, path, "user_id").select("user_id", *_wall_clock(), "n_events")


@query("carry_slots_stream", "SM2", "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type='purchase' THEN 'C'||CAST(event_id%9 AS VARCHAR) END company, CASE WHEN event_type IN ('click','purchase') THEN 'I'||CAST(event_id%4 AS VARCHAR) END AS indicator, "
       "CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END nw FROM events), g AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) g FROM e) "
       "SELECT user_id, event_id, last_value(company IGNORE NULLS) OVER w company, last_value(indicator IGNORE NULLS) OVER w AS indicator FROM g WINDOW w AS (PARTITION BY user_id, g ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def carry_slots_stream(spark, sf_dir):
    sessions.use_rocksdb(spark)
    path = work_path(spark, "slots")
    t = F.col("event_type")

    def process(events):
        turns = events.select(
            "user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(t == "purchase", F.concat(F.lit("C"), (F.col("event_id") % 9).cast("string"))).alias("company"),
            F.when(t.isin("click", "purchase"), F.concat(F.lit("I"), (F.col("event_id") % 4).cast("string"))).alias("indicator"))
        sessions.run_available(sessions.carry_slots_stream(turns, "user_id", "ts", ["company", "indicator"], delay="10 minutes"), path)

    over_arrivals(spark, sf_dir, process, closing=True)
    return spark.read.parquet(f"{path}/data").select("user_id", "event_id", "company", "indicator")


@query("incremental_upsert", "SM3 SRC10", sql(
    "SELECT stock_code, report_year, report_period, CAST(CASE WHEN report_period='FY' THEN net_profit+1 ELSE net_profit END AS DECIMAL(20,4)) net_profit FROM income"))
def incremental_upsert(spark, sf_dir):
    """All rows arrive once, then the annual rows again with a correction."""
    source, target = work_path(spark, "incoming"), work_path(spark, "loaded")
    rows = statement(spark, sf_dir, "income").select(*KEY_COLUMNS, "net_profit", F.lit(1).alias("version"))
    fixed = rows.filter("report_period = 'FY'").withColumns({"net_profit": (F.col("net_profit") + 1).cast("decimal(20,4)"), "version": F.lit(2)})
    schema = "stock_code string, stock_abbr string, report_year int, report_period string, net_profit decimal(20,4), version int"
    for part in (rows, fixed):
        part.write.mode("append").json(source)
        incremental.incremental_load(spark, source, target, schema, order="version")
    return incremental.current_rows(spark, target, order="version").select("stock_code", "report_year", "report_period", "net_profit")
