"""Structured Streaming queries: the tables arrive as file streams and are drained to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cartolith.plans.fixtures import Register
from cartolith.session import table
from cartolith.streaming import monitor as M

query = Register()
QUERIES, SQL = query.queries, query.sql


def stream(v, name: str):
    path = f"{v.sf_dir}/{name}.parquet"
    schema = table(v.spark, v.sf_dir, name).schema
    return v.spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(v, frame):
    base = f"{v.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return M.to_table(frame, f"{base}/table", f"{base}/state")


def events(v):
    s = stream(v, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").when(F.col("event_type") == "purchase", "INFO").otherwise("DEBUG")
    return s.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("long").alias("session"), F.col("event_type").alias("component"), F.col("value").alias("seconds"), level.alias("level"))


# append mode gives a window when the watermark (latest time less ten minutes) has passed its end
CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM {events})"


@query("STR_01_timing_stream", f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, session, component, round(sum(seconds), 4) AS seconds FROM {{metric}} WHERE seconds > 0.001e0 AND {CLOSED} GROUP BY ALL")
def _(v):
    done = drained(v, M.timings(events(v)))
    return done.select(F.unix_timestamp("start").alias("start"), "session", "component", F.round("seconds", 4).alias("seconds"))


@query("STR_02_log_stream", f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, level, count(*) AS n FROM {{log}} WHERE {CLOSED} GROUP BY ALL")
def _(v):
    done = drained(v, M.log_counts(events(v)))
    return done.select(F.unix_timestamp("start").alias("start"), "level", "n")


@query("STR_03_incremental_extracts", "SELECT type, id FROM {tile_extract} GROUP BY type, id")
def _(v):
    part = stream(v, "part")
    x = (F.col("p_partkey") * 7919) % 4096
    both = F.array(F.lit(0), F.when((x % 1024 < 64) & (x >= 1024), F.lit(1)).otherwise(F.lit(0)))
    tiles = part.select(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.explode(F.array_distinct(both)).alias("tile"))
    return drained(v, M.fresh_primitives(tiles)).select("type", "id")
