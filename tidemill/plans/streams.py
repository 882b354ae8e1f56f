"""Streaming twins; the SQL says what the batch query gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.base import Registry, r6
from tidemill.sources.tables import materialize, table
from tidemill.streaming import streams

query = Registry()
QUERIES, SQL = query.queries, query.sql

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("ts is not null")


def _ntz(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("""SELECT start, start + INTERVAL 6 HOUR AS "end", event_type, n FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of six hours by type of event, an hour of lateness allowed."""
    return _ntz(streams.run_to_table(streams.tumbling(_events(spark, sf_dir), "ts", "6 hours", "1 hour", ["event_type"]), "tumbling"), "start", "end")


@query("""WITH k AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS nw FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM k)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of each user, cut by two hours of rest."""
    return _ntz(streams.run_to_table(streams.sessions(_events(spark, sf_dir), "ts", "2 hours", "1 hour", ["user_id"]), "session"), "start", "end")


@query("""SELECT w AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.37) / 100 AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR]) AS w FROM events WHERE ts IS NOT NULL)
GROUP BY ALL HAVING w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows of six hours that begin every three."""
    s = streams.run_to_table(streams.sliding(_events(spark, sf_dir), "ts", "6 hours", "3 hours", "1 hour", ["event_type"], "value"), "sliding")
    return _ntz(s, "start").withColumn("total", F.floor(F.col("total").cast("double") * 100 + 0.37) / 100)


@query("SELECT count(DISTINCT obs_id) AS n_readings FROM obs WHERE obs_id IS NOT NULL")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings deduplicated as they arrive, by time of arrival; deliveries up to 60 days late are recognised."""
    obs = streams.read_stream(spark, sf_dir, "obs").filter("obs_id is not null").select("obs_id", F.col("recv_time").cast("timestamp").alias("recv_time"))
    first = streams.run_to_table(streams.deduplicated(obs, "obs_id", "recv_time", "60 days"), "dedup")
    return first.agg(F.count("*").alias("n_readings"))


TURNS, LATE_S, DAY_S = 3, 86400, 86400


@query(f"""WITH x AS (SELECT epoch_us(min(recv_time)) AS a, epoch_us(max(recv_time)) AS z FROM bc WHERE recv_time IS NOT NULL AND name_time IS NOT NULL),
k AS (SELECT epoch_us(name_time) AS t, least(CAST(floor((epoch_us(recv_time) - a) * {TURNS}.0 / (z - a + 1)) AS BIGINT), {TURNS - 1}) AS turn FROM bc, x WHERE recv_time IS NOT NULL AND name_time IS NOT NULL),
w AS (SELECT turn, max(m) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {LATE_S}000000 AS mark FROM (SELECT turn, max(t) AS m FROM k GROUP BY turn)),
f AS (SELECT t // {DAY_S}000000 AS d FROM k JOIN w USING (turn) WHERE (t // {DAY_S}000000 + 1) * {DAY_S}000000 > coalesce(mark, 0))
SELECT make_timestamp(d * {DAY_S}000000) AS start, count(*) AS n FROM f WHERE (d + 1) * {DAY_S}000000 <= (SELECT max(t) - {LATE_S}000000 FROM k) GROUP BY d""")
def stream_watermark_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary rows by day as they arrive in three turns: rows of days that the watermark, a day behind the latest time seen in the
    turns before, has closed are dropped; days still open at the end are not put out."""
    b = table(spark, sf_dir, "bc").filter("recv_time is not null and name_time is not null").select(F.col("name_time").cast("timestamp").alias("ts"), F.unix_micros(F.col("recv_time").cast("timestamp")).alias("r"))
    x = b.agg(F.min("r").alias("a"), F.max("r").alias("z"))
    b = materialize(b.join(F.broadcast(x)).select("ts", F.least(F.floor((F.col("r") - F.col("a")) * float(TURNS) / (F.col("z") - F.col("a") + 1)), F.lit(TURNS - 1)).alias("turn")), "arrivals")  # one row
    out = streams.run_in_turns([b.filter(F.col("turn") == n).select("ts") for n in range(TURNS)], lambda s: streams.tumbling(s, "ts", "1 day", f"{LATE_S} seconds", []), "late")
    return _ntz(out, "start").select("start", "n")


@query("""WITH k AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t, max(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS last FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL)
SELECT user_id, count(*) AS n, floor(sum(value * exp((t - last) / 86400)) * 1e4 + 0.3719) / 1e4 AS state FROM k GROUP BY user_id""")
def stream_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's decayed sum, handed over from one run of the stream to the next; the last state of each."""
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").cast("double").alias("value"))
    x = e.agg(F.min("at").alias("a"), F.max("at").alias("z"))
    e = materialize(e.join(F.broadcast(x)).withColumn("turn", F.least(F.floor((F.col("at") - F.col("a")) * TURNS / (F.col("z") - F.col("a") + 1)), F.lit(TURNS - 1))).drop("a", "z"), "arrivals")  # one row
    out = streams.run_in_turns([e.filter(F.col("turn") == n).drop("turn") for n in range(TURNS)], lambda s: streams.handed_over(s, "user_id", "at", "value", 86400.0), "handover")
    last = out.groupBy("user_id").agg(F.max(F.struct("n", "state")).alias("m"))
    return last.select("user_id", "m.n", r6("m.state", 1e4).alias("state"))
