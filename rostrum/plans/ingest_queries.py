"""Queries on planning and state of ingestion, over ``orders``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import matching as ma
from rostrum.operators.common import interval_join
from rostrum.plans import views as v
from rostrum.plans.registry import query
from rostrum.plans.sqltext import sql
from rostrum.streaming import ingest


@query("pending_ids", "SELECT o_orderkey AS id, o_orderpriority AS publisher FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def pending_ids(spark, sf):
    listing = v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("publisher"))
    done = v.read(spark, sf, "lineitem").filter(F.col("l_quantity") > 30).select(F.col("l_orderkey").alias("id"))
    return ingest.pending_ids(listing, done, "id", "1-URGENT")


@query("ingest_status", """
WITH s AS (SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS downloaded, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders)
SELECT *, total - downloaded AS pending, CASE WHEN total = 0 THEN 'empty' WHEN total = downloaded THEN 'complete' ELSE 'in_progress' END AS status FROM s""")
def ingest_status(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "downloaded").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return ingest.ingest_status(v.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state")))


@query("in_range_counts", """
WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS s FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click')
SELECT r.event_id, count(*) AS clicks FROM r JOIN p ON r.user_id = p.user_id AND p.t >= r.s AND p.t < r.s + 86400000000 GROUP BY r.event_id""")
def in_range_counts(spark, sf):
    """Clicks of the same user within a day after each purchase, to the microsecond."""
    day = 86_400_000_000
    e = v.read(spark, sf, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    ranges = e.filter(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("purchase"), F.col("t").alias("s"), (F.col("t") + day).alias("e"))
    points = e.filter(F.col("event_type") == "click").select("user_id", "t")
    hits = interval_join(points, ranges, "user_id", "t", "s", "e", width=day)
    return hits.groupBy(F.col("purchase").alias("event_id")).agg(F.count(F.lit(1)).alias("clicks"))


@query("sample_protocols", sql("SELECT protocol_id, string_agg(chair || chr(10) || header || ':' || chr(10) || spoken, '' ORDER BY turn) AS full_text FROM turns GROUP BY protocol_id ORDER BY md5('7:' || protocol_id), protocol_id LIMIT 3", "turns"))
def sample_protocols(spark, sf):
    return ma.sample_protocols(v.transcripts(spark, sf), 3, seed=7)
