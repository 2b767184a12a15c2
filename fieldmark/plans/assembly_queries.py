"""Queries E1-E12 and J6: span assembly (events as labelled positions, span arrays)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.operators.assembly import nearest_by_position
from fieldmark.plans.catalog import register
from fieldmark.sources.fixtures import table

NEAREST_SQL = """
WITH ev AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS c FROM events),
a AS (SELECT * FROM ev WHERE event_type = 'purchase'),
cand AS (
  SELECT a.user_id, a.event_id AS anchor, e.event_type AS kind, e.event_id,
         row_number() OVER (PARTITION BY a.event_id, e.event_type ORDER BY abs(e.c - a.c), e.event_id) AS rn
  FROM a JOIN ev e ON e.user_id = a.user_id AND e.event_type IN ('click', 'view', 'error')
)
SELECT a.user_id, a.event_id,
  max(CASE WHEN c.kind = 'click' THEN c.event_id END) AS value_event,
  max(CASE WHEN c.kind = 'view' THEN c.event_id END) AS unit_event,
  max(CASE WHEN c.kind = 'error' THEN c.event_id END) AS direction_event
FROM a LEFT JOIN cand c ON c.anchor = a.event_id AND c.rn = 1
GROUP BY a.user_id, a.event_id"""


def _nearest(spark, sf_dir, bucket_width=None):
    ev = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("pos"))
    kw = {} if bucket_width is None else {"bucket_width": bucket_width}
    r = nearest_by_position(ev, ["user_id"], "pos", "event_id", "event_type", "purchase",
                            ["click", "view", "error"], "event_id", **kw)
    return r.select("user_id", "event_id", F.col("near_click").alias("value_event"),
                    F.col("near_view").alias("unit_event"), F.col("near_error").alias("direction_event"))


@register("e02_nearest_association", NEAREST_SQL, headline=True)
def e02_nearest_association(spark, sf_dir):
    """For every purchase (lever), the nearest click (value), view (unit) and
    error (direction) of the same user by time, ties to the earliest event."""
    return _nearest(spark, sf_dir)


@register("e02_nearest_small_buckets", NEAREST_SQL)
def e02_nearest_small_buckets(spark, sf_dir):
    """E2 with one-hour buckets: most neighbours are found through the bucket summaries."""
    return _nearest(spark, sf_dir, bucket_width=3_600_000_000)
