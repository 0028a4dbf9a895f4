"""Registered queries of the state machines and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import states
from sluice.plans.catalog import query
from sluice.sources.tables import table

_ORDERED = "o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@query(f"""WITH RECURSIVE {_ORDERED}, w AS (SELECT user_id, event_id, ts, r, 1 AS attempts, ts + INTERVAL 43200 SECOND AS ends FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.r, CASE WHEN w.ends < o.ts THEN 1 ELSE w.attempts + 1 END, CASE WHEN w.ends < o.ts THEN o.ts + INTERVAL 43200 SECOND ELSE w.ends END FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
  SELECT user_id, event_id, attempts, least(300, 2 ** (attempts - 1))::INT AS wait_s, CASE WHEN attempts >= 5 THEN 900 ELSE 0 END AS locked_s FROM w""")
def login_throttle(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return states.throttled(e, ["user_id"], "ts", "event_id", most=5, window_s=43200, lock_s=900, cap_s=300).select("user_id", "event_id", "attempts", "wait_s", "locked_s")


@query(f"""WITH RECURSIVE {_ORDERED}, w AS (SELECT user_id, event_id, ts, r, [ts] AS taken, true AS accepted FROM o WHERE r = 1
  UNION ALL SELECT o.user_id, o.event_id, o.ts, o.r, CASE WHEN len(list_filter(w.taken, lambda x: x > o.ts - INTERVAL 86400 SECOND)) < 3 THEN list_append(list_filter(w.taken, lambda x: x > o.ts - INTERVAL 86400 SECOND), o.ts) ELSE w.taken END,
  len(list_filter(w.taken, lambda x: x > o.ts - INTERVAL 86400 SECOND)) < 3 FROM w JOIN o ON o.user_id = w.user_id AND o.r = w.r + 1)
  SELECT user_id, event_id, accepted FROM w""")
def rate_limits(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    return states.rate_limited(e, ["user_id"], "ts", "event_id", limit=3, window_s=86400).select("user_id", "event_id", "accepted")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW) AS calls FROM events""")
def calls_in_last_day(spark, d):
    return states.in_last(table(spark, d, "events"), ["user_id"], "ts", 86400, "calls").select("event_id", "calls")


_LOG = "l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'resolved' WHEN 'view' THEN 'seen' WHEN 'click' THEN 'seen' ELSE 'note' END AS kind, 'v' || (event_id % 4) AS release FROM events)"


def _log(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type").isin("view", "click"), "seen").otherwise("note")
    return table(spark, d, "events").select("user_id", "event_id", "ts", kind.alias("kind"), F.concat(F.lit("v"), F.col("event_id") % 4).alias("release"))


@query(f"""WITH {_LOG} SELECT user_id, event_id FROM (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM l WHERE kind <> 'note') WHERE kind = 'seen' AND b = 'resolved'""")
def reopened_issues(spark, d):
    return states.reopened(_log(spark, d), "user_id", "event_id", "kind").select("user_id", "event_id")


@query(f"""WITH {_LOG} SELECT user_id, CASE WHEN arg_max(kind, event_id) = 'resolved' THEN 'resolved' ELSE 'new' END AS status, arg_min(release, event_id) FILTER (WHERE kind = 'seen') AS first_release,
  arg_max(release, event_id) FILTER (WHERE kind = 'seen') AS last_release, count(*) FILTER (WHERE kind = 'resolved') AS resolutions FROM l WHERE kind <> 'note' GROUP BY 1""")
def issue_states(spark, d):
    return states.issue_state(_log(spark, d), "user_id", "event_id", "kind", "release")


@query("""WITH f AS (SELECT user_id, min(struct_pack(t := ts, e := event_id)) AS first FROM events GROUP BY 1), k AS (SELECT user_id, row_number() OVER (PARTITION BY date_trunc('hour', struct_extract(first, 't')) ORDER BY first) <= 1 AS known FROM f)
  SELECT date_trunc('hour', ts) AS bucket_at, CASE WHEN known THEN user_id::VARCHAR ELSE 'overflow' END AS user_id, count(*) AS n FROM events JOIN k USING (user_id) GROUP BY 1, 2""")
def capped_signatures(spark, d):
    return states.capped_signatures(table(spark, d, "events"), "user_id", "ts", "event_id", 1)


_JOBS = "j AS (SELECT user_id AS job_id, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'started' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'started' END AS kind FROM events)"


@query(f"""WITH {_JOBS}, s AS (SELECT job_id, arg_max(kind, event_id) AS last, arg_max(ts, event_id) AS last_at, count(*) FILTER (WHERE kind = 'started')::INT AS attempts FROM j GROUP BY 1)
  SELECT job_id, CASE WHEN last <> 'started' THEN last WHEN last_at < TIMESTAMP '2024-01-30' - INTERVAL 21600 SECOND THEN 'queued' ELSE 'running' END AS status, attempts FROM s""")
def replayed_jobs(spark, d):
    names = F.array(*map(F.lit, ("queued", "started", "done", "failed", "started")))
    j = table(spark, d, "events").select(F.col("user_id").alias("job_id"), "event_id", "ts", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"))
    return states.replayed_jobs(j, "job_id", "event_id", "kind", "ts", F.lit("2024-01-30").cast("timestamp_ntz"), 21600)


@query("""SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderkey % 3 DESC, o_orderdate, o_orderkey LIMIT 25""")
def claimed_jobs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), (F.col("o_orderkey") % 3).alias("priority"), F.col("o_orderdate").alias("next_run_at"))
    return states.claimable(o, F.lit("1998-01-01").cast("timestamp_ntz"), 25).select("job_id")


@query("""SELECT event_id FROM events WHERE event_id % 7 <> 0""")
def outbox_rows(spark, d):
    e = table(spark, d, "events").select("event_id")
    return states.outbox_pending(e.union(e.where("event_id % 2 = 0")), e.where("event_id % 7 = 0"), "event_id")
