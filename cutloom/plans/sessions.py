"""Session queries over ``events`` (the batch form of the streaming operators)."""

from pyspark.sql import functions as F

from cutloom.sources import adapters as A
from cutloom.streaming.sessions import sessions

GAP_HOURS = 20


def _sessions(s, d):
    since = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {c})")
    got = sessions(A.read(s, d, "events"), f"{GAP_HOURS} hours")
    return got.select("media_id", since("start_ts").alias("start_us"), since("end_ts").alias("end_us"), "n", "spoken_cs")


QUERIES = {"session_breaks": _sessions}
ORACLE = {
    "session_breaks": f"""WITH e AS (SELECT user_id, epoch_us(ts) - 1704067200000000 AS t, CAST(round(value * 100) AS BIGINT) AS c FROM events),
s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {GAP_HOURS} * 3600000000 THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS k FROM s)
SELECT user_id AS media_id, min(t) AS start_us, max(t) + {GAP_HOURS} * 3600000000 AS end_us, count(*) AS n, CAST(sum(c) AS BIGINT) AS spoken_cs FROM g GROUP BY user_id, k"""
}
