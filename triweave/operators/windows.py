"""Request-rate audit over an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMITS = ((1_000, 8), (60_000, 16), (3_600_000, 20))
BLOCK = 6  # of the longest window: a group is looked at in stretches of time of this length


def rate_audit(events: DataFrame, group: str, ts: str, limits: tuple[tuple[int, int], ...] = LIMITS) -> DataFrame:
    """``group, ts_ms, used_<window>..., wait_ms``: requests in each sliding window up to an event, and the wait it implies.

    A window that holds its limit frees when its limit-th last request leaves it. Each stretch of time sees the events
    of one longest window before it, so that a busy group is not one task.
    """
    longest = max(ms for ms, _ in limits)
    e = events.select(F.col(group).alias("group"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ts_ms"))
    e = e.withColumn("_block", F.floor(F.col("ts_ms") / (BLOCK * longest)))
    late = e.where(F.pmod("ts_ms", F.lit(BLOCK * longest)) >= (BLOCK - 1) * longest)
    e = e.withColumn("_own", F.lit(True)).unionByName(late.withColumn("_block", F.col("_block") + 1).withColumn("_own", F.lit(False)))
    w = Window.partitionBy("group", "_block").orderBy("ts_ms")
    waits = []
    for ms, limit in limits:
        e = e.withColumn(f"used_{ms}", F.count("*").over(w.rangeBetween(-(ms - 1), 0)))
        e = e.withColumn(f"_at_{ms}", F.lag("ts_ms", limit - 1).over(w))
        waits.append(F.when(F.col(f"used_{ms}") >= limit, F.greatest(F.lit(0), F.col(f"_at_{ms}") + ms - F.col("ts_ms"))))
    return e.where("_own").select("group", "ts_ms", *[f"used_{ms}" for ms, _ in limits], F.coalesce(F.array_max(F.array(*waits)), F.lit(0)).alias("wait_ms"))
