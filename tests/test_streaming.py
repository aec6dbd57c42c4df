"""Claims that expire, as a replayed stream."""

import datetime as dt
import os
from pathlib import Path

from pyspark.sql import functions as F

from segmill.operators.validation import stale
from segmill.streaming.claims import stale_claims

DAY = dt.datetime(2001, 8, 2)


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def replay(spark, tmp_path, batches, **how):
    """Each list of (creator, hours) as a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(c, None if h is None else at(h)) for c, h in rows], "creator_id string, heartbeat timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in Path(f"{tmp_path}/in/{k}").glob("*.parquet"):
            os.utime(f, (1e9 + 60 * k,) * 2)  # files are taken by age
    s = spark.readStream.schema("creator_id string, heartbeat timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = []

    def keep(df, _):
        got.extend((r["creator_id"], r["heartbeat"], r["stale_at"]) for r in df.collect())

    q = stale_claims(s, **how).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start()
    try:
        q.processAllAvailable()
        q.awaitTermination(120)
    finally:
        q.stop()
    return got


def test_a_heartbeat_renews_and_a_stale_claim_is_told_once(spark, tmp_path):
    batches = [[("a", 0), ("b", 0), (None, 0), ("x", None)], [("a", 1.5)], [("c", 3)], [("c", 4.5), ("a", 4)], [("c", 9)], [("e", 12)], [("c", 12.1)], [("e", 12.2)]]
    got = replay(spark, tmp_path, batches)
    assert sorted(got) == [("a", at(4), at(6)), ("b", at(0), at(2)), ("c", at(9), at(11))]  # renewed after it was stale


def test_the_stream_agrees_with_the_batch_rule(spark, tmp_path):
    """Of one replayed stream, what has expired by its own time is what the rule says of the last heartbeats."""
    rows = [(f"c{k}", (k * 7 % 23) / 4) for k in range(20)]
    rows.sort(key=lambda r: r[1])
    batches = [rows[i : i + 5] for i in range(0, 20, 5)] + [[("end", 7.0)], [("end", 7.01)]]
    got = {c for c, _, _ in replay(spark, tmp_path, batches)}
    now = (at(7.0) - dt.timedelta(minutes=10) - dt.datetime(1970, 1, 1)).total_seconds()
    df = spark.createDataFrame([(c, (at(h) - dt.datetime(1970, 1, 1)).total_seconds()) for c, h in rows], "creator_id string, heartbeat double")
    assert got - {"end"} == {r["creator_id"] for r in df.filter(stale(F.col("heartbeat"), F.lit(now), 7200.0)).collect()} and 0 < len(got) < 20
