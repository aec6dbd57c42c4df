"""F19 as a stream: claims that expire. An extension, as claims arrive as heartbeats."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stale_claims(heartbeats: DataFrame, ttl: float = 7200.0, late: str = "10 minutes") -> DataFrame:
    """(creator_id, heartbeat, stale_at) of each claim whose last heartbeat is more than `ttl` seconds old, once.

    heartbeats is a stream of (creator_id, heartbeat timestamp). A heartbeat renews a claim, also one that
    had expired, which is then a new one. Time is the stream's own: the latest heartbeat of all less `late`;
    rows older than that are dropped. Rows without a creator or a time are passed over. Only the last
    heartbeat of each claim that is alive is kept as state.
    """
    kind = dict(heartbeats.dtypes)["creator_id"]
    length = pd.Timedelta(seconds=ttl)

    def gone(creator: Any, last: pd.Timestamp) -> pd.DataFrame:
        return pd.DataFrame({"creator_id": [creator], "heartbeat": [last], "stale_at": [last + length]})

    def ends(last: pd.Timestamp) -> int:
        return int((last + length).value // 1_000_000)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0])
            state.remove()
            yield gone(key[0], last)
            return
        last = max(r["heartbeat"].max() for r in rows if len(r))
        if state.exists:
            before = pd.Timestamp(state.get[0])
            if ends(before) <= state.getCurrentWatermarkMs():  # it came too late for that claim
                yield gone(key[0], before)
            last = max(last, before)
        if ends(last) <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            else:
                yield gone(key[0], last)
            return
        state.update((last.to_pydatetime(),))
        state.setTimeoutTimestamp(ends(last))

    alive = heartbeats.filter(F.col("creator_id").isNotNull() & F.col("heartbeat").isNotNull()).select("creator_id", "heartbeat")
    out = f"creator_id {kind}, heartbeat timestamp, stale_at timestamp"
    return alive.withWatermark("heartbeat", late).groupBy("creator_id").applyInPandasWithState(step, out, "heartbeat timestamp", "append", GroupStateTimeout.EventTimeTimeout)
