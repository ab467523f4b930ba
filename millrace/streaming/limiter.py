"""The sliding-window rate limiter as a stateful stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def rate_limited(events: DataFrame, client: str, time: str, key: str, limit: int, window_s: float) -> DataFrame:
    """(key, allowed) of a stream: a request passes if fewer than ``limit`` of its client's passed in the last ``window_s`` seconds.

    A client's state is the times that passed in its window, at most ``limit``.
    Requests are judged in time order within a micro-batch, and batch after
    batch; a request that comes a batch late is judged when it comes.
    """
    rows = events.select(F.col(client).alias("client"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(key).cast("long").alias("key"))

    def judge(_, frames, state):
        passed = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values(["at", "key"])
        out = []
        for at in pdf["at"].tolist():
            passed = [t for t in passed if t > at - window_s * 1e6]
            ok = len(passed) < limit
            passed += [at] * ok
            out.append(ok)
        state.update((passed,))
        yield pd.DataFrame({key: pdf["key"], "allowed": out})

    return rows.groupBy("client").applyInPandasWithState(judge, f"`{key}` bigint, allowed boolean", "passed array<bigint>", "append", GroupStateTimeout.NoTimeout)
