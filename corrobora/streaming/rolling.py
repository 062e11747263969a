"""Streams with state that ends: rolling suppression of repeats, and cases that leave once they are settled."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corrobora import constants as K
from corrobora.streaming.jobs import run_available


def suppress(times: list[int], last: int | None, gap: int) -> tuple[list[bool], int | None]:
    """Which of the sorted ``times`` pass: those ``gap`` or more after the last that passed, which is returned too.

    A time ``gap`` or more before the last pass stands for an earlier run and passes without becoming the last.
    """
    keep = []
    for t in times:
        ok = last is None or t >= last + gap or t <= last - gap
        keep.append(ok)
        if ok and (last is None or t > last):
            last = t
    return keep, last


def stream_rolling(stream: DataFrame, keys: list[str], id: str, minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """Events (keys, id, ts) that pass: no other of their key has passed in the ``minutes`` before.

    State is the time of a key's last pass, and it leaves ``minutes`` and ``late`` after it. Events of a batch are taken
    in the order of time and id; events more than ``late`` behind are dropped.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    micros, wait = minutes * 60_000_000, (minutes * 60_000)
    timed = stream.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(id).cast("long").alias("id"),
                          F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([b[["id", "ts"]] for b in batches]).sort_values(["ts", "id"])
        at = rows["ts"].astype("datetime64[us]").astype("int64").tolist()
        keep, last = suppress(at, state.get[0] if state.exists else None, micros)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        kept = rows[keep]
        yield pd.DataFrame({**{k: [v] * len(kept) for k, v in zip(keys, key)}, "id": kept["id"], "ts": kept["ts"]})

    schema = ", ".join([*[f"{k} string" for k in keys], "id long", "ts timestamp"])
    passed = timed.groupBy(*keys).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return run_available(passed)


def stream_settling(stream: DataFrame, case: str, linger: str = "2 hours", minutes: int = 120) -> DataFrame:
    """(case, status, n_events, ended) of each case that settled or fell silent: what leaves the state, leaves it as a row.

    A case is settled by its first settled status, or skipped by a cancel while it stood at queued or parsed. It stays
    for ``minutes`` after its last event, so that late and repeated events find it settled, and then leaves for good.
    Cases that are still open at the end of the stream are reported by the last batch that touched them, not ended.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    settled, waiting = set(K.SETTLED_STATUS), {"queued", "parsed"}
    timed = stream.select(F.col(case).cast("string").alias("case"), "status", F.col("seq").cast("long").alias("seq"),
                          F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", linger)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n, last = state.get if state.exists else ("queued", 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"case": [key[0]], "status": [now], "n_events": [n], "ended": [True]})
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for status in rows["status"]:
            if now not in settled:
                if status == "cancel":
                    now = "skipped" if now in waiting else now
                else:
                    now = status
        n += len(rows)
        last = max(last, int(rows["ts"].astype("datetime64[us]").astype("int64").max()) // 1000)
        state.update((now, n, last))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"case": [key[0]], "status": [now], "n_events": [n], "ended": [False]})

    out = timed.groupBy("case").applyInPandasWithState(
        step, "case string, status string, n_events long, ended boolean", "status string, n long, last long", "update",
        GroupStateTimeout.EventTimeTimeout)
    stored = run_available(out, "update")
    newest = F.max_by(F.struct("status", "n_events", "ended"), F.struct("batch", "ended")).alias("_r")
    return stored.groupBy("case").agg(newest).select(F.col("case").alias(case), "_r.*")
