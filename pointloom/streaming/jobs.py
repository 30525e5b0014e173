"""Running statistics, filters and runs per key on streams, and appending to stored points.

Batches are ordered by event time inside; a row older than the state's time is late: it is dropped and counted.
State is small per key and can time out. Streams out of order have :func:`low_pass_in_order` and
:func:`changes_in_order`, whose rows wait for the watermark.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointloom.operators.stats import mean, stdev, sums


def running_bins(stream: DataFrame, key: str, x: str, w: str | None = None, time: str | None = None, width: str | None = None, late: str = "10 minutes") -> DataFrame:
    """n, mean and stdev per key as rows arrive (update mode); with a time column per window of event time."""
    keys = [key]
    if time and width:
        stream = stream.withWatermark(time, late)
        keys = [F.window(time, width).alias("window"), key]
    g = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in sums(x, w).items() if n in ("n", "w_sum", "s1", "s2")])
    return g.withColumns({"mean": mean(), "stdev": stdev()}).drop("w_sum", "s1", "s2")


def low_pass_stream(stream: DataFrame, key: str, t: str, x: str, tau: float, idle_ms: int | None = None) -> DataFrame:
    """key, t and the low-passed x of each row in time, and how many late rows the key had so far."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, y, dropped = state.get if state.exists else (float("-inf"), 0.0, 0)
        frame = pd.concat(list(frames)).sort_values(t, kind="stable")
        times, values = frame[t].to_numpy(float), frame[x].to_numpy(float)
        late = times < last
        dropped += int(late.sum())
        out = []
        for at, v in zip(times[~late], values[~late]):
            if not np.isnan(v):
                gain = 1.0 if last == float("-inf") or tau == 0 else min((at - last) / tau, 1.0)
                y += gain * (v - y)
            last = at
            out.append((k[0], at, y, dropped))
        state.update((last, y, dropped))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "t", "filtered", "late"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(t).cast("double").alias(t), F.col(x).cast("double").alias(x))
    return rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, t double, filtered double, late long", "last double, y double, dropped long", "append", timeout)


def _same(a: float | None, b: float | None) -> bool:
    """Equal, or both missing."""
    return a == b or (a is None or np.isnan(a)) and (b is None or np.isnan(b))


def change_stream(stream: DataFrame, key: str, t: str, x: str, count_late: bool = False) -> DataFrame:
    """Only the rows whose x differs from the key's row before, with the number of the run they begin; with
    ``count_late`` how many late rows the key had so far, too. Missing values are equal to each other."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, value, run, late = state.get if state.exists else (float("-inf"), None, -1, 0)
        out = []
        frame = pd.concat(list(frames)).sort_values(t, kind="stable")
        for at, v in zip(frame[t].to_numpy(float), frame[x].to_numpy(float)):
            if at < last:
                late += 1
                continue
            if run < 0 or not _same(v, value):
                run += 1
                out.append((k[0], at, v, run, late))
            last, value = at, v
        state.update((last, value, run, late))
        yield pd.DataFrame(out, columns=["key", "t", "value", "run_id", "late"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(t).cast("double").alias(t), F.col(x).cast("double").alias(x))
    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, t double, value double, run_id long, late long", "last double, value double, run long, late long", "append", GroupStateTimeout.NoTimeout)
    return out if count_late else out.drop("late")


#: States that the keys of a stream out of order share, by a hash; a state is read and written whole.
STATES = 1024


def _in_order(stream: DataFrame, key: str, time: str, x: str, delay: str, step: Callable, start: tuple, result: str, idle_s: float | None, n_states: int = STATES) -> DataFrame:
    """Rows wait in state until the watermark has passed them and are then applied in the order of time.

    ``step(state, t, v)`` gets and returns (last, value, number) of a key and a result row or None. A row older than
    what has been applied is late: it is dropped and counted. With ``idle_s`` a key without rows for so long is
    forgotten. A call has the keys of one of ``n_states`` hashes, so that calls do not grow in number with the keys.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(time, delay).select(F.col(key).alias("key"), F.col(time).alias("time"), (F.unix_micros(time) / 1e6).alias("t"), F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias("v"))
    # missing keys have a state of their own, so that pandas keeps the others' type
    rows = rows.withColumn("state", F.when(F.col("key").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(n_states))).otherwise(-1))
    names = [c.split()[0] for c in f"key {kind}, {result}, late long".split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark_ms = state.getCurrentWatermarkMs()
        mark = mark_ms / 1000
        # of each key (last, value, number) and its late rows; the waiting rows are in the order of time
        known, late, keys, held = pickle.loads(state.get[0]) if state.exists else ({}, {}, [], np.empty((0, 2)))
        if not state.hasTimedOut:
            for frame in frames:
                new = [None] * len(frame) if k[0] < 0 else [c if c == c else math.nan for c in frame["key"].tolist()]  # one NaN
                keys, held = keys + new, np.concatenate([held, frame[["t", "v"]].to_numpy(float)])
                for c, t in zip(new, frame["t"].tolist()):
                    known.setdefault(c, start)
                    late[c] = late.get(c, 0) + (t < known[c][0])
            order = np.argsort(held[:, 0], kind="stable")
            order = [i for i, t in zip(order.tolist(), held[order, 0].tolist()) if t >= known[keys[i]][0]]
            keys, held = [keys[i] for i in order], held[order]
        ready = int(np.searchsorted(held[:, 0], mark, "right"))
        out = []
        for c, (t, v) in zip(keys[:ready], held[:ready].tolist()):
            known[c], row = step(known[c], t, v)
            if row is not None:
                out.append((c, *row, late[c]))
        keys, held = keys[ready:], held[ready:]
        due = [held[0, 0]] if keys else []
        if idle_s is not None:
            waiting = set(keys)
            for c in [c for c, own in known.items() if c not in waiting and own[0] + idle_s <= mark]:
                del known[c], late[c]
            due += [own[0] + idle_s for c, own in known.items() if c not in waiting]
        if known:
            state.update((pickle.dumps((known, late, keys, held)),))
            if due:  # called again when the watermark is beyond this time, which may not lie behind the present watermark
                state.setTimeoutTimestamp(max(math.ceil(min(due) * 1000) - 1, mark_ms, 1))
        elif state.exists:
            state.remove()
        if out:
            # keys as objects: Spark puts the frames of several calls together, some of missing keys
            yield pd.DataFrame(out, columns=names).astype({"key": object})

    return rows.groupBy("state").applyInPandasWithState(run, f"key {kind}, {result}, late long", "rows binary", "append", GroupStateTimeout.EventTimeTimeout)


def low_pass_in_order(stream: DataFrame, key: str, time: str, x: str, tau: float, delay: str, idle_s: float | None = None) -> DataFrame:
    """As :func:`low_pass_stream` for rows that come out of order, by up to ``delay`` of the event time (a timestamp).

    A row is given out once the watermark has passed it.
    """

    def step(state: tuple, t: float, v: float) -> tuple[tuple, tuple]:
        last, y, n = state
        if not np.isnan(v):
            gain = 1.0 if last == float("-inf") or tau == 0 else min((t - last) / tau, 1.0)
            y += gain * (v - y)
        return (t, y, n + 1), (t, y)

    return _in_order(stream, key, time, x, delay, step, (float("-inf"), 0.0, 0), "t double, filtered double", idle_s)


def changes_in_order(stream: DataFrame, key: str, time: str, x: str, delay: str, idle_s: float | None = None) -> DataFrame:
    """As :func:`change_stream` for rows that come out of order, by up to ``delay`` of the event time (a timestamp)."""

    def step(state: tuple, t: float, v: float) -> tuple[tuple, tuple | None]:
        last, value, run = state
        if run >= 0 and _same(v, value):
            return (t, value, run), None
        return (t, v, run + 1), (t, v, run + 1)

    return _in_order(stream, key, time, x, delay, step, (float("-inf"), float("nan"), -1), "t double, value double, run_id long", idle_s)


def append_points(stream: DataFrame, path: str, checkpoint: str):
    """Append arriving points to stored ones, each batch as a folder of its own; ends when the source is used up.

    A batch that is tried again writes to the same folder, so no point is stored twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
