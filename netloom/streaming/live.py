"""Live flows and block list in arrival order, kept as keyed state of a streaming query.

Nothing waits for a watermark and no packet is dropped as late. A key's state is one row, so it stays as large as the
number of open flows or blocked sources; a task holds what one micro-batch brought for one key, which the source's limit
per batch bounds. What a stopped query still held is read from its checkpoint. A query that goes by the clock (``by_clock``,
``ttl_s``) always has a next batch to wait for: it runs until stopped and cannot be drained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netloom.operators import flows

_SUMS = ["n", "sum_size", "sum_sq", *flows.TCP_FLAGS]
_HIGHS = ["last_us", "max_size", *flows.SERVICES]
_LOWS = ["start_us", "min_size"]
OPEN = T.StructType([T.StructField(c, T.LongType()) for c in ("first_code", "seen_us", *_SUMS, *_HIGHS, *_LOWS)])
FLOW = T.StructType([T.StructField("flow_id", T.StringType()), *OPEN.fields])


def _merged(old: dict, new: dict) -> dict:
    """Measures of an open flow and of packets that arrived after it."""
    return {"first_code": old["first_code"], "seen_us": new["seen_us"], **{c: old[c] + new[c] for c in _SUMS},
            **{c: max(old[c], new[c]) for c in _HIGHS}, **{c: min(old[c], new[c]) for c in _LOWS}}


def arrival_segments(packets: pd.DataFrame, timeout_us: int, seen_us: int | None) -> tuple[bool, list[dict]]:
    """Measures of the runs in one flow's packets, and whether the first run goes on with the flow last seen at ``seen_us``.

    Packets are taken as they arrived (``arrival``); a run ends where a packet is the timeout or more later than the one
    that arrived before it. A packet older than that one stays in the run.
    """
    rows = packets.sort_values("arrival", kind="stable")
    us = rows["us"].to_numpy()
    gap = np.diff(us, prepend=us[0] if seen_us is None else seen_us)
    goes_on = seen_us is not None and gap[0] < timeout_us
    new = gap >= timeout_us
    new[0] = True
    at = np.flatnonzero(new)
    size = rows["size"].to_numpy()
    ends = np.append(at[1:], len(us)) - 1
    parts = {"first_code": rows["code"].to_numpy()[at], "seen_us": us[ends], "n": np.diff(np.append(at, len(us))),
             "sum_size": np.add.reduceat(size, at), "sum_sq": np.add.reduceat(size * size, at),
             "min_size": np.minimum.reduceat(size, at), "max_size": np.maximum.reduceat(size, at),
             "start_us": np.minimum.reduceat(us, at), "last_us": np.maximum.reduceat(us, at),
             **{c: np.add.reduceat(rows[c].to_numpy(), at) for c in flows.TCP_FLAGS},
             **{c: np.maximum.reduceat(rows[c].to_numpy(), at) for c in flows.SERVICES}}
    return goes_on, [{c: int(parts[c][i]) for c in OPEN.names} for i in range(len(at))]


class ArrivalFlows(StatefulProcessor):
    """The open flow of a key; a flow leaves when a packet arrives that belongs to the next, or by a timer of the clock."""

    def __init__(self, timeout_s: int, by_clock: bool):
        self.timeout_us, self.by_clock = timeout_s * 1_000_000, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = dict(zip(OPEN.names, self.open.get())) if self.open.exists() else None
        goes_on, found = arrival_segments(pd.concat(rows), self.timeout_us, old and old["seen_us"])
        if goes_on:
            found[0] = _merged(old, found[0])
        elif old:
            found.insert(0, old)
        self.open.update(tuple(found[-1][c] for c in OPEN.names))
        if self.by_clock:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_us // 1000)
        if len(found) > 1:
            yield pd.DataFrame([{"flow_id": key[0], **f} for f in found[:-1]], columns=FLOW.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([(key[0], *self.open.get())], columns=FLOW.names)
            self.open.clear()

    def close(self) -> None:
        pass


def _features(found: DataFrame) -> DataFrame:
    timed = found.withColumns({"start_ts": F.timestamp_micros("start_us"), "last_ts": F.timestamp_micros("last_us"),
                               "first_code": F.col("first_code").cast("int")})
    return timed.select(*flows.flow_keys(), *flows.feature_columns())


def arrival_flows(packets: DataFrame, timeout_s: int = 60, by_clock: bool = False) -> DataFrame:
    """Keys and 46 features of each flow that a later packet has ended; ``pkt_id`` numbers packets as they arrived.

    ``by_clock`` also ends a flow when nothing has arrived for the timeout by the clock of the machine. Packets without
    an address take no part; a null size counts as 0. Batches must come in the order of arrival.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    rows = flows.packet_parts(packets).select(
        "flow_id", F.col("pkt_id").alias("arrival"), F.unix_micros("ts").alias("us"),
        *[whole(c) for c in ("code", "size", *flows.TCP_FLAGS, *flows.SERVICES)]).filter("us IS NOT NULL AND flow_id IS NOT NULL")
    ended = rows.groupBy("flow_id").transformWithStateInPandas(
        ArrivalFlows(timeout_s, by_clock), FLOW, "Append", "ProcessingTime" if by_clock else "None")
    return _features(ended)


def _state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Flows that a stopped query still held, read from its state."""
    held = _state(spark, checkpoint, "open")
    return _features(held.select(F.col("key.flow_id").alias("flow_id"), "value.*"))


BLOCKED = T.StructType([T.StructField("arrival", T.LongType()), T.StructField("us", T.LongType()), T.StructField("reason", T.StringType())])
CHANGE = T.StructType([T.StructField("src_ip", T.StringType()), *BLOCKED.fields, T.StructField("blocked", T.BooleanType())])


class BlockSet(StatefulProcessor):
    """One row per blocked source, gone when it is released or its time to live has passed."""

    def __init__(self, ttl_s: int | None):
        self.ttl_ms = ttl_s and ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("blocked", BLOCKED, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(rows).sort_values(["arrival", "block"], kind="stable")
        now, changes = (self.held.get() if self.held.exists() else None), []
        before = now
        for arrival, us, reason, block in events[["arrival", "us", "reason", "block"]].itertuples(index=False):
            if bool(block) != (now is not None):            # blocking the blocked and releasing the free change nothing
                now = (int(arrival), int(us), reason) if block else None
                changes.append((key[0], int(arrival), int(us), reason, bool(block)))
        if now is None:
            self.held.clear()
        elif now != before:
            self.held.update(now)
        if changes:
            yield pd.DataFrame(changes, columns=CHANGE.names)

    def close(self) -> None:
        pass


def block_changes(events: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """Changes of the block list from events (src_ip, arrival, ts, reason, block boolean): blocked or released, in order of arrival.

    An event without source, arrival, time or decision takes no part; of two events with one arrival number the release
    comes first. ``ttl_s`` releases a source that long after it was blocked, without an event; it may be blocked again then.
    """
    rows = events.select("src_ip", F.col("arrival").cast("long").alias("arrival"), F.unix_micros("ts").alias("us"),
                         F.coalesce("reason", F.lit("")).alias("reason"), "block").na.drop()
    changed = rows.groupBy("src_ip").transformWithStateInPandas(
        BlockSet(ttl_s), CHANGE, "Append", "ProcessingTime" if ttl_s else "None")
    return changed.withColumn("ts", F.timestamp_micros("us")).drop("us")


def block_set(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sources a stopped query holds as blocked, and since when."""
    held = _state(spark, checkpoint, "blocked")
    value = F.col("value.value") if "ttlExpirationMs" in held.schema["value"].dataType.names else F.col("value")
    return held.select(F.col("key.src_ip").alias("src_ip"), F.timestamp_micros(value["us"]).alias("blocked_at"),
                       value["arrival"].alias("first_flow"), value["reason"].alias("reason"))
