"""Flows and blocks in arrival order: against plain Python, over several batches, and after a stop."""

from __future__ import annotations

import time
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from netloom.operators import flows
from netloom.streaming import flows as stream
from netloom.streaming import live

PACKETS = "pkt_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto string, size int, tcp_flags int"
EVENTS = "src_ip string, arrival long, ts timestamp, reason string, block boolean"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def packet(number, second, source="10.0.0.1", target="10.0.1.1", size=100, proto="TCP", flags=2):
    return (number, START + timedelta(seconds=second), source, target, 1000, 80, proto, size, flags)


def land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def arriving(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def islands(rows, timeout):
    """(start, end, packets, bytes) per flow of one pair of addresses, walking the packets as they arrived."""
    out, before = [], None
    for _, ts, _, _, _, _, _, size, _ in rows:
        if before is None or (ts - before).total_seconds() >= timeout:
            out.append([ts, ts, 0, 0])
        out[-1] = [min(out[-1][0], ts), max(out[-1][1], ts), out[-1][2] + 1, out[-1][3] + size]
        before = ts
    return sorted((int((a - START).total_seconds()), int((b - START).total_seconds()), n, s) for a, b, n, s in out)


def shown(df):
    second = lambda c: (F.unix_micros(c) / 1_000_000 - START.timestamp()).cast("int")
    return sorted(tuple(r) for r in df.select(second("start_ts"), second("last_ts"), F.col("Number").cast("int"),
                                              F.col("Tot sum").cast("int")).collect())


@contextmanager
def running(source, out, kept):
    """A query on the machine's clock, which has no end of its own; yields a reader of its rows."""
    query = stream.start_append(source, out, kept, {"processingTime": "1 second"})
    try:
        yield lambda: source.sparkSession.read.schema(source.schema).parquet(out)
    finally:
        query.stop()


def until(reached, seconds=40):
    end = time.time() + seconds
    while time.time() < end:
        try:
            if reached():
                return True
        except AnalysisException:       # nothing written yet
            pass
        time.sleep(1)
    return False


def test_segments_of_one_batch():
    rows = pd.DataFrame({"arrival": [3, 1, 2], "us": [90, 0, 5], "code": [4, 0, 4], "size": [7, 1, 2],
                         **{c: [1, 0, 1] for c in flows.TCP_FLAGS}, **{c: [0, 1, 0] for c in flows.SERVICES}})
    goes_on, found = live.arrival_segments(rows, 60, None)
    assert not goes_on and [(f["n"], f["sum_size"], f["first_code"], f["seen_us"]) for f in found] == [(2, 3, 0, 5), (1, 7, 4, 90)]
    assert live.arrival_segments(rows, 60, -59)[0] and not live.arrival_segments(rows, 60, -60)[0]


def test_late_packets_stay_and_a_stop_loses_nothing(spark, tmp_path):
    """Times jump back and forth; the first batch is drained, the query stops, and goes on with the rest."""
    rng = np.random.default_rng(3)
    clock = np.cumsum(rng.choice([1, 5, 70], size=90, p=[.5, .4, .1])) - rng.choice([0, 30], size=90, p=[.8, .2])
    rows = [packet(i, int(s), size=int(10 + i)) for i, s in enumerate(clock)]
    folder, out, kept = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for part in (rows[:40], rows[40:]):
        land(spark, part, PACKETS, folder)
        ended = stream.run_append(live.arrival_flows(arriving(spark, PACKETS, folder), 60), "f", out, kept)
    assert ended.count() == len(islands(rows, 60)) - 1
    assert shown(ended.unionByName(live.open_flows(spark, kept))) == islands(rows, 60)


def test_odd_packets(spark, tmp_path):
    """No address: no flow. Null size counts 0, both directions are one flow, equal times keep the order of arrival."""
    folder, out, kept = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows = [packet(1, 0), (2, START, "10.0.1.1", "10.0.0.1", 80, 1000, "TCP", None, None), packet(3, 0, source=None),
            packet(4, 0, proto="ICMP"), packet(5, 500)]
    land(spark, rows, PACKETS, folder)
    ended = stream.run_append(live.arrival_flows(arriving(spark, PACKETS, folder), 60), "f", out, kept)
    assert shown(ended) == [(0, 0, 2, 100)]
    assert ended.first()["src_ip"] == "10.0.0.1"
    assert shown(live.open_flows(spark, kept)) == [(0, 0, 1, 100), (500, 500, 1, 100)]


def test_a_quiet_flow_leaves_by_the_clock(spark, tmp_path):
    folder, out, kept = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    land(spark, [packet(1, 0), packet(2, 1)], PACKETS, folder)
    source = live.arrival_flows(arriving(spark, PACKETS, folder), 2, by_clock=True)
    with running(source, out, kept) as seen:
        assert until(lambda: shown(seen()) == [(0, 1, 2, 200)])


def event(number, block, source="a", reason="DDoS"):
    return (source, number, START + timedelta(seconds=number), reason, block)


def test_block_release_block(spark, tmp_path):
    """Blocking twice and releasing the free change nothing; a stop in between loses nothing; released sources leave the state."""
    folder, out, kept = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    first = [event(3, True), event(1, True), event(2, False), event(4, True), event(1, False, "b"), event(2, True, "b"), (None, 1, START, "x", True)]
    then = [event(5, False), event(6, True, reason="Web"), event(3, False, "b"), event(7, None)]
    for part in (first, then):
        land(spark, part, EVENTS, folder)
        changes = stream.run_append(live.block_changes(arriving(spark, EVENTS, folder)), "b", out, kept)
    got = sorted((r["src_ip"], r["arrival"], r["blocked"]) for r in changes.collect())
    assert got == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 5, False), ("a", 6, True), ("b", 2, True), ("b", 3, False)]
    assert [(r["src_ip"], r["first_flow"], r["reason"]) for r in live.block_set(spark, kept).collect()] == [("a", 6, "Web")]


def test_blocks_have_a_time_to_live(spark, tmp_path):
    """Blocked again after the time has passed, which without a time to live changes nothing."""
    folder, out, kept = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    land(spark, [event(1, True)], EVENTS, folder)
    with running(live.block_changes(arriving(spark, EVENTS, folder), 2), out, kept) as seen:
        assert until(lambda: seen().count() == 1)
        time.sleep(3)
        land(spark, [event(2, True)], EVENTS, folder)
        assert until(lambda: seen().count() == 2)
        assert all(r["blocked"] for r in seen().collect())
