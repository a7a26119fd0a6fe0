"""Structured Streaming queries, drained over the whole input table."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import encode, flows, models
from netloom.operators.blocks import n_tasks
from netloom.plans.q_alerts import DECIDED, decided
from netloom.plans.q_flows import DAY, KEYED_SQL, RECORD_SQL, features_sql, segmented_sql, shown
from netloom.plans.registry import query
from netloom.plans.views import VIEW_SQL, table, view
from netloom.session import scratch
from netloom.sources.readers import packet_stream
from netloom.streaming import flows as stream
from netloom.streaming import live

SHOWN = ["Number", "Tot sum", "Std", "IAT", "syn_count"]


def events_stream(spark, sf):
    return packet_stream(spark, sf, table(spark, sf, "events").schema, pathGlobFilter="events.parquet")


def view_stream(spark, sf, name):
    return spark.sql(VIEW_SQL[name], events=events_stream(spark, sf))


def emitted(spark, sf):
    return stream.run_append(stream.flow_stream(view_stream(spark, sf, "packets"), DAY), "flows")


# the last watermark is the latest packet minus ten minutes, in whole milliseconds
CLOSED = "(SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 FROM packets)"


@query("t2_timeout_emission", "packets", f"""{segmented_sql(DAY)}, {RECORD_SQL}
SELECT flow_id, epoch_us(start_ts) AS start_us, epoch_us(last_ts) AS last_us, n FROM records
WHERE epoch_us(last_ts) + {DAY * 1_000_000 - 1} <= {CLOSED}""")
def _(spark, sf):
    return emitted(spark, sf).select("flow_id", F.unix_micros("start_ts").alias("start_us"),
                                     F.unix_micros("last_ts").alias("last_us"), F.col("Number").alias("n"))


@query("t3_flush_at_end", "packets", features_sql(DAY, SHOWN))
def _(spark, sf):
    out = emitted(spark, sf)
    tail = stream.flush_tail(view(spark, sf, "packets"), out, DAY)
    return shown(out.unionByName(tail), SHOWN)


@query("t1_session_batch_form", "packets", features_sql(DAY, SHOWN))
def _(spark, sf):
    return shown(stream.flow_stream(view(spark, sf, "packets"), DAY), SHOWN)


@query("t4_scored_stream", "packets", f"""{segmented_sql(DAY)}, {RECORD_SQL}
SELECT proto AS protocol, CASE proto WHEN 'TCP' THEN 'DDoS' WHEN 'UDP' THEN 'DoS' ELSE 'Benign' END AS predicted_class,
  proto IN ('TCP', 'UDP') AS is_attack, count(*) AS n FROM records GROUP BY proto
UNION ALL SELECT 'blocked sources', '', true, count(DISTINCT src_ip) FILTER (WHERE proto IN ('TCP', 'UDP')) FROM records""")
def _(spark, sf):
    """A tree learned on the batch flows scores the same flows as they leave the stream, and those still open at its end."""
    known = flows.flow_features(view(spark, sf, "packets"), DAY).withColumn(
        models.LABEL, F.when(F.col("TCP") == 1, 2).when(F.col("UDP") == 1, 3).otherwise(0))
    scaler = encode.fit_scaler(known, flows.FEATURES)
    rows = stream.scaled_training_rows(known, scaler)
    model = models.fit(models.decision_tree(stream.scaled_names(scaler), max_depth=5), rows)
    packets = view(spark, sf, "packets")
    scored, blocked = stream.monitor(view_stream(spark, sf, "packets"), model, scaler, scratch(spark, "monitor"), DAY, recorded=packets)
    per_class = scored.groupBy("protocol", "predicted_class", "is_attack").agg(F.count(F.lit(1)).alias("n"))
    sources = blocked.agg(F.count(F.lit(1)).alias("n"))
    return per_class.unionByName(sources.select(
        F.lit("blocked sources").alias("protocol"), F.lit("").alias("predicted_class"), F.lit(True).alias("is_attack"), "n"))


def decided_stream(spark, sf):
    from netloom.operators import alerts
    return alerts.decide(view_stream(spark, sf, "decided"))


@query("t5_block_stream", "decided", f"{DECIDED} SELECT DISTINCT src_ip FROM alerts WHERE blocked")
def _(spark, sf):
    return stream.run_append(stream.block_stream(decided_stream(spark, sf)), "blocks").select("src_ip")


@query("t6_running_counters", "decided", f"""{DECIDED}
SELECT count(*) AS flows_completed, count(*) FILTER (WHERE is_attack) AS attacks_detected,
  count(*) FILTER (WHERE NOT is_attack) AS benign_flows, count(*) FILTER (WHERE blocked) AS blocked_flows FROM alerts""")
def _(spark, sf):
    return stream.run_counters(stream.counter_stream(decided_stream(spark, sf)), "counters")


@query("t7_timeline_stream", "decided", f"""{DECIDED}
SELECT epoch_us(date_trunc('hour', ts)) AS hour, is_attack, count(*) AS n FROM alerts
GROUP BY 1, 2 HAVING epoch_us(date_trunc('hour', ts)) + 3600000000 <= (SELECT (epoch_us(max(ts)) // 1000 - 600000) * 1000 FROM alerts)""")
def _(spark, sf):
    out = stream.run_append(stream.timeline_stream(decided_stream(spark, sf)), "timeline")
    return out.withColumn("hour", F.unix_micros("hour"))


@query("s14_packet_stream", "packets", "SELECT proto, count(*) AS n FROM packets GROUP BY proto")
def _(spark, sf):
    out = stream.run_append(view_stream(spark, sf, "packets"), "packets")
    return out.groupBy("proto").agg(F.count(F.lit(1)).alias("n"))


@query("a32_stream_equals_batch", "decided", f"""{DECIDED} SELECT count(*) FILTER (WHERE blocked) AS n FROM alerts""")
def _(spark, sf):
    streamed = stream.run_counters(stream.counter_stream(decided_stream(spark, sf)), "counters").select("blocked_flows")
    batch = decided(spark, sf).agg(F.count_if("blocked").alias("n"))
    return batch.join(streamed, F.col("n") == F.col("blocked_flows")).select("n")


@query("s14_packet_limit", "packets", "SELECT least(count(*), 1000) AS n FROM packets")
def _(spark, sf):
    """A live run may end after a number of packets."""
    out = stream.run_append(view_stream(spark, sf, "packets").limit(1000), "packets")
    return out.agg(F.count(F.lit(1)).alias("n"))


SLICE_TASK = 500_000              # packets that one task writes, and one task of the stream reads


def write_slice(packets, folder):
    """One slice as files of bounded size, written by all cores."""
    n = n_tasks(packets, packets.count(), most=SLICE_TASK)
    packets.repartition(n, "pkt_id").write.mode("append").parquet(folder)


@query("s14_many_files", "packets", features_sql(DAY, SHOWN))
def _(spark, sf):
    """Packets arriving in four slices of time, each as several files and in one batch; open flows are flushed at the end."""
    folder, rows = scratch(spark, "arriving"), view(spark, sf, "packets")
    out, kept = scratch(spark, "flows-out"), scratch(spark, "flows-ckpt")
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    edge = [low + (high + 1 - low) * i // 4 for i in range(5)]
    for i in range(4):                      # the stream goes on from its folders with what has arrived since
        write_slice(rows.filter((F.unix_micros("ts") >= edge[i]) & (F.unix_micros("ts") < edge[i + 1])), folder)
        done = stream.run_append(stream.flow_stream(packet_stream(spark, folder, rows.schema), DAY), "flows", out, kept)
    return shown(done.unionByName(stream.flush_tail(rows, done, DAY)), SHOWN)


@query("t7_kpi_refresh", "decided", f"""{DECIDED}
SELECT count(*) AS total_flows, count(*) FILTER (WHERE is_attack) AS attack_count, count(*) FILTER (WHERE blocked) AS blocked_flows,
  count(DISTINCT src_ip) FILTER (WHERE blocked) AS blocked_ips, count(DISTINCT src_ip) AS unique_ips, round(avg(confidence), 6) AS avg_confidence,
  round(100.0 * count(*) FILTER (WHERE is_attack) / count(*), 6) AS attack_rate FROM alerts""")
def _(spark, sf):
    per_source = stream.run_counters(stream.kpi_stream(decided_stream(spark, sf)), "kpis")
    return stream.kpis_of(per_source).select("total_flows", "attack_count", "blocked_flows", "blocked_ips", "unique_ips",
                                             F.round("avg_confidence", 6).alias("avg_confidence"), F.round("attack_rate", 6).alias("attack_rate"))


ARRIVED = f"""gaps AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY flow_id ORDER BY pkt_id)) AS gap FROM keyed),
numbered AS (SELECT *, sum(CASE WHEN gap >= {DAY * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY flow_id ORDER BY pkt_id ROWS UNBOUNDED PRECEDING) AS part FROM gaps)"""


@query("t1_arrival_flows", "packets", f"""{KEYED_SQL}, {ARRIVED}
SELECT flow_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n, CAST(sum(size) AS BIGINT) AS total,
  CAST(max(size) AS BIGINT) AS largest, CAST(count(*) FILTER (WHERE proto = 'TCP' AND tcp_flags & 2 > 0) AS BIGINT) AS syn_count,
  first(src_ip ORDER BY pkt_id) AS src_ip FROM numbered GROUP BY flow_id, part""")
def _(spark, sf):
    """Flows in the order packets arrive, however late their times; those still open are read from the state."""
    kept = scratch(spark, "arrival-ckpt")
    ended = stream.run_append(live.arrival_flows(view_stream(spark, sf, "packets"), DAY), "arrival", checkpoint=kept)
    return ended.unionByName(live.open_flows(spark, kept)).select(
        "flow_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), F.col("Number").alias("n"),
        F.col("Tot sum").alias("total"), F.col("Max").alias("largest"), "syn_count", "src_ip")


# a source is blocked by a blocking flow and released by a benign one that is nearly certain
BLOCK_EVENTS = f"""{DECIDED},
happened AS (SELECT src_ip, event_id, ts, blocked, lag(blocked) OVER (PARTITION BY src_ip ORDER BY event_id) AS before FROM alerts
  WHERE blocked OR (NOT is_attack AND confidence >= 0.9)),
changed AS (SELECT src_ip, event_id, ts, blocked FROM happened WHERE blocked <> coalesce(before, false))"""


def block_events(spark, sf):
    rows = decided_stream(spark, sf).filter("blocked OR (NOT is_attack AND confidence >= 0.9)")
    return rows.select("src_ip", F.col("event_id").alias("arrival"), "ts", F.col("predicted_class").alias("reason"), F.col("blocked").alias("block"))


@query("t8_live_changes", "decided", f"{BLOCK_EVENTS} SELECT src_ip, event_id AS arrival, epoch_us(ts) AS us, blocked FROM changed")
def _(spark, sf):
    out = stream.run_append(live.block_changes(block_events(spark, sf)), "changes")
    return out.select("src_ip", "arrival", F.unix_micros("ts").alias("us"), "blocked")


@query("t8_live_block_set", "decided", f"""{BLOCK_EVENTS}
SELECT src_ip, first_flow, us FROM (SELECT src_ip, max(event_id) AS first_flow, epoch_us(max_by(ts, event_id)) AS us, max_by(blocked, event_id) AS b FROM changed GROUP BY src_ip) WHERE b""")
def _(spark, sf):
    """The block list after all blocks and releases, as the stopped query holds it."""
    kept = scratch(spark, "blocks-ckpt")
    stream.run_append(live.block_changes(block_events(spark, sf)), "changes", checkpoint=kept)
    return live.block_set(spark, kept).select("src_ip", "first_flow", F.unix_micros("blocked_at").alias("us"))
