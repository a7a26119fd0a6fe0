"""Alert, block-list and traffic-summary queries over decided flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import alerts
from netloom.plans.registry import query
from netloom.plans.views import view

DECIDED = """alerts AS (SELECT *, predicted_class <> 'Benign' AS is_attack,
  predicted_class <> 'Benign' AND confidence >= 0.8 AS blocked FROM decided)"""
R6 = lambda c: F.round(c, 6)


def decided(spark, sf):
    return alerts.decide(view(spark, sf, "decided"))


def stamp(df, *names):
    return df.withColumns({n: F.unix_micros(n) for n in names})


@query("p19_alert_decision", "decided", f"{DECIDED} SELECT event_id, predicted_class, is_attack, blocked FROM alerts")
def _(spark, sf):
    return decided(spark, sf).select("event_id", "predicted_class", "is_attack", "blocked")


@query("p13_attack_filter", "decided", f"{DECIDED} SELECT event_id, src_ip FROM alerts WHERE is_attack AND NOT blocked")
def _(spark, sf):
    return decided(spark, sf).filter("is_attack AND NOT blocked").select("event_id", "src_ip")


@query("a16_traffic_kpis", "decided", f"""{DECIDED},
k AS (SELECT count(*) AS total_flows, count(*) FILTER (WHERE NOT is_attack) AS benign_count, count(*) FILTER (WHERE is_attack) AS attack_count,
  count(*) FILTER (WHERE blocked) AS blocked_flows, count(DISTINCT src_ip) FILTER (WHERE blocked) AS blocked_ips,
  round(avg(confidence), 6) AS avg_confidence, count(DISTINCT src_ip) AS unique_ips FROM alerts)
SELECT *, round(100.0 * attack_count / total_flows, 6) AS attack_rate, round(100.0 * blocked_flows / attack_count, 6) AS block_rate FROM k""")
def _(spark, sf):
    return alerts.traffic_kpis(decided(spark, sf)).withColumns(
        {c: R6(c) for c in ("avg_confidence", "attack_rate", "block_rate")})


@query("a17_attack_breakdown", "decided", f"{DECIDED} SELECT predicted_class, count(*) AS n FROM alerts WHERE is_attack GROUP BY 1")
def _(spark, sf):
    return alerts.attack_breakdown(decided(spark, sf))


@query("a18_attack_pair", "decided", f"""{DECIDED}
SELECT 'Benign' AS kind, count(*) FILTER (WHERE NOT is_attack) AS n FROM alerts
UNION ALL SELECT 'Attack', count(*) FILTER (WHERE is_attack) FROM alerts""")
def _(spark, sf):
    return alerts.attack_pair(decided(spark, sf))


@query("a19_hourly_timeline", "decided", f"""{DECIDED}
SELECT epoch_us(date_trunc('hour', ts)) AS hour, is_attack, count(*) AS n FROM alerts GROUP BY 1, 2""")
def _(spark, sf):
    return stamp(alerts.timeline(decided(spark, sf)), "hour")


@query("a20_confidence_histogram", "decided", f"""{DECIDED}
SELECT is_attack, CAST(least(floor(confidence * 20), 19) AS INT) AS bin, count(*) AS n FROM alerts GROUP BY 1, 2""")
def _(spark, sf):
    return alerts.confidence_histogram(decided(spark, sf))


@query("a21_blocked_sources", "decided", f"""{DECIDED}
SELECT src_ip, epoch_us(min(ts)) AS first_seen, epoch_us(max(ts)) AS last_seen, count(*) AS attack_count,
  string_agg(DISTINCT predicted_class, ', ' ORDER BY predicted_class) AS attack_types, round(avg(confidence), 6) AS avg_confidence
FROM alerts WHERE blocked GROUP BY src_ip""")
def _(spark, sf):
    return stamp(alerts.blocked_sources(decided(spark, sf)), "first_seen", "last_seen").withColumn(
        "avg_confidence", R6("avg_confidence"))


@query("a32_run_statistics", "decided packets", f"""{DECIDED}
SELECT (SELECT count(*) FROM packets) AS packets_processed, count(*) AS flows_completed, count(*) FILTER (WHERE is_attack) AS attacks_detected,
  count(*) FILTER (WHERE NOT is_attack) AS benign_flows, count(DISTINCT src_ip) FILTER (WHERE blocked) AS ips_blocked,
  round(100.0 * count(*) FILTER (WHERE is_attack) / count(*), 6) AS attack_rate FROM alerts""")
def _(spark, sf):
    return alerts.run_statistics(decided(spark, sf), view(spark, sf, "packets")).withColumn("attack_rate", R6("attack_rate"))


@query("w3_top_sources", "decided", f"""{DECIDED}
SELECT src_ip, count(*) AS n FROM alerts WHERE is_attack GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 10""")
def _(spark, sf):
    return alerts.top_sources(decided(spark, sf), 10)


@query("w4_recent_attacks", "decided", f"""{DECIDED}
SELECT event_id, epoch_us(ts) AS ts, src_ip, dst_ip, predicted_class, confidence, blocked FROM alerts
WHERE is_attack ORDER BY ts DESC, event_id DESC LIMIT 50""")
def _(spark, sf):
    rows = alerts.recent(decided(spark, sf), 50, attacks_only=True)
    return stamp(rows.select("event_id", "ts", "src_ip", "dst_ip", "predicted_class", "confidence", "blocked"), "ts")


@query("w4_recent_flows", "decided", f"""{DECIDED}
SELECT event_id, epoch_us(ts) AS ts, src_ip, is_attack, blocked FROM alerts ORDER BY ts DESC, event_id DESC LIMIT 100""")
def _(spark, sf):
    rows = alerts.recent(decided(spark, sf), 100)
    return stamp(rows.select("event_id", "ts", "src_ip", "is_attack", "blocked"), "ts")


BLOCKS = f"""{DECIDED}, blocks AS (SELECT src_ip, arg_min(event_id, (ts, event_id)) AS first_flow FROM alerts WHERE blocked GROUP BY src_ip)"""


@query("t5_block_once", "decided", f"""{BLOCKS}
SELECT b.src_ip, epoch_us(ts) AS blocked_at, first_flow, concat(predicted_class, ' (', CAST(round(CAST(confidence AS DECIMAL(10, 6)), 2) AS DECIMAL(10, 2)), ')') AS reason
FROM blocks b JOIN alerts a ON a.event_id = b.first_flow""")
def _(spark, sf):
    return stamp(alerts.block_list(decided(spark, sf)), "blocked_at")


@query("t8_unblock", "decided", f"""{BLOCKS}
SELECT src_ip, first_flow FROM blocks WHERE src_ip NOT IN (SELECT src_ip FROM alerts WHERE NOT is_attack AND confidence >= 0.97)""")
def _(spark, sf):
    flows = decided(spark, sf)
    return alerts.unblock(alerts.block_list(flows), flows.filter("NOT is_attack AND confidence >= 0.97")).select("src_ip", "first_flow")


@query("t9_blocked_count", "decided", f"{DECIDED} SELECT count(DISTINCT src_ip) AS n_blocked FROM alerts WHERE blocked")
def _(spark, sf):
    return alerts.block_list(decided(spark, sf)).agg(F.count(F.lit(1)).alias("n_blocked"))
