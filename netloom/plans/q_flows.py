"""Packet keys, flags and flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions.columns import col
from netloom.operators import flows
from netloom.plans.registry import query
from netloom.plans.views import view

DAY = 86_400
FLOAT_FEATURES = {"flow_duration", "Header_Length", "Duration", "Rate", "Srate", "Drate", "AVG", "Std",
                  "IAT", "Magnitue", "Radius", "Covariance", "Variance", "Weight"}

EXACT = {"flow_duration", "Duration"}     # whole microseconds


def digits(feature: str) -> int:
    return 6 if feature in EXACT else 4


# Fixed values as the twin knows them, written out here so that an error in the library's own tables shows.
FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
SERVICE_PORTS = {"HTTP": ("TCP", 80), "HTTPS": ("TCP", 443), "DNS": ("UDP", 53), "SSH": ("TCP", 22)}
NEVER_SET = ("Telnet", "SMTP", "IRC", "DHCP", "ARP", "LLC")

KEYED_SQL = """
ends AS (SELECT *, proto IN ('TCP', 'UDP') AS has_ports,
  CASE WHEN proto IN ('TCP', 'UDP') THEN src_port ELSE 0 END AS sp,
  CASE WHEN proto IN ('TCP', 'UDP') THEN dst_port ELSE 0 END AS dp FROM packets),
keyed AS (SELECT *, concat(CASE WHEN has_ports THEN proto ELSE 'OTHER' END, '_',
  CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND sp <= dp)
       THEN concat(src_ip, ':', CAST(sp AS VARCHAR), '_', dst_ip, ':', CAST(dp AS VARCHAR))
       ELSE concat(dst_ip, ':', CAST(dp AS VARCHAR), '_', src_ip, ':', CAST(sp AS VARCHAR)) END) AS flow_id FROM ends)"""


def segmented_sql(seconds: int) -> str:
    return f"""{KEYED_SQL},
lagged AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM keyed WINDOW w AS (PARTITION BY flow_id ORDER BY ts, pkt_id)),
segmented AS (SELECT *, sum(CASE WHEN gap >= {seconds * 1_000_000} THEN 1 ELSE 0 END)
  OVER (PARTITION BY flow_id ORDER BY ts, pkt_id ROWS UNBOUNDED PRECEDING) AS segment FROM lagged)"""


def _bit(name):
    mask = FLAG_BITS[name]
    return f"count(*) FILTER (WHERE proto = 'TCP' AND (tcp_flags & {mask}) > 0)"


def _port(proto, port):
    return f"max(CASE WHEN proto = '{proto}' AND (src_port = {port} OR dst_port = {port}) THEN 1 ELSE 0 END)"


# Raw packets again, independently of how the library merges partial slots.
RECORD_SQL = f"""records AS (SELECT flow_id, segment, min(ts) AS start_ts, max(ts) AS last_ts,
  arg_min(src_ip, (ts, pkt_id)) AS src_ip, arg_min(dst_ip, (ts, pkt_id)) AS dst_ip, arg_min(proto, (ts, pkt_id)) AS proto,
  count(*) AS n, CAST(sum(size) AS BIGINT) AS total, CAST(min(size) AS BIGINT) AS smin, CAST(max(size) AS BIGINT) AS smax,
  avg(size) AS mean, stddev_pop(size) AS sd, var_pop(size) AS va,
  coalesce(avg(CASE WHEN gap IS NOT NULL AND NOT fresh THEN gap / 1e6 END), 0) AS iat,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS secs,
  {', '.join(f"{_bit(f)} AS {f}" for f in FLAG_BITS)},
  {', '.join(f'{_port(*v)} AS "{k}"' for k, v in SERVICE_PORTS.items())}
  FROM (SELECT *, row_number() OVER (PARTITION BY flow_id, segment ORDER BY ts, pkt_id) = 1 AS fresh FROM segmented) s
  GROUP BY flow_id, segment)"""

_EXPR = {
    "flow_duration": "secs", "Header_Length": "CAST(40 AS DOUBLE)", "Duration": "secs",
    "Protocol Type": "CASE proto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END",
    "Rate": "n / greatest(secs, 0.001)", "Srate": "n / 2.0 / greatest(secs, 0.001)",
    "Drate": "n / 2.0 / greatest(secs, 0.001)",
    **{f"{f}_flag_number": f for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")},
    **{f"{f}_count": f for f in ("ack", "syn", "fin", "urg", "rst")},
    **{s: f'"{s}"' for s in SERVICE_PORTS},
    **{p: f"CASE WHEN proto = '{p}' THEN 1 ELSE 0 END" for p in ("TCP", "UDP", "ICMP")},
    **{a: "0" for a in NEVER_SET}, "IPv": "4", "Tot sum": "total", "Tot size": "total", "Min": "smin", "Max": "smax",
    "AVG": "mean", "Std": "sd", "IAT": "iat", "Number": "n", "Magnitue": "sqrt(total)", "Radius": "mean / 2",
    "Covariance": "va", "Variance": "va", "Weight": "total / CAST(n AS DOUBLE)",
}


def features_sql(seconds: int, names) -> str:
    shown = ", ".join((f"round({_EXPR[f]}, {digits(f)})" if f in FLOAT_FEATURES else _EXPR[f]) + f' AS "{f}"' for f in names)
    return f"""{segmented_sql(seconds)}, {RECORD_SQL}
SELECT flow_id, epoch_us(start_ts) AS start_us, {shown} FROM records"""


def shown(df, names):
    return df.select("flow_id", F.unix_micros("start_ts").alias("start_us"),
                     *[F.round(col(f), digits(f)).alias(f) if f in FLOAT_FEATURES else col(f) for f in names])


@query("s13_packet_scan", "packets", """SELECT proto, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes,
  epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM packets GROUP BY proto""")
def _(spark, sf):
    return view(spark, sf, "packets").groupBy("proto").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("p14_flow_key", "packets", f"{KEYED_SQL} SELECT pkt_id, flow_id FROM keyed")
def _(spark, sf):
    return flows.with_flow_id(view(spark, sf, "packets")).select("pkt_id", "flow_id")


@query("p15_protocol_class", "packets", """SELECT pkt_id,
  CASE WHEN proto IN ('TCP', 'UDP', 'ICMP') THEN proto ELSE 'OTHER' END AS proto_class,
  CASE proto WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 ELSE 1 END AS proto_number FROM packets""")
def _(spark, sf):
    return flows.with_protocol_class(view(spark, sf, "packets")).select("pkt_id", "proto_class", "proto_number")


@query("p16_tcp_flags", "packets", "SELECT pkt_id, " + ", ".join(
    f"CASE WHEN proto = 'TCP' AND (tcp_flags & {m}) > 0 THEN 1 ELSE 0 END AS {f}"
    for f, m in FLAG_BITS.items()) + " FROM packets")
def _(spark, sf):
    return flows.with_flag_columns(view(spark, sf, "packets")).select("pkt_id", *flows.TCP_FLAGS)


@query("p17_service_flags", "packets", "SELECT pkt_id, " + ", ".join(
    f"CASE WHEN proto = '{p}' AND (src_port = {n} OR dst_port = {n}) THEN 1 ELSE 0 END AS \"{s}\""
    for s, (p, n) in SERVICE_PORTS.items()) + " FROM packets")
def _(spark, sf):
    return flows.with_service_columns(view(spark, sf, "packets")).select("pkt_id", *flows.SERVICES)


for _hours in (1, 6, 24):
    @query(f"w11_segments_{_hours}h", "packets", f"""{segmented_sql(_hours * 3600)}
SELECT flow_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n
FROM segmented GROUP BY flow_id, segment""")
    def _(spark, sf, seconds=_hours * 3600):
        return flows.flow_records(view(spark, sf, "packets"), seconds).select(
            "flow_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query("w11_segments_60s", "packets", f"""{segmented_sql(60)}
SELECT flow_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM segmented GROUP BY flow_id, segment""")
def _(spark, sf):
    """The default timeout."""
    return flows.flow_records(view(spark, sf, "packets"), 60).select(
        "flow_id", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query("w11_inter_arrival", "packets", f"""{KEYED_SQL}
SELECT pkt_id, flow_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY flow_id ORDER BY ts, pkt_id)) AS gap_us FROM keyed""")
def _(spark, sf):
    return flows.inter_arrival(view(spark, sf, "packets"), 60).select("pkt_id", "flow_id", "gap_us")


@query("t1_flow_endpoints", "packets", f"""{segmented_sql(DAY)}, {RECORD_SQL}
SELECT flow_id, epoch_us(start_ts) AS start_us, src_ip, dst_ip, proto AS protocol FROM records""")
def _(spark, sf):
    return flows.flow_features(view(spark, sf, "packets"), DAY).select(
        "flow_id", F.unix_micros("start_ts").alias("start_us"), "src_ip", "dst_ip", "protocol")


GROUPS = {
    "g1_duration": ["flow_duration", "Duration"], "g2_constants": ["Header_Length", "IPv"],
    "g3_protocol_type": ["Protocol Type"], "g4_rate": ["Rate"], "g5_srate_drate": ["Srate", "Drate"],
    "g6_flag_numbers": [f"{f}_flag_number" for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")],
    "g7_flag_counts": [f"{f}_count" for f in ("ack", "syn", "fin", "urg", "rst")],
    "g8_services": list(flows.SERVICES), "g9_protocol_onehot": ["TCP", "UDP", "ICMP"],
    "g10_absent": list(flows.ABSENT), "g11_totals": ["Tot sum", "Tot size"], "g12_min_max_avg": ["Min", "Max", "AVG"],
    "g13_std": ["Std"], "g14_iat": ["IAT"], "g15_number": ["Number"], "g16_magnitude": ["Magnitue"],
    "g17_radius": ["Radius"], "g18_variance": ["Covariance", "Variance"], "g19_weight": ["Weight"],
    "g_all_46_features": flows.FEATURES,
}
for _name, _feats in GROUPS.items():
    @query(_name, "packets", features_sql(DAY, _feats))
    def _(spark, sf, names=_feats):
        return shown(flows.flow_features(view(spark, sf, "packets"), DAY), names)


@query("g_all_46_features_60s", "packets", features_sql(60, flows.FEATURES))
def _(spark, sf):
    return shown(flows.flow_features(view(spark, sf, "packets"), 60), flows.FEATURES)


@query("g14_iat_compat", "packets", f"""{segmented_sql(DAY)}
SELECT flow_id, epoch_us(min(ts)) AS start_us, CAST(0 AS DOUBLE) AS "IAT" FROM segmented GROUP BY flow_id, segment""")
def _(spark, sf):
    return shown(flows.flow_features(view(spark, sf, "packets"), DAY, iat_compat=True), ["IAT"])
