"""Packets to flow records: keys, gap segmentation, 46 features.

A hot flow may hold a third of all packets, so no window ever runs over raw
packets. Packets are first reduced per (flow, time slot), with slots no wider
than the timeout: two packets of one slot are always closer than the timeout,
so a slot never has to be split. Segmentation then looks at slot edges only,
at most one row per flow and timeout of wall-clock time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from netloom.functions.columns import col

# Feature names, in the order models expect them.
FEATURES = [
    "flow_duration", "Header_Length", "Protocol Type", "Duration", "Rate", "Srate", "Drate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number", "ack_flag_number",
    "ece_flag_number", "cwr_flag_number", "ack_count", "syn_count", "fin_count", "urg_count",
    "rst_count", "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP",
    "ARP", "ICMP", "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT",
    "Number", "Magnitue", "Radius", "Covariance", "Variance", "Weight",
]
# TCP header flag bits, service ports, protocol numbers.
TCP_FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
SERVICES = {"HTTP": ("TCP", 80), "HTTPS": ("TCP", 443), "SSH": ("TCP", 22), "DNS": ("UDP", 53)}
PROTOCOL_NUMBER = {"TCP": 6, "UDP": 17}
HEADER_BYTES, IP_VERSION, OTHER_PROTOCOL = 40, 4, 1
MIN_DURATION = 0.001
ABSENT = ("Telnet", "SMTP", "IRC", "DHCP", "ARP", "LLC")


def with_protocol_class(packets: DataFrame) -> DataFrame:
    """TCP, UDP, ICMP or OTHER, and the protocol number (1 unless TCP or UDP)."""
    known = F.when(F.col("proto").isin("TCP", "UDP", "ICMP"), F.col("proto")).otherwise("OTHER")
    number = F.when(F.col("proto") == "TCP", 6).when(F.col("proto") == "UDP", 17).otherwise(OTHER_PROTOCOL)
    return packets.withColumn("proto_class", known).withColumn("proto_number", number)


def with_flow_id(packets: DataFrame) -> DataFrame:
    """Direction-free key: protocol, then both endpoints in (text, number) order."""
    has_ports = F.col("proto").isin("TCP", "UDP")
    end = lambda side: F.struct(F.col(f"{side}_ip").alias("ip"),
                                F.when(has_ports, F.col(f"{side}_port")).otherwise(0).alias("port"))
    low, high = F.least(end("src"), end("dst")), F.greatest(end("src"), end("dst"))
    text = lambda e: F.concat(e["ip"], F.lit(":"), e["port"].cast("string"))
    prefix = F.when(has_ports, F.col("proto")).otherwise("OTHER")
    return packets.withColumns({"flow_id": F.concat_ws("_", prefix, text(low), text(high)),
                                "from_low": end("src") <= end("dst")})


def with_flag_columns(packets: DataFrame) -> DataFrame:
    """One 0/1 column per TCP flag; only TCP packets carry flags."""
    return packets.withColumns({
        name: F.when(F.col("proto") == "TCP", (F.col("tcp_flags").bitwiseAND(mask) > 0).cast("int"))
               .otherwise(0)
        for name, mask in TCP_FLAGS.items()})


def with_service_columns(packets: DataFrame) -> DataFrame:
    return packets.withColumns({
        name: ((F.col("proto") == proto)
               & ((F.col("src_port") == port) | (F.col("dst_port") == port))).cast("int")
        for name, (proto, port) in SERVICES.items()})


PROTOCOLS = ("TCP", "UDP", "ICMP", "OTHER")


def packet_parts(packets: DataFrame) -> DataFrame:
    """Packets with their key, flags and the two columns that find a flow's first packet.

    ``order`` ranks packets by (ts, pkt_id) and ``code`` packs the packet's
    direction and protocol. Both have a fixed width, so the aggregation over
    them stays a hash aggregation without a sort.
    """
    usable = packets.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    keyed = with_service_columns(with_flag_columns(with_flow_id(usable)))
    proto = F.when(F.col("proto") == "TCP", 0).when(F.col("proto") == "UDP", 1).when(F.col("proto") == "ICMP", 2).otherwise(3)
    order = (F.unix_micros("ts").cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")
             + F.col("pkt_id").cast("decimal(19,0)")).cast("decimal(38,0)")
    return keyed.withColumns({"code": proto + F.when(F.col("from_low"), 0).otherwise(4), "order": order})


def partial_aggregates():
    """Mergeable measures of a set of packets; integers, so merging is exact."""
    size = F.col("size").cast("long")
    return [F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"),
            F.min_by("code", "order").alias("first_code"), F.min("order").alias("first_order"),
            F.count(F.lit(1)).alias("n"), F.sum(size).alias("sum_size"),
            F.sum(size * size).alias("sum_sq"), F.min(size).alias("min_size"),
            F.max(size).alias("max_size"),
            *[F.sum(name).alias(name) for name in TCP_FLAGS],
            *[F.max(name).alias(name) for name in SERVICES]]


def _merge_aggregates():
    return [F.min("start_ts").alias("start_ts"), F.max("last_ts").alias("last_ts"),
            F.min_by("first_code", "first_order").alias("first_code"), F.sum("n").alias("n"),
            F.sum("sum_size").alias("sum_size"), F.sum(F.col("sum_sq").cast("decimal(38,0)")).alias("sum_sq"),
            F.min("min_size").alias("min_size"), F.max("max_size").alias("max_size"),
            *[F.sum(name).alias(name) for name in TCP_FLAGS],
            *[F.max(name).alias(name) for name in SERVICES]]


def slot_partials(packets: DataFrame, timeout_s: int) -> DataFrame:
    """One row per flow and time slot of the timeout's width."""
    slot = F.floor(F.unix_micros("ts") / F.lit(timeout_s * 1_000_000)).cast("long")
    return (packet_parts(packets).withColumn("slot", slot)
            .groupBy("flow_id", "slot").agg(*partial_aggregates()))


def segment_slots(partials: DataFrame, timeout_s: int) -> DataFrame:
    """Number the segments of a flow: a new one after a gap >= timeout."""
    timeline = W.partitionBy("flow_id").orderBy("slot")
    gap = F.unix_micros("start_ts") - F.unix_micros(F.lag("last_ts").over(timeline))
    return (partials.withColumn("_new", F.coalesce((gap >= timeout_s * 1_000_000).cast("int"), F.lit(0)))
            .withColumn("segment", F.sum("_new").over(timeline.rowsBetween(W.unboundedPreceding, 0)))
            .drop("_new"))


def flow_records(packets: DataFrame, timeout_s: int = 60) -> DataFrame:
    """One row of merged measures per flow and segment."""
    return merged_slots(slot_partials(packets, timeout_s), timeout_s)


def merged_slots(slots: DataFrame, timeout_s: int = 60) -> DataFrame:
    return segment_slots(slots, timeout_s).groupBy("flow_id", "segment").agg(*_merge_aggregates())


def feature_columns(iat_compat: bool = False):
    """The 46 features from merged measures.

    The mean inter-arrival time is (last - first) / (n - 1): the differences
    telescope. ``iat_compat`` yields 0, as the original capture tool did.
    """
    n, size_sum = F.col("n").cast("double"), F.col("sum_size").cast("double")
    seconds = (F.unix_micros("last_ts") - F.unix_micros("start_ts")).cast("double") / 1e6
    span = F.greatest(seconds, F.lit(MIN_DURATION))
    mean = size_sum / n
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # n * sum(x^2) - sum(x)^2 in whole numbers: no cancellation
    spread = (wide("n") * wide("sum_sq") - wide("sum_size") * wide("sum_size")).cast("double")
    variance = spread / (n * n)
    proto = first_protocol()
    iat = F.when(F.col("n") > 1, seconds / (n - 1)).otherwise(0.0)
    values = {
        "flow_duration": seconds, "Duration": seconds,
        "Header_Length": F.lit(float(HEADER_BYTES)), "IPv": F.lit(IP_VERSION),
        "Protocol Type": F.when(proto == "TCP", 6).when(proto == "UDP", 17).otherwise(OTHER_PROTOCOL),
        "Rate": n / span, "Srate": n / 2 / span, "Drate": n / 2 / span,
        **{f"{f}_flag_number": F.col(f) for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")},
        **{f"{f}_count": F.col(f) for f in ("ack", "syn", "fin", "urg", "rst")},
        **{s: F.col(s) for s in SERVICES},
        **{p: (proto == p).cast("int") for p in ("TCP", "UDP", "ICMP")},
        **{a: F.lit(0) for a in ABSENT},
        "Tot sum": F.col("sum_size"), "Tot size": F.col("sum_size"),
        "Min": F.col("min_size"), "Max": F.col("max_size"), "AVG": mean,
        "Std": F.sqrt(variance), "IAT": F.lit(0.0) if iat_compat else iat,
        "Number": F.col("n"), "Magnitue": F.sqrt(size_sum), "Radius": mean / 2,
        "Covariance": variance, "Variance": variance, "Weight": mean,
    }
    return [values[f].alias(f) for f in FEATURES]


def first_protocol():
    """Protocol of the flow's first packet."""
    return F.element_at(F.array(*[F.lit(p) for p in PROTOCOLS]), F.col("first_code") % 4 + 1)


def flow_keys():
    """Key columns; the first packet's endpoints are read back from the flow id."""
    ends = r"^[^_]+_(.*):\d+_(.*):\d+$"
    low, high = F.regexp_extract("flow_id", ends, 1), F.regexp_extract("flow_id", ends, 2)
    forward = F.col("first_code") < 4
    return [F.col("flow_id"), F.col("start_ts"), F.col("last_ts"),
            F.when(forward, low).otherwise(high).alias("src_ip"),
            F.when(forward, high).otherwise(low).alias("dst_ip"), first_protocol().alias("protocol")]


def flow_features(packets: DataFrame, timeout_s: int = 60, iat_compat: bool = False) -> DataFrame:
    """Flow keys and the 46 features, one row per completed flow."""
    return flow_records(packets, timeout_s).select(*flow_keys(), *feature_columns(iat_compat))


def prepare_features(df: DataFrame, names=FEATURES) -> DataFrame:
    """Every expected feature by name, in order; absent or NULL counts as 0."""
    have = set(df.columns)
    keep = [c for c in df.columns if c not in set(names)]
    return df.select(*[col(c) for c in keep],
                     *[(F.coalesce(col(f).cast("double"), F.lit(0.0)) if f in have
                        else F.lit(0.0)).alias(f) for f in names])


def inter_arrival(packets: DataFrame, slot_s: int = 10) -> DataFrame:
    """Packets with ``gap_us`` since the previous packet of their flow.

    Gaps inside a time slot come from a window per (flow, slot); only the first
    packet of a slot needs the last packet of the slot before, which is looked
    up in a table of slot edges. No window spans a whole hot flow.
    """
    slot = F.floor(F.unix_micros("ts") / F.lit(slot_s * 1_000_000)).cast("long")
    usable = packets.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    keyed = with_flow_id(usable).withColumn("slot", slot)
    timeline = W.partitionBy("flow_id").orderBy("slot")
    edges = (keyed.groupBy("flow_id", "slot").agg(F.max("ts").alias("_last"))
             .select("flow_id", "slot", F.lag("_last").over(timeline).alias("_prev")))
    in_slot = W.partitionBy("flow_id", "slot").orderBy("ts", "pkt_id")
    before = F.coalesce(F.lag("ts").over(in_slot), F.col("_prev"))
    return (keyed.join(edges, ["flow_id", "slot"])
                 .withColumn("gap_us", F.unix_micros("ts") - F.unix_micros(before))
                 .drop("slot", "_prev"))
