"""Attack decisions, block list and traffic summaries over scored flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.columns import percent
from netloom.taxonomy import BENIGN_MACRO


def decide(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """is_attack and blocked from predicted class and confidence."""
    attack = F.col("predicted_class") != BENIGN_MACRO
    return (scored.withColumn("is_attack", attack)
                  .withColumn("blocked", attack & (F.col("confidence") >= threshold)))


def traffic_kpis(decided: DataFrame) -> DataFrame:
    attacks, blocked = F.count_if("is_attack"), F.count_if("blocked")
    return (decided.agg(
        F.count(F.lit(1)).alias("total_flows"), F.count_if(~F.col("is_attack")).alias("benign_count"),
        attacks.alias("attack_count"), blocked.alias("blocked_flows"),
        F.count_distinct(F.when(F.col("blocked"), F.col("src_ip"))).alias("blocked_ips"),
        F.avg("confidence").alias("avg_confidence"), F.count_distinct("src_ip").alias("unique_ips"))
        .withColumn("attack_rate", percent(F.col("attack_count"), F.col("total_flows")))
        .withColumn("block_rate", percent(F.col("blocked_flows"), F.col("attack_count"))))


def attack_breakdown(decided: DataFrame) -> DataFrame:
    return (decided.filter("is_attack").groupBy("predicted_class")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "predicted_class"))


def attack_pair(decided: DataFrame) -> DataFrame:
    """Two rows, Benign and Attack; a side without rows counts 0."""
    pair = F.array(F.struct(F.lit("Benign").alias("kind"), F.col("b").alias("n")),
                   F.struct(F.lit("Attack").alias("kind"), F.col("a").alias("n")))
    return (decided.agg(F.count_if(~F.col("is_attack")).alias("b"), F.count_if("is_attack").alias("a"))
            .select(F.inline(pair)))


def timeline(decided: DataFrame, unit: str = "hour") -> DataFrame:
    return (decided.groupBy(F.date_trunc(unit, "ts").alias(unit), "is_attack")
            .agg(F.count(F.lit(1)).alias("n")))


def confidence_histogram(decided: DataFrame, n_bins: int = 20) -> DataFrame:
    bin_no = F.least(F.floor(F.col("confidence") * n_bins), F.lit(n_bins - 1)).cast("int")
    return decided.groupBy("is_attack", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def blocked_sources(decided: DataFrame) -> DataFrame:
    return (decided.filter("blocked").groupBy("src_ip")
            .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
                 F.count(F.lit(1)).alias("attack_count"),
                 F.array_join(F.sort_array(F.collect_set("predicted_class")), ", ").alias("attack_types"),
                 F.avg("confidence").alias("avg_confidence")))


def top_sources(decided: DataFrame, k: int = 10) -> DataFrame:
    return (decided.filter("is_attack").groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "src_ip").limit(k))


def recent(decided: DataFrame, k: int, id_col: str = "event_id", attacks_only: bool = False) -> DataFrame:
    rows = decided.filter("is_attack") if attacks_only else decided
    return rows.orderBy(F.desc("ts"), F.desc(id_col)).limit(k)


def block_list(decided: DataFrame, id_col: str = "event_id") -> DataFrame:
    """Each source once, with the first blocking flow and its reason."""
    first = F.min(F.struct("ts", F.col(id_col).alias("id"), "predicted_class", "confidence"))
    return (decided.filter("blocked").groupBy("src_ip").agg(first.alias("f"))
            .select("src_ip", F.col("f.ts").alias("blocked_at"), F.col("f.id").alias("first_flow"),
                    F.concat(F.col("f.predicted_class"), F.lit(" ("),
                             F.format_string("%.2f", F.col("f.confidence")), F.lit(")")).alias("reason")))


def unblock(blocked: DataFrame, released: DataFrame) -> DataFrame:
    return blocked.join(released.select("src_ip").distinct(), "src_ip", "left_anti")


def run_statistics(decided: DataFrame, n_packets: DataFrame) -> DataFrame:
    """packets, flows, attacks, benign, blocked sources, attack rate: one row."""
    flows = decided.agg(
        F.count(F.lit(1)).alias("flows_completed"), F.count_if("is_attack").alias("attacks_detected"),
        F.count_if(~F.col("is_attack")).alias("benign_flows"),
        F.count_distinct(F.when(F.col("blocked"), F.col("src_ip"))).alias("ips_blocked"))
    packets = n_packets.agg(F.count(F.lit(1)).alias("packets_processed"))
    return (flows.withColumn("_k", F.lit(1)).join(packets.withColumn("_k", F.lit(1)), "_k").drop("_k")
            .withColumn("attack_rate", percent(F.col("attacks_detected"), F.col("flows_completed"))))


def metrics_between(scored: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a date range [start, end), for period reports."""
    return scored.filter((F.col("ts") >= F.lit(start).cast("timestamp"))
                         & (F.col("ts") < F.lit(end).cast("timestamp")))
