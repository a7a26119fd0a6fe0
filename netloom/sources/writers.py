"""Table, report and artifact sinks."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.columns import col
from netloom.operators.compare import best_per_metric, report_row, with_mean_score
from netloom.operators.flows import FEATURES
from netloom.operators.quotas import phase_table
from netloom.operators.synth import merge_synthetic
from netloom.taxonomy import LABELS_BY_MACRO, MACRO_NAMES

ROWS_PER_FILE = 2_000_000


def write_table(df: DataFrame, path: str, by=(), mode: str = "overwrite") -> None:
    """Snappy Parquet in files of bounded size, optionally in partition folders."""
    writer = df.write.mode(mode).option("compression", "snappy").option("maxRecordsPerFile", ROWS_PER_FILE)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_shuffled(df: DataFrame, path: str, key: str = "shuffle_key") -> None:
    """Write in the order of the shuffle key: a range exchange, not one sorted task."""
    write_table(df.repartitionByRange(key).sortWithinPartitions(key).drop(key), path)


def write_merged(original: DataFrame, synthetic: DataFrame, path: str) -> None:
    write_table(merge_synthetic(original, synthetic), path)


def write_augmentation_info(path: str, method: str, cls: str, phases: dict[str, DataFrame]) -> None:
    """One JSON record per phase and class, with the method's description."""
    (phase_table(cls, phases).withColumns({"method": F.lit(method), "format": F.lit("parquet"),
                                           "compression": F.lit("snappy")})
     .coalesce(1).write.mode("overwrite").json(path))     # phases x classes rows


def mapping_info(dictionary: DataFrame, n_rows: int, label: str = "label") -> DataFrame:
    """One record: taxonomy, macro names and the specific codes."""
    pairs = [F.lit(x) for macro, labels in LABELS_BY_MACRO.items() for name in labels for x in (name, macro)]
    codes = F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col(label).alias("label"))))
    return dictionary.agg(
        F.count(F.lit(1)).alias("n_specific_classes"),
        F.map_from_entries(F.transform(codes, lambda s: F.struct(s["label"], s["idx"]))).alias("specific_to_idx"),
        F.map_from_entries(F.transform(codes, lambda s: F.struct(s["idx"].cast("string"), s["label"]))).alias("idx_to_specific"),
    ).withColumns({"total_rows_analyzed": F.lit(n_rows), "attack_mapping": F.create_map(*pairs),
                   "macro_categories": F.array(*[F.lit(m) for m in MACRO_NAMES])})


def write_json(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, folder: str) -> None:
    """Comparison as CSV and as one JSON record; one row per model."""
    scored = with_mean_score(metrics).select("algorithm", "dataset", "accuracy", "precision", "recall", "f1", "mean_score")
    scored.orderBy("algorithm", "dataset").coalesce(1).write.mode("overwrite").option("header", True).csv(
        f"{folder}/comparison_results_csv")
    write_json(report_row(metrics), f"{folder}/comparison_results_json")
    best_per_metric(metrics).coalesce(1).write.mode("overwrite").json(f"{folder}/best_json")


def scored_columns(scored: DataFrame) -> DataFrame:
    """The stored shape of scored flows: ISO time, keys, decision, 46 features."""
    head = ["flow_id", "src_ip", "dst_ip", "protocol", "predicted_class", "confidence", "is_attack", "blocked"]
    return scored.select(F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                         *head, *[col(f) for f in FEATURES])


def write_scored(scored: DataFrame, folder: str, at: datetime | None = None) -> str:
    """A timestamped ``predictions_*`` CSV snapshot; returns its path."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{folder.rstrip('/')}/predictions_{stamp}.csv"
    scored_columns(scored).write.option("header", True).csv(path)
    return path


def production_metadata(df: DataFrame, source: str, features, label: str | None = None,
                        location: str | None = None, minutes: int | None = None) -> DataFrame:
    """One record describing a processed batch."""
    return df.agg(F.count(F.lit(1)).alias("num_records")).select(
        F.lit(source).alias("source_file"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("processed_timestamp"),
        "num_records", F.lit(len(features)).alias("num_features"),
        F.lit(bool(label and label in df.columns)).alias("has_labels"),
        F.lit(location).cast("string").alias("deployment_location"),
        F.lit(minutes).cast("int").alias("capture_duration_minutes"))


def write_production_batch(df: DataFrame, folder: str, name: str, source: str, features, **about) -> None:
    write_table(df, f"{folder}/{name}")
    stored = df.sparkSession.read.parquet(f"{folder}/{name}")     # count what was written
    write_json(production_metadata(stored, source, features, **about), f"{folder}/{name}_metadata")
