"""Packets to alerts as Structured Streaming queries.

Session windows split a flow at gaps of at least the timeout: the session gap
is one microsecond shorter, because a window merges packets at exactly its gap.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.functions.columns import percent
from netloom.operators import alerts, encode, flows, models
from netloom.session import scratch

WATERMARK = "10 minutes"


def flow_stream(packets: DataFrame, timeout_s: int = 60, watermark: str = WATERMARK) -> DataFrame:
    """One row of keys and 46 features per flow that has gone quiet.

    Works on a stream and on a bounded table alike. Tasks merge neighbouring
    packets of a session before the shuffle, so hot flows arrive pre-aggregated.
    """
    gap = f"{timeout_s * 1_000_000 - 1} microseconds"
    parts = flows.packet_parts(packets.withWatermark("ts", watermark))
    sessions = (parts.groupBy("flow_id", F.session_window("ts", gap).alias("session"))
                .agg(*flows.partial_aggregates()))
    return sessions.select(*flows.flow_keys(), *flows.feature_columns())


def score_flows(completed: DataFrame, model: PipelineModel, scaler: dict, threshold: float = 0.8) -> DataFrame:
    """Features by name, scaled, scored and decided; raw features stay in the output."""
    names = list(scaler)
    scaled = {f: f"scaled_{i}" for i, f in enumerate(names)}
    ready = completed.withColumns({
        scaled[f]: ((F.coalesce(flows.col(f).cast("double"), F.lit(0.0)) - F.lit(scaler[f][0])) / F.lit(scaler[f][1]))
        for f in names})
    return alerts.decide(models.score(model, ready), threshold).drop(*scaled.values())


def scaled_names(scaler: dict) -> list[str]:
    return [f"scaled_{i}" for i in range(len(scaler))]


def scaled_training_rows(completed: DataFrame, scaler: dict) -> DataFrame:
    rename = dict(zip(scaler, scaled_names(scaler)))
    return encode.standardise(completed, scaler).withColumnsRenamed(rename)


def block_stream(decided: DataFrame) -> DataFrame:
    """Each blocked source once; the state holds one key per source ever blocked."""
    reason = F.concat("predicted_class", F.lit(" ("), F.format_string("%.2f", "confidence"), F.lit(")"))
    return (decided.filter("blocked").withColumn("reason", reason)
            .dropDuplicates(["src_ip"]).select("src_ip", "ts", "reason"))


def block_stream_recent(decided: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Like block_stream, but a source may be reported again after the watermark passed it."""
    return (decided.filter("blocked").withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["src_ip"]).select("src_ip", "ts"))


def counter_stream(decided: DataFrame) -> DataFrame:
    """Running totals; one row, for complete or update mode."""
    return decided.groupBy().agg(
        F.count(F.lit(1)).alias("flows_completed"), F.count_if("is_attack").alias("attacks_detected"),
        F.count_if(~F.col("is_attack")).alias("benign_flows"), F.count_if("blocked").alias("blocked_flows"))


def timeline_stream(decided: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    return (decided.withWatermark("ts", watermark)
            .groupBy(F.window("ts", width).alias("w"), "is_attack").agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("hour"), "is_attack", "n"))


def kpi_stream(decided: DataFrame) -> DataFrame:
    """Counts per source, for complete mode; ``kpis_of`` sums them up. State is one row per source, so sources are counted exactly."""
    return decided.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if("is_attack").alias("attacks"), F.count_if("blocked").alias("blocked"),
        F.sum("confidence").alias("confidence"))


def kpis_of(per_source: DataFrame) -> DataFrame:
    """The traffic figures of ``alerts.traffic_kpis`` from counts per source."""
    total = per_source.agg(
        F.coalesce(F.sum("flows"), F.lit(0)).alias("total_flows"), F.coalesce(F.sum("attacks"), F.lit(0)).alias("attack_count"),
        F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked_flows"), F.count_if(F.col("blocked") > 0).alias("blocked_ips"),
        F.count("src_ip").alias("unique_ips"), (F.sum("confidence") / F.sum("flows")).alias("avg_confidence"))
    return total.withColumns({"benign_count": F.col("total_flows") - F.col("attack_count"),
                              "attack_rate": percent(F.col("attack_count"), F.col("total_flows")),
                              "block_rate": percent(F.col("blocked_flows"), F.col("attack_count"))})


DRAIN = {"availableNow": True}


def start_append(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to a Parquet table. Started again with the same two folders, it goes on where it stopped.

    Without a trigger it runs until stopped; ``DRAIN`` ends it when the present input is used up.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start(out)


def run_append(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain all present input and read the table back; folders of its own unless given."""
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, f"{name}-out"), checkpoint or scratch(spark, f"{name}-ckpt")
    start_append(stream, out, checkpoint, DRAIN).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


class Snapshots:
    """A small table that each batch replaces: one folder per batch number, of which the last two stay.

    A batch that runs again finds the state before it and writes the same result.
    """

    def __init__(self, spark: SparkSession, root: str, schema):
        self.spark, self.root, self.schema = spark, root, schema
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self.files.exists(self.folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.folder)]
        return sorted(int(n.removeprefix("batch_")) for n in names if n.startswith("batch_"))

    def path(self, number: int) -> str:
        return f"{self.root}/batch_{number}"

    def before(self, number: int) -> DataFrame:
        earlier = [n for n in self.numbers() if n < number]
        return self.read(earlier[-1]) if earlier else self.spark.createDataFrame([], self.schema)

    def read(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path(number))

    def last(self) -> DataFrame:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(self.path(number))
        for old in [n for n in self.numbers() if n < number][:-1]:
            self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(old)), True)


def start_snapshots(stream: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the result of a complete-mode aggregate as the latest snapshot under ``out``."""
    kept = Snapshots(stream.sparkSession, out, stream.schema)
    writer = stream.writeStream.outputMode("complete").foreachBatch(kept.write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def run_counters(stream: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain a complete-mode aggregate and read its latest snapshot."""
    spark = stream.sparkSession
    out, checkpoint = out or scratch(spark, f"{name}-out"), checkpoint or scratch(spark, f"{name}-ckpt")
    start_snapshots(stream, out, checkpoint, DRAIN).awaitTermination()
    return Snapshots(spark, out, stream.schema).last()


def flush_tail(packets: DataFrame, emitted: DataFrame, timeout_s: int = 60) -> DataFrame:
    """Flows still open when the input ended, from the packets after each flow's last emission.

    Sessions of a flow leave in time order, so whatever follows the last emitted
    one is exactly what the stream still held. Packets are first reduced per flow and
    slot of the timeout's width, whose packets all belong to one session, so the
    join carries at most one row per flow and slot.
    """
    last = emitted.groupBy("flow_id").agg(F.max("last_ts").alias("_done"))
    slots = flows.slot_partials(packets, timeout_s).join(last, "flow_id", "left")
    left = slots.filter(F.col("_done").isNull() | (F.col("start_ts") > F.col("_done"))).drop("_done")
    return flows.merged_slots(left, timeout_s).select(*flows.flow_keys(), *flows.feature_columns())


class Monitor:
    """packets -> flows -> scores -> decisions, with the block list beside them, in a folder that outlives a run.

    Each batch writes its scored flows under its number and the block list as a snapshot, so a batch that runs again
    changes nothing. A monitor made with the same folder goes on where the last one stopped.
    """

    def __init__(self, packets: DataFrame, model: PipelineModel, scaler: dict, root: str, timeout_s: int = 60,
                 threshold: float = 0.8, max_packets: int | None = None):
        self.spark, self.model, self.scaler, self.root = packets.sparkSession, model, scaler, root
        self.timeout_s, self.threshold = timeout_s, threshold
        packets = packets if max_packets is None else packets.limit(max_packets)
        self.scored = score_flows(flow_stream(packets, timeout_s), model, scaler, threshold)
        self.list_schema = self._sources(self.scored).schema
        self.blocks = Snapshots(self.spark, f"{root}/blocked", self.list_schema)

    @staticmethod
    def _sources(scored: DataFrame) -> DataFrame:
        return alerts.block_list(scored.withColumn("ts", F.col("start_ts")), "flow_id")

    def _land(self, batch: DataFrame, number: int) -> None:
        path = f"{self.root}/scored/batch_{number}"
        batch.write.mode("overwrite").parquet(path)
        found = self._sources(self.spark.read.schema(batch.schema).parquet(path))
        known = self.blocks.before(number)
        self.blocks.write(known.unionByName(found.join(known, "src_ip", "left_anti")), number)

    def start(self, trigger: dict | None = None) -> StreamingQuery:
        """Run until stopped, or to the end of the present input with ``DRAIN``."""
        writer = self.scored.writeStream.foreachBatch(self._land).option("checkpointLocation", f"{self.root}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def finish(self, packets: DataFrame) -> None:
        """Score and block the flows that were still open when the input ended; ``packets`` is the input as a table."""
        tail = score_flows(flush_tail(packets, self.flows(), self.timeout_s), self.model, self.scaler, self.threshold)
        numbers = self.blocks.numbers()
        self._land(tail.select(*self.scored.columns), numbers[-1] + 1 if numbers else 0)

    def flows(self) -> DataFrame:
        return self.spark.read.schema(self.scored.schema).option("recursiveFileLookup", True).parquet(f"{self.root}/scored")

    def blocked(self) -> DataFrame:
        return self.blocks.last()


def monitor(packets: DataFrame, model: PipelineModel, scaler: dict, root: str, timeout_s: int = 60, threshold: float = 0.8,
            recorded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Drain the present input under ``root``; with ``recorded``, the same packets as a table, open flows are scored too."""
    run = Monitor(packets, model, scaler, root, timeout_s, threshold)
    run.start(DRAIN).awaitTermination()
    if recorded is not None:
        run.finish(recorded)
    return run.flows(), run.blocked()
