"""Flow keys, gap rules and features, in batch and as a stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netloom.operators import flows
from netloom.session import scratch
from netloom.sources import readers, writers
from netloom.streaming import flows as stream
from tests.conftest import SF

T0 = datetime(2025, 1, 1)


def packets(spark, rows):
    full = [(i, T0 + timedelta(seconds=s), *rest) for i, (s, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, readers.PACKET_SCHEMA)


def tcp(s, size=100, flags=2, out=True):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
    (si, sp), (di, dp) = (a, b) if out else (b, a)
    return (s, si, di, sp, dp, "TCP", size, flags)


def test_gap_boundary(spark):
    df = packets(spark, [tcp(0), tcp(60), tcp(119), tcp(180)])      # gaps 60, 59, 61
    got = sorted(r["Number"] for r in flows.flow_features(df, 60).collect())
    assert got == [1, 1, 2]
    assert sorted(r["Number"] for r in stream.flow_stream(df, 60).collect()) == got


def test_slots_never_change_the_result(spark):
    # offsets around slot edges: compare with a plain window over packets
    from pyspark.sql import Window as W
    df = packets(spark, [tcp(s + 0.5) for s in (0, 59, 60, 118, 179, 238, 239, 300, 359, 420, 479.999)])
    keyed = flows.with_flow_id(df)
    w = W.partitionBy("flow_id").orderBy("ts", "pkt_id")
    new = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) >= 60_000_000).cast("int")
    plain = keyed.withColumn("_n", F.coalesce(new, F.lit(0))).withColumn("segment", F.sum("_n").over(w)).groupBy("segment").count()
    want = sorted(r["count"] for r in plain.collect())
    assert sorted(r["n"] for r in flows.flow_records(df, 60).collect()) == want


def test_one_packet(spark):
    row = flows.flow_features(packets(spark, [tcp(0, size=50)])).first()
    assert row["flow_duration"] == 0 and row["Rate"] == 1000.0 and row["Srate"] == 500.0
    assert row["IAT"] == 0 and row["Variance"] == 0 and row["Std"] == 0 and row["Radius"] == 25


def test_direction_flags_and_services(spark):
    df = packets(spark, [tcp(0, flags=2), tcp(1, flags=18, out=False), tcp(3, flags=1 | 128, size=300)])
    row = flows.flow_features(df).first()
    assert row["flow_id"] == "TCP_10.0.0.1:1000_10.0.0.2:80"
    assert (row["src_ip"], row["dst_ip"], row["protocol"]) == ("10.0.0.1", "10.0.0.2", "TCP")
    assert (row["syn_count"], row["ack_count"], row["fin_flag_number"], row["cwr_flag_number"]) == (2, 1, 1, 1)
    assert (row["HTTP"], row["HTTPS"], row["DNS"], row["Protocol Type"]) == (1, 0, 0, 6)
    assert row["IAT"] == pytest.approx(1.5) and row["Tot sum"] == 500
    assert list(row.asDict())[6:] == flows.FEATURES and len(flows.FEATURES) == 46
    assert flows.flow_features(df, iat_compat=True).first()["IAT"] == 0


def test_first_packet_may_come_from_the_high_end(spark):
    row = flows.flow_features(packets(spark, [tcp(0, out=False), tcp(1)])).first()
    assert (row["src_ip"], row["dst_ip"]) == ("10.0.0.2", "10.0.0.1")


def test_ports_compare_as_numbers_and_other_protocols_share_a_prefix(spark):
    df = packets(spark, [(0, "10.0.0.1", "10.0.0.1", 1000, 80, "UDP", 10, 0), (0, "a", "b", 5, 6, "ICMP", 10, 0),
                         (1, "b", "a", 5, 6, "GRE", 10, 0)])
    rows = {r["flow_id"]: r for r in flows.flow_features(df).collect()}
    assert set(rows) == {"UDP_10.0.0.1:80_10.0.0.1:1000", "OTHER_a:0_b:0"}
    other = rows["OTHER_a:0_b:0"]
    assert other["protocol"] == "ICMP" and other["ICMP"] == 1 and other["Number"] == 2 and other["Protocol Type"] == 1


def test_ipv6_endpoints_survive_the_key(spark):
    row = flows.flow_features(packets(spark, [(0, "fe80::1", "fe80::2", 53, 99, "UDP", 10, 0)])).first()
    assert (row["src_ip"], row["dst_ip"], row["DNS"]) == ("fe80::1", "fe80::2", 1)


def test_packets_without_addresses_are_ignored(spark):
    df = packets(spark, [tcp(0), (1, None, "x", 1, 2, "TCP", 10, 0)])
    assert flows.flow_features(df).first()["Number"] == 1


def test_hot_flow_reaches_the_window_pre_aggregated(spark):
    df = packets(spark, [tcp(i / 100) for i in range(2000)])
    assert flows.slot_partials(df, 60).count() == 1
    plan = flows.flow_records(df, 60)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_inter_arrival(spark):
    df = packets(spark, [tcp(0), tcp(59), tcp(61), tcp(200)])
    gaps = sorted(r["gap_us"] or 0 for r in flows.inter_arrival(df, 60).collect())
    assert gaps == [0, 2_000_000, 59_000_000, 139_000_000]


def test_missing_feature_counts_as_zero(spark):
    df = spark.createDataFrame([(1, None)], "id int, a double")
    assert flows.prepare_features(df, ["b", "a"]).first().asDict() == {"id": 1, "b": 0.0, "a": 0.0}


def test_stream_then_flush_equals_batch(spark):
    rows = [tcp(s) for s in (0, 10, 200, 230, 2000, 5000)] + [(7, "a", "b", 5, 53, "UDP", 70, 0), (4990, "a", "b", 5, 53, "UDP", 70, 0)]
    df = packets(spark, rows)
    folder = scratch(spark, "packets")
    for i in range(3):                                   # three files, three batches
        df.filter(F.col("pkt_id") % 3 == i).coalesce(1).write.mode("append").parquet(folder)
    source = readers.packet_stream(spark, folder)
    emitted = stream.run_append(stream.flow_stream(source, 60), "t")
    tail = stream.flush_tail(df, emitted, 60)
    key = lambda d: sorted((r["flow_id"], r["start_ts"], r["Number"], r["Tot sum"]) for r in d.collect())
    assert key(emitted.unionByName(tail)) == key(flows.flow_features(df, 60))
    assert emitted.count() > 0 and tail.count() > 0


def test_late_packets_within_the_watermark_are_kept(spark):
    folder = scratch(spark, "late")
    for part in ([tcp(100), tcp(300)], [tcp(50)]):
        packets(spark, part).coalesce(1).write.mode("append").parquet(folder)
    emitted = stream.run_append(stream.flow_stream(readers.packet_stream(spark, folder, max_files=1), 60), "late")
    tail = stream.flush_tail(spark.read.parquet(folder), emitted, 60)
    assert sorted(r["Number"] for r in emitted.unionByName(tail).collect()) == [1, 2]


def test_scored_snapshot_round_trip(spark, tmp_path):
    rows = flows.flow_features(packets(spark, [tcp(0), tcp(500)])).withColumns({
        "predicted_class": F.lit("DDoS"), "confidence": F.lit(0.9), "is_attack": F.lit(True), "blocked": F.lit(True)})
    writers.write_scored(rows.limit(1), str(tmp_path), datetime(2025, 1, 1))
    writers.write_scored(rows, str(tmp_path), datetime(2025, 1, 2))
    back = readers.latest_predictions(spark, str(tmp_path))
    assert back.count() == 2 and back.agg(F.min("timestamp")).first()[0] == T0


def test_header_needs_the_label(spark, tmp_path):
    spark.createDataFrame([(1.0, "x")], "f double, label string").write.option("header", True).csv(f"{tmp_path}/a")
    assert readers.csv_features(spark, f"{tmp_path}/a") == ["f"]
    with pytest.raises(ValueError):
        readers.csv_features(spark, f"{tmp_path}/a", "missing")


def test_monitor_goes_on_after_a_stop(spark):
    """Stopped after the first file and started again for two more, it scores and blocks what the batch form does."""
    from netloom.operators import encode, flows as ops, models
    from netloom.plans.views import view
    packets = view(spark, SF, "packets")
    parts, day = [packets.filter(f"pkt_id % 3 = {i}") for i in range(3)], 86_400
    bounds = packets.selectExpr("unix_micros(min(ts)) a", "unix_micros(max(ts)) b").first()
    cut = [bounds["a"] + (bounds["b"] - bounds["a"]) * i // 3 for i in range(4)]
    parts = [packets.filter(f"unix_micros(ts) >= {cut[i]} AND unix_micros(ts) {'<' if i < 2 else '<='} {cut[i + 1]}") for i in range(3)]
    known = ops.flow_features(packets, day).selectExpr("*", f"CASE WHEN TCP = 1 THEN 2 WHEN UDP = 1 THEN 3 ELSE 0 END AS {models.LABEL}")
    scaler = encode.fit_scaler(known, ops.FEATURES)
    model = models.fit(models.decision_tree(stream.scaled_names(scaler), max_depth=5), stream.scaled_training_rows(known, scaler))
    folder, root = scratch(spark, "arriving"), scratch(spark, "monitor")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(folder)
        if i != 1:                                                  # the second file waits until the third is there
            run = stream.Monitor(readers.packet_stream(spark, folder, packets.schema), model, scaler, root, day)
            run.start(stream.DRAIN).awaitTermination()
    run.finish(packets)
    got = sorted((r["flow_id"], r["start_ts"], r["Number"]) for r in run.flows().collect())
    assert got == sorted((r["flow_id"], r["start_ts"], r["Number"]) for r in ops.flow_features(packets, day).collect())
    blocked = [r["src_ip"] for r in run.blocked().collect()]
    assert len(blocked) == len(set(blocked)) and set(blocked) == {r["src_ip"] for r in run.flows().filter("blocked").collect()}
    assert len(run.blocks.numbers()) <= 2


def test_recent_blocks(spark):
    """With bounded state a source may be reported again, never missed."""
    folder = scratch(spark, "decided")
    rows = [(T0 + timedelta(seconds=i), f"10.0.0.{i % 3}", i % 3 < 2) for i in range(30)]
    spark.createDataFrame(rows, "ts timestamp, src_ip string, blocked boolean").coalesce(1).write.parquet(folder)
    source = spark.readStream.schema("ts timestamp, src_ip string, blocked boolean").parquet(folder)
    out = stream.run_append(stream.block_stream_recent(source), "recent")
    assert {r["src_ip"] for r in out.collect()} == {"10.0.0.0", "10.0.0.1"}


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from netloom.session import NoSharedFolder, run_folder, shared_root
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(
        getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(NoSharedFolder):
        shared_root(bare)
    with run_folder(spark, "flow") as path:
        kept = scratch(spark, "step")
        assert kept.startswith(path)
        spark.range(3).write.parquet(kept)
    import os
    assert not os.path.exists(path)


def test_arriving_slices_are_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from netloom.plans import q_streaming
    monkeypatch.setattr(q_streaming, "SLICE_TASK", 2_000)
    rows = spark.range(33_000).coalesce(1).selectExpr("id AS pkt_id")
    q_streaming.write_slice(rows, f"{tmp_path}/arriving")
    made = spark.read.parquet(f"{tmp_path}/arriving")
    sizes = [r["count"] for r in made.groupBy(F.input_file_name()).count().collect()]
    assert made.distinct().count() == made.count() == 33_000 and len(sizes) > 1 and max(sizes) < 2 * 8_192
