"""Source and sink queries: written by Spark into the shared folder, then read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from netloom.operators import alerts, encode, flows, synth
from netloom.plans.q_columns import FEATS, PREPARED_SQL, prepared, raw
from netloom.plans.q_flows import DAY, RECORD_SQL, segmented_sql
from netloom.plans.q_metrics import TAGGED_METRICS, model_metrics
from netloom.plans.registry import query
from netloom.plans.views import RAW_KEY, table, view
from netloom.session import materialise, scratch
from netloom.sources import readers, writers

CSV_COUNTS = """SELECT label, count(*) AS n, count(*) FILTER (WHERE isinf(f2)) AS n_infinite,
  count(*) FILTER (WHERE f1 IS NULL) AS n_null, count(*) FILTER (WHERE isnan(f3)) AS n_nan FROM raw_flows GROUP BY label"""


def csv_folder(spark, sf):
    """The raw flows as CSV the way pandas spells it: inf, -inf, NaN."""
    path = scratch(spark, "csv")
    spell = lambda c: F.when(F.col(c) == float("inf"), "inf").when(F.col(c) == float("-inf"), "-inf").otherwise(F.col(c).cast("string"))
    raw(spark, sf).select(*[spell(f).alias(f) for f in FEATS], "label").write.option("header", True).csv(path)
    return path


def csv_counts(df):
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("f2") == float("inf")).alias("n_infinite"),
                                   F.count_if(F.col("f1").isNull()).alias("n_null"), F.count_if(F.isnan("f3")).alias("n_nan"))


@query("s1_csv_header", "", """SELECT column_name AS feature FROM (
  SELECT unnest(['f1', 'f2', 'f3', 'f4', 'f5']) AS column_name) t WHERE (SELECT count(*) FROM lineitem) > 0""")
def _(spark, sf):
    names = readers.csv_features(spark, csv_folder(spark, sf))
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("s2_csv_scan", "raw_flows", CSV_COUNTS)
def _(spark, sf):
    return csv_counts(readers.read_flows_csv(spark, csv_folder(spark, sf), readers.flow_schema(FEATS)))


@query("s2_reordered_header", "raw_flows", CSV_COUNTS)
def _(spark, sf):
    """Columns written in another order, with one more, are still found by name."""
    path = scratch(spark, "csv")
    spark.read.option("header", True).csv(csv_folder(spark, sf)).select(
        "label", F.lit("x").alias("extra"), *reversed(FEATS)).write.option("header", True).csv(path)
    return csv_counts(readers.read_flows_csv(spark, path, readers.flow_schema(FEATS)))


@query("s2_bad_lines", "raw_flows", """SELECT l AS label, count(*) AS n, count(*) FILTER (WHERE bad) AS n_bad
FROM (SELECT flow_no % 50 = 0 AS bad, CASE WHEN flow_no % 50 = 0 THEN NULL ELSE label END AS l FROM raw_flows) t GROUP BY l""")
def _(spark, sf):
    """Every fiftieth flow is written with a word in place of a number; those lines are kept apart and counted."""
    path = scratch(spark, "csv")
    broken = F.when(F.col("flow_no") % 50 == 0, "broken").otherwise(F.col("f1").cast("string"))
    raw(spark, sf).select(broken.alias("f1"), "f4", "f5", "label").write.option("header", True).csv(path)
    back = readers.read_flows_csv(spark, path, readers.flow_schema(["f1", "f4", "f5"]), bad_lines="column")
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(readers.BAD_LINE).isNotNull()).alias("n_bad"))


@query("s3_row_limited_scan", "raw_flows", "SELECT flow_no, label FROM raw_flows ORDER BY flow_no, part_no, supp_no LIMIT 1000")
def _(spark, sf):
    return readers.first_rows(raw(spark, sf), RAW_KEY, 1000).select("flow_no", "label")


@query("s4_csv_glob", "raw_flows", CSV_COUNTS)
def _(spark, sf):
    return csv_counts(readers.read_flows_csv(spark, csv_folder(spark, sf) + "/*.csv", readers.flow_schema(FEATS)))


@query("s5_parquet_scan", "", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def _(spark, sf):
    rows = readers.read_table(spark, f"{sf}/lineitem.parquet")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("s6_projected_scan", "", "SELECT l_orderkey, l_discount FROM lineitem")
def _(spark, sf):
    return readers.read_table(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_discount"])


@query("s7_row_count", "", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _(spark, sf):
    return readers.table_shape(table(spark, sf, "lineitem"))


@query("s8_batch_iteration", "", """SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS qty, true AS bounded
FROM lineitem GROUP BY l_linenumber""")
def _(spark, sf):
    import pyarrow as pa

    def tally(batch):
        t = pa.Table.from_batches([batch]).group_by("l_linenumber").aggregate([("l_quantity", "sum"), ("l_quantity", "count")])
        out = pa.table({"l_linenumber": t.column("l_linenumber"), "n": t.column("l_quantity_count"), "qty": t.column("l_quantity_sum"),
                        "rows": pa.array([batch.num_rows] * t.num_rows, pa.int32())})
        return out.combine_chunks().to_batches()[0]

    rows = table(spark, sf, "lineitem").select("l_linenumber", "l_quantity")
    parts = readers.map_batches(rows, tally, "l_linenumber int, n long, qty double, rows int", 5_000)
    return parts.groupBy("l_linenumber").agg(F.sum("n").alias("n"), F.round(F.sum("qty"), 2).alias("qty"),
                                             (F.max("rows") <= 5_000).alias("bounded"))


# the points split by id; SMOTE raises each class of train that has two rows at least
SPLIT_POINTS_SQL = """parts AS (SELECT id, cls, CASE WHEN id % 10 < 7 THEN 'train' WHEN id % 10 < 9 THEN 'test' ELSE 'val' END AS split FROM vectors),
sizes AS (SELECT cls, count(*) AS n FROM parts WHERE split = 'train' GROUP BY cls), top AS (SELECT max(n) AS m FROM sizes)"""


def split_points(spark, sf):
    part = F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 9, "test").otherwise("val")
    return view(spark, sf, "vectors").withColumn("split", part)


def raised_by_smote(train):
    """Train points with the synthetic ones, told apart by is_synthetic."""
    return synth.merge_synthetic(train.select("cls", "vec"), synth.smote(train.select("id", "cls", "vec")).select("cls", "vec", "is_synthetic"))


@query("s9_split_loader", "vectors", f"""{SPLIT_POINTS_SQL}
SELECT 'smote' AS variant, 'train' AS split, CAST(sum(CASE WHEN n > 1 THEN m ELSE n END) AS BIGINT) AS n FROM sizes, top
UNION ALL SELECT 'original', split, count(*) FROM parts WHERE split <> 'train' GROUP BY split""")
def _(spark, sf):
    root, rows = scratch(spark, "variants"), split_points(spark, sf)
    train = rows.filter("split = 'train'")
    both = rows.select("cls", "vec", F.lit(False).alias("is_synthetic"), "split").withColumn("variant", F.lit("original")).unionByName(
        raised_by_smote(train).withColumns({"split": F.lit("train"), "variant": F.lit("smote")}))
    writers.write_table(both, root, ["variant", "split"])
    parts = readers.load_splits(spark, root, "smote")
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("smote" if name == "train" else "original").alias("variant"), F.lit(name).alias("split"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("p26_train_only_rule", "vectors", f"""{SPLIT_POINTS_SQL}
SELECT 'train' AS split, cls, CASE WHEN n > 1 THEN m ELSE n END AS n FROM sizes, top
UNION ALL SELECT split, cls, count(*) FROM parts WHERE split <> 'train' GROUP BY split, cls""")
def _(spark, sf):
    """SMOTE reaches train only; test and validation stay as they are."""
    from netloom.plans.augment import augment_train_only
    rows = split_points(spark, sf)

    def change(train):
        return raised_by_smote(train).select("cls", "vec").withColumn("split", F.lit("train"))

    return augment_train_only(rows.select("id", "cls", "vec", "split"), lambda t: change(t).withColumn("id", F.lit(None).cast("long"))).groupBy(
        "split", "cls").agg(F.count(F.lit(1)).alias("n"))


def scored_flows46(spark, sf):
    """Flows with 46 features and a decision from their protocol and size."""
    rows = flows.flow_features(view(spark, sf, "packets"), DAY)
    named = rows.withColumns({"predicted_class": F.when(F.col("TCP") == 1, "DDoS").when(F.col("UDP") == 1, "DoS").otherwise("Benign"),
                              "confidence": F.least(F.lit(1.0), F.col("AVG") / 4000)})
    return alerts.decide(named)


@query("s10_latest_snapshot", "packets", f"""{segmented_sql(DAY)}, {RECORD_SQL}
SELECT proto AS protocol, proto IN ('TCP', 'UDP') AS is_attack, count(*) AS n, count(start_ts) AS n_timestamps FROM records GROUP BY proto""")
def _(spark, sf):
    folder, rows = scratch(spark, "scored"), scored_flows46(spark, sf)
    writers.write_scored(rows.filter("is_attack"), folder, datetime(2025, 1, 1))
    writers.write_scored(rows, folder, datetime(2025, 1, 2))
    return readers.latest_predictions(spark, folder).groupBy("protocol", "is_attack").agg(
        F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("n_timestamps"))


@query("k5_scored_csv", "packets", """SELECT count(*) AS n FROM packets HAVING count(*) > 0""")
def _(spark, sf):
    # the packet counts of all written flows add up to the packets read
    path = writers.write_scored(scored_flows46(spark, sf), scratch(spark, "scored"))
    back = spark.read.schema(readers.SCORED_SCHEMA).option("header", True).csv(path)
    return back.agg(F.sum("Number").cast("long").alias("n"))


REPORT = f"""{TAGGED_METRICS} SELECT algorithm, dataset, round(accuracy, 6) AS accuracy, round((accuracy + "precision" + recall + f1) / 4, 6) AS mean_score FROM weighted"""


@query("s11_comparison_read", "scored_flows", REPORT)
def _(spark, sf):
    folder = scratch(spark, "report")
    writers.write_report(model_metrics(spark, sf), folder)
    return readers.read_comparison(spark, f"{folder}/comparison_results_csv").select(
        "algorithm", "dataset", F.round("accuracy", 6).alias("accuracy"), F.round("mean_score", 6).alias("mean_score"))


@query("s12_model_inventory", "", """SELECT 'DecisionTree' AS algorithm, unnest(['tree_original', 'tree_smote']) AS file,
  (SELECT count(*) FROM events) > 0 AS has_size""")
def _(spark, sf):
    from netloom.operators import models
    from netloom.plans.q_models import FEATURES, learnable, split
    root = scratch(spark, "models")
    train = split(learnable(spark, sf), "train")
    model = models.fit(models.decision_tree(FEATURES, max_depth=4), train)
    models.save_model(model, root, "DecisionTree", "tree_original")
    models.save_model(model, root, "DecisionTree", "tree_smote")
    return readers.model_inventory(spark, root).select("algorithm", "file", (F.col("size_mb") > 0).alias("has_size"))


@query("k1_parquet_sink", "raw_flows", f"{PREPARED_SQL} SELECT split, y_macro_encoded, count(*) AS n FROM prepared GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "processed")
    writers.write_table(encode.narrow(prepared(spark, sf), FEATS), path, ["split"])
    return spark.read.parquet(path).groupBy("split", "y_macro_encoded").agg(F.count(F.lit(1)).alias("n"))


@query("k1_shuffled_sink", "raw_flows", "SELECT split, count(*) AS n FROM raw_flows GROUP BY split")
def _(spark, sf):
    from netloom.operators.ranking import with_shuffle_key
    path = scratch(spark, "shuffled")
    writers.write_shuffled(with_shuffle_key(raw(spark, sf), RAW_KEY), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("k2_merged_sink", "vectors", """sizes AS (SELECT cls, count(*) AS n FROM vectors GROUP BY cls)
SELECT is_synthetic, CAST(sum(m) AS BIGINT) AS n FROM (SELECT false AS is_synthetic, n AS m FROM sizes
UNION ALL SELECT true, (SELECT max(n) FROM sizes) - n FROM sizes) t GROUP BY is_synthetic""")
def _(spark, sf):
    base, path = view(spark, sf, "vectors"), scratch(spark, "train_smote")
    writers.write_merged(base.select("cls", "vec"), synth.smote(base).select("cls", "vec", "is_synthetic"), path)
    return spark.read.parquet(path).groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("k3_augmentation_info", "vectors", f"""{SPLIT_POINTS_SQL}
SELECT phase, CAST(cls AS VARCHAR) AS class, CASE WHEN phase IN ('original', 'sample') OR n < 2 THEN n ELSE m END AS n, 'SMOTE' AS method
FROM sizes, top, (SELECT unnest(['original', 'sample', 'augmented', 'final']) AS phase) p""")
def _(spark, sf):
    """The record of a SMOTE run over all of train: four phases."""
    path, train = scratch(spark, "info"), split_points(spark, sf).filter("split = 'train'")
    final = materialise(raised_by_smote(train), "final")
    writers.write_augmentation_info(path, "SMOTE", "cls", {"original": train, "sample": train, "augmented": final, "final": final})
    return spark.read.json(path).select("phase", "class", "n", "method")


@query("k3_mapping_info", "raw_flows", """SELECT count(DISTINCT label) AS n_specific_classes, (SELECT count(*) FROM raw_flows) AS total_rows_analyzed,
  min(label) AS first_label FROM raw_flows""")
def _(spark, sf):
    path, rows = scratch(spark, "mapping"), raw(spark, sf)
    codes = encode.label_dictionary(rows)
    total = codes.agg(F.sum("n")).first()[0]
    writers.write_json(writers.mapping_info(codes, total), path)
    return spark.read.json(path).select("n_specific_classes", "total_rows_analyzed", F.col("idx_to_specific")["0"].alias("first_label"))


@query("k8_production_batch", "raw_flows", """SELECT 'raw_flows' AS source_file, count(*) AS num_records, 5 AS num_features, true AS has_labels,
  'datacenter-1' AS deployment_location, 60 AS capture_duration_minutes FROM raw_flows""")
def _(spark, sf):
    folder = scratch(spark, "production")
    writers.write_production_batch(raw(spark, sf), folder, "batch", "raw_flows", FEATS, label="label",
                                   location="datacenter-1", minutes=60)
    meta = spark.read.json(f"{folder}/batch_metadata")
    return meta.select("source_file", "num_records", F.col("num_features").cast("int").alias("num_features"), "has_labels",
                       "deployment_location", F.col("capture_duration_minutes").cast("int").alias("capture_duration_minutes"))
