"""Table, file and packet sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.flows import FEATURES

PACKET_SCHEMA = T.StructType([
    T.StructField("pkt_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()), T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.StringType()), T.StructField("size", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType())])
COMPARISON_SCHEMA = ("algorithm string, dataset string, accuracy double, precision double, "
                     "recall double, f1 double, mean_score double")
SCORED_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("flow_id", "src_ip", "dst_ip", "protocol", "predicted_class")]
    + [T.StructField("confidence", T.DoubleType()), T.StructField("is_attack", T.BooleanType()),
       T.StructField("blocked", T.BooleanType())]
    + [T.StructField(f, T.DoubleType()) for f in FEATURES])


def csv_features(spark: SparkSession, path: str, label: str = "label") -> list[str]:
    """Feature names from the header alone; the label column must be there."""
    columns = spark.read.option("header", True).csv(path).columns
    if label not in columns:
        raise ValueError(f"label column {label!r} not found in {path}")
    return [c for c in columns if c != label]


def flow_schema(features=FEATURES, label: str = "label") -> T.StructType:
    return T.StructType([T.StructField(f, T.DoubleType()) for f in features]
                        + [T.StructField(label, T.StringType())])


BAD_LINE = "_bad_line"


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType | str, bad_lines: str = "fail", **options) -> DataFrame:
    """Typed, splittable CSV scan (a file, a folder or a glob) that binds columns by their names in the header.

    A missing column is an error, further columns are left out, and every file must have the same header. A line that does
    not fit (in the columns used later) ends the job with ``bad_lines="fail"``; with ``"column"`` it is kept as text in ``_bad_line``, other cells null.
    """
    if bad_lines not in ("fail", "column"):
        raise ValueError(f"unknown treatment of bad lines {bad_lines!r}")
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = spark.read.option("header", True).csv(path).columns
    if missing := [f.name for f in wanted if f.name not in header]:
        raise ValueError(f"columns {missing} not found in the header of {path}")
    kinds = {f.name: f.dataType for f in wanted}
    fields = [T.StructField(c, kinds.get(c, T.StringType())) for c in header]
    reader = spark.read.option("header", True).option("enforceSchema", False).options(**options)
    names = [f"`{f.name}`" for f in wanted]
    if bad_lines == "fail":
        return reader.schema(T.StructType(fields)).option("mode", "FAILFAST").csv(path).select(*names)
    rows = reader.schema(T.StructType([*fields, T.StructField(BAD_LINE, T.StringType())])).option(
        "columnNameOfCorruptRecord", BAD_LINE).csv(path)
    # a length is never negative, but the planner does not know it: all cells are parsed, whichever columns are used later
    never = F.length(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in header])) < 0
    rows = rows.withColumn(BAD_LINE, F.coalesce(BAD_LINE, F.when(never, "")))
    return rows.select(*[F.when(F.col(BAD_LINE).isNull(), F.col(n)).alias(n.strip("`")) for n in names], BAD_LINE)


def read_flows_csv(spark: SparkSession, path: str, schema: T.StructType | str, bad_lines: str = "fail") -> DataFrame:
    """Flow records by column name; infinities and NaN are kept."""
    return read_csv_by_name(spark, path, schema, bad_lines, nanValue="NaN", positiveInf="inf", negativeInf="-inf")


def first_rows(df: DataFrame, order, n: int) -> DataFrame:
    """The first n rows of a total order; a top-n per task, never a full sort."""
    return df.orderBy(*order).limit(n)


def read_table(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns; the count reads file footers only."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


BATCH_ROWS = 100_000


def map_batches(df: DataFrame, fn, schema, rows: int = BATCH_ROWS) -> DataFrame:
    """Apply ``fn`` to Arrow record batches of at most ``rows`` rows, inside the tasks."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def load_splits(spark: SparkSession, root: str, variant: str = "original") -> dict[str, DataFrame]:
    """Train rows of a variant; test and validation always from the original.

    ``root`` is one Parquet table partitioned by variant and split, so each
    frame reads its own folders only.
    """
    rows = spark.read.parquet(root)
    pick = lambda v, s: rows.filter((F.col("variant") == v) & (F.col("split") == s)).drop("variant", "split")
    return {"train": pick(variant, "train"), "test": pick("original", "test"), "val": pick("original", "val")}


def latest_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """The most recently written ``predictions_*`` snapshot, with parsed timestamps."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .select("path", "modificationTime")
             .withColumn("snapshot", F.regexp_extract("path", r"(.*/predictions_[^/]+)", 1))
             .filter("snapshot <> ''"))
    newest = files.agg(F.max(F.struct("modificationTime", "snapshot")).alias("m")).first()["m"]
    if newest is None:
        raise FileNotFoundError(f"no predictions in {folder}")
    rows = read_csv_by_name(spark, newest["snapshot"], SCORED_SCHEMA)
    return rows.withColumn("timestamp", F.to_timestamp("timestamp"))


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    return read_csv_by_name(spark, path, COMPARISON_SCHEMA)


def model_inventory(spark: SparkSession, root: str) -> DataFrame:
    """algorithm, file, path, size_mb of every saved model under root/<algorithm>/<model>."""
    base = root.rstrip("/")
    tail = F.regexp_extract("path", r"(.*?)/([^/]+)/([^/]+)$", 0)
    parts = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
             .select("path", "length")
             .withColumn("_t", F.split(F.element_at(F.split(tail, base.split("/")[-1] + "/"), -1), "/")))
    return (parts.filter(F.size("_t") >= 2)
            .groupBy(F.get("_t", F.lit(0)).alias("algorithm"), F.get("_t", F.lit(1)).alias("file"))
            .agg((F.sum("length") / 1048576.0).alias("size_mb"))
            .withColumn("path", F.concat_ws("/", F.lit(base), "algorithm", "file")))


def packet_stream(spark: SparkSession, path: str, schema=PACKET_SCHEMA, fmt: str = "parquet",
                  max_files: int | None = None, **options) -> DataFrame:
    """Unbounded source: new files of a folder, at most ``max_files`` per batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)
