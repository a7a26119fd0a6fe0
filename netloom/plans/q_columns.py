"""Cleaning, encoding, projection and lookup queries over the raw flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions.columns import col, is_infinite
from netloom.operators import clean, encode, profile, ranking
from netloom.plans import prepare
from netloom.plans.registry import query
from netloom.plans.views import RAW_FEATURES as FEATS
from netloom.plans.views import RAW_KEY, view
from netloom.session import materialise
from netloom.taxonomy import macro_name, taxonomy

R6 = lambda c: F.round(c, 6)

# ---- the same steps as SQL parts ------------------------------------------------
# The 34 labels by class and the classes' codes, written out so that an error in the library's table shows.
TAXONOMY_SQL = """taxonomy AS (SELECT unnest(labels) AS label, macro, macro_code FROM (VALUES
  (['DDoS-ICMP_Flood', 'DDoS-UDP_Flood', 'DDoS-TCP_Flood', 'DDoS-PSHACK_Flood', 'DDoS-RSTFINFlood', 'DDoS-SYN_Flood', 'DDoS-SynonymousIP_Flood',
    'DDoS-ICMP_Fragmentation', 'DDoS-UDP_Fragmentation', 'DDoS-ACK_Fragmentation', 'DDoS-HTTP_Flood', 'DDoS-SlowLoris'], 'DDoS', 2),
  (['DoS-UDP_Flood', 'DoS-TCP_Flood', 'DoS-SYN_Flood', 'DoS-HTTP_Flood'], 'DoS', 3),
  (['Mirai-greeth_flood', 'Mirai-udpplain', 'Mirai-greip_flood'], 'Mirai', 4), (['MITM-ArpSpoofing', 'DNS_Spoofing'], 'Spoofing', 6),
  (['Recon-HostDiscovery', 'Recon-OSScan', 'Recon-PortScan', 'Recon-PingSweep', 'VulnerabilityScan'], 'Recon', 5),
  (['SqlInjection', 'XSS', 'CommandInjection', 'Uploading_Attack', 'BrowserHijacking', 'Backdoor_Malware'], 'Web', 7),
  (['DictionaryBruteForce'], 'BruteForce', 1), (['BenignTraffic'], 'Benign', 0)) t(labels, macro, macro_code))"""
_FILL = ", ".join(f"CASE WHEN {f} IS NULL OR isnan({f}) THEN 0 ELSE {f} END AS {f}" for f in FEATS)
_MAX = ", ".join(f"max(CASE WHEN NOT isinf({f}) THEN {f} END) AS m_{f}" for f in FEATS)
_SWAP = ", ".join(f"CASE WHEN isinf(a.{f}) THEN m_{f} ELSE a.{f} END AS {f}" for f in FEATS)
FILLED_SQL = f"filled AS (SELECT flow_no, label, split, {_FILL} FROM raw_flows)"
FINITE_SQL = (f"{FILLED_SQL}, tops AS (SELECT split, {_MAX} FROM filled GROUP BY split), "
              f"finite AS (SELECT a.flow_no, a.label, a.split, {_SWAP} FROM filled a JOIN tops USING (split))")
CLEAN_SQL = f"{FINITE_SQL}, cleaned AS (SELECT DISTINCT {', '.join(FEATS)}, label, split FROM finite)"
_STATS = ", ".join(f"avg({f}) AS mu_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS sd_{f}"
                   for f in FEATS)
_SCALE = ", ".join(f"round(({f} - mu_{f}) / sd_{f}, 6) AS {f}" for f in FEATS)
CODES_SQL = ("codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx "
             "FROM (SELECT DISTINCT label FROM cleaned WHERE split = 'train'))")
PREPARED_SQL = (f"{CLEAN_SQL}, {TAXONOMY_SQL}, {CODES_SQL}, "
                f"stats AS (SELECT {_STATS} FROM cleaned WHERE split = 'train'), "
                f"prepared AS (SELECT {_SCALE}, coalesce(macro_code, -1) AS y_macro_encoded, "
                "coalesce(idx, -1) AS y_specific, split FROM cleaned LEFT JOIN taxonomy USING (label) "
                "LEFT JOIN codes USING (label) CROSS JOIN stats)")


def raw(spark, sf):
    return view(spark, sf, "raw_flows")


def cleaned(spark, sf):
    return clean.clean(raw(spark, sf), FEATS, by=["split"])


def cleaned_table(spark, sf):
    """The cleaned rows written once, for work that scans them several times."""
    return materialise(cleaned(spark, sf), "cleaned")


def prepared(spark, sf):
    """Clean, encode and standardise; everything is learned from train only."""
    return prepare.prepare(raw(spark, sf), FEATS).rows


@query("prepare_macro_report", "raw_flows", f"""{PREPARED_SQL}
SELECT split, y_macro_encoded, count(*) AS n, round(avg(f1), 4) AS avg_f1, round(avg(f2), 4) AS avg_f2
FROM prepared GROUP BY split, y_macro_encoded""")
def _(spark, sf):
    return (prepared(spark, sf).withColumns({f: R6(f) for f in FEATS}).groupBy("split", "y_macro_encoded")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 4).alias("avg_f1"),
                 F.round(F.avg("f2"), 4).alias("avg_f2")))


@query("p1_fill_missing", "raw_flows", f"""{FILLED_SQL}
SELECT flow_no, f1, CASE WHEN isinf(f2) THEN -1 ELSE f2 END AS f2, isinf(f2) AS f2_infinite, f3, f4, f5 FROM filled""")
def _(spark, sf):
    # infinities stay in place at this step; they are shown as a flag
    filled = clean.fill_missing(raw(spark, sf), FEATS)
    endless = is_infinite(F.col("f2"))
    return filled.select("flow_no", "f1", F.when(endless, -1.0).otherwise(F.col("f2")).alias("f2"),
                         endless.alias("f2_infinite"), "f3", "f4", "f5")


@query("p2_inf_to_max", "raw_flows", f"{FINITE_SQL} SELECT * FROM finite")
def _(spark, sf):
    filled = clean.fill_missing(raw(spark, sf), FEATS)
    return clean.replace_infinite(filled, FEATS, by=["split"]).select("flow_no", "label", "split", *FEATS)


@query("p3_drop_duplicates", "raw_flows", f"{CLEAN_SQL} SELECT * FROM cleaned")
def _(spark, sf):
    return cleaned(spark, sf).select(*FEATS, "label", "split")


_COARSE = ["f1", "f3", "f4", "label", "split"]


@query("p3_removed_rows", "raw_flows", f"""{FINITE_SQL},
copies AS (SELECT {', '.join(_COARSE)}, count(*) AS n FROM finite GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_before, count(*) AS n_after, CAST(sum(n) - count(*) AS BIGINT) AS n_removed FROM copies""")
def _(spark, sf):
    filled = clean.fill_missing(raw(spark, sf), FEATS)
    return clean.removed_rows(clean.replace_infinite(filled, FEATS, by=["split"]), _COARSE)


@query("p4_unknown_labels", "raw_flows", f"""{TAXONOMY_SQL}
SELECT label, count(*) AS n FROM raw_flows WHERE label NOT IN (SELECT label FROM taxonomy) GROUP BY label""")
def _(spark, sf):
    return clean.unknown_labels(raw(spark, sf))


@query("p5_cleaning_counters", "raw_flows", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL OR isnan({f})) AS n_missing, "
    f"count(*) FILTER (WHERE isinf({f})) AS n_infinite FROM raw_flows" for f in FEATS))
def _(spark, sf):
    return clean.cleaning_counters(raw(spark, sf), FEATS)


@query("p6_macro_map", "raw_flows", f"""{TAXONOMY_SQL}
SELECT flow_no, label, macro FROM raw_flows LEFT JOIN taxonomy USING (label)""")
def _(spark, sf):
    return encode.with_macro(raw(spark, sf)).select("flow_no", "label", "macro")


@query("p7_dictionary_codes", "raw_flows", f"""{TAXONOMY_SQL},
codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx
          FROM (SELECT DISTINCT label FROM raw_flows WHERE split = 'val'))
SELECT flow_no, coalesce(macro_code, -1) AS y_macro_encoded, coalesce(idx, -1) AS y_specific
FROM raw_flows LEFT JOIN taxonomy USING (label) LEFT JOIN codes USING (label)""")
def _(spark, sf):
    flows = raw(spark, sf)
    codes = encode.label_dictionary(flows.filter(F.col("split") == "val"))
    return encode.encode_labels(flows, codes).select("flow_no", *encode.LABEL_COLS)


@query("p8_decode_labels", "raw_flows", """
codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx FROM (SELECT DISTINCT label FROM raw_flows)),
asked AS (SELECT flow_no, CAST(flow_no % 12 AS INT) AS code FROM raw_flows)
SELECT flow_no, code, coalesce(label, concat('Class_', CAST(code AS VARCHAR))) AS name
FROM asked LEFT JOIN codes ON code = idx""")
def _(spark, sf):
    flows = raw(spark, sf)
    asked = flows.select("flow_no", (F.col("flow_no") % 12).cast("int").alias("code"))
    return encode.decode_labels(asked, encode.label_dictionary(flows), "code", "name")


@query("p8_macro_names", "scored_flows", """SELECT event_id, CASE y_pred WHEN 0 THEN 'Benign' WHEN 1 THEN 'BruteForce'
  WHEN 2 THEN 'DDoS' WHEN 3 THEN 'DoS' WHEN 4 THEN 'Mirai' WHEN 5 THEN 'Recon' WHEN 6 THEN 'Spoofing' ELSE 'Web' END AS name,
  concat('Class_', CAST(y_pred + 8 AS VARCHAR)) AS outside FROM scored_flows""")
def _(spark, sf):
    return view(spark, sf, "scored_flows").select(
        "event_id", macro_name(F.col("y_pred")).alias("name"), macro_name(F.col("y_pred") + 8).alias("outside"))


@query("p9_standardise", "raw_flows", f"{PREPARED_SQL} SELECT * FROM prepared")
def _(spark, sf):
    return prepared(spark, sf).withColumns({f: R6(f) for f in FEATS})


@query("p10_float32", "raw_flows", f"""{FINITE_SQL}
SELECT flow_no, {', '.join(f'CAST(CAST({f} AS FLOAT) AS DOUBLE) AS {f}' for f in FEATS)} FROM finite""")
def _(spark, sf):
    filled = clean.fill_missing(raw(spark, sf), FEATS)
    slim = encode.narrow(clean.replace_infinite(filled, FEATS, by=["split"]), FEATS)
    return slim.select("flow_no", *[F.col(f).cast("double").alias(f) for f in FEATS])


@query("p11_output_projection", "raw_flows", f"{PREPARED_SQL} SELECT * EXCLUDE (split) FROM prepared")
def _(spark, sf):
    return encode.model_columns(prepared(spark, sf).withColumns({f: R6(f) for f in FEATS}), FEATS)


@query("p12_binary_label", "raw_flows", """
SELECT flow_no, CASE WHEN label = 'BenignTraffic' THEN 0 ELSE 1 END AS binary_label FROM raw_flows""")
def _(spark, sf):
    return encode.binary_label(raw(spark, sf)).select("flow_no", "binary_label")


@query("p18_feature_vector", "raw_flows", """SELECT flow_no, coalesce(f1, 0) AS f1, f4, CAST(0 AS DOUBLE) AS absent FROM raw_flows""")
def _(spark, sf):
    from netloom.operators.flows import prepare_features
    ready = prepare_features(raw(spark, sf).select("flow_no", "f1", "f4"), ["f1", "f4", "absent"])
    return ready.select("flow_no", "f1", "f4", "absent")


@query("p21_timestamps", "scored_flows", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
  epoch_us(date_trunc('hour', ts)) AS hour_us FROM scored_flows""")
def _(spark, sf):
    flows = view(spark, sf, "scored_flows")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    back = F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss")
    return flows.select("event_id", iso.alias("iso"), F.unix_micros(F.date_trunc("hour", back)).alias("hour_us"))


_NUMERIC = {"flow_no": "bigint", "part_no": "bigint", "supp_no": "bigint", **{f: "double" for f in FEATS}}


@query("p24_numeric_columns", "raw_flows", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS n_present FROM raw_flows" for c, t in _NUMERIC.items()))
def _(spark, sf):
    flows = raw(spark, sf)
    numeric, kinds = clean.numeric_columns(flows), dict(flows.dtypes)
    present = flows.agg(*[F.count(col(c)).alias(c) for c in numeric])
    return present.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), col(c).alias("n_present")) for c in numeric])))


@query("p25_preview", "raw_flows", "SELECT flow_no, label, f4 FROM raw_flows ORDER BY flow_no, part_no, supp_no LIMIT 5")
def _(spark, sf):
    return profile.preview(raw(spark, sf), RAW_KEY).select("flow_no", "label", "f4")


@query("j1_lookup_join", "raw_flows", f"""{TAXONOMY_SQL}
SELECT macro, macro_code, count(*) AS n FROM raw_flows JOIN taxonomy USING (label) GROUP BY macro, macro_code""")
def _(spark, sf):
    return (encode.with_macro(profile.label_counts(raw(spark, sf))).filter(col("macro").isNotNull())
            .groupBy("macro", "macro_code").agg(F.sum("n").alias("n")))


@query("j2_semi_anti", "raw_flows", f"""{TAXONOMY_SQL}
SELECT 'known' AS side, count(*) AS n FROM raw_flows WHERE label IN (SELECT label FROM taxonomy)
UNION ALL SELECT 'unknown', count(*) FROM raw_flows WHERE label NOT IN (SELECT label FROM taxonomy)""")
def _(spark, sf):
    flows = raw(spark, sf)
    known = clean.known_only(flows).agg(F.count(F.lit(1)).alias("n")).select(F.lit("known").alias("side"), "n")
    other = clean.unknown_labels(flows).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return known.unionByName(other.select(F.lit("unknown").alias("side"), "n"))


@query("u4_majority_classes", "raw_flows", """
counts AS (SELECT label, count(*) AS n FROM raw_flows GROUP BY label)
SELECT label, n FROM counts WHERE NOT (100.0 * n / (SELECT sum(n) FROM counts) < 1.0 OR n < 300)""")
def _(spark, sf):
    from netloom.operators.quotas import class_counts, minority_flags
    flagged = minority_flags(class_counts(raw(spark, sf), "label"), 1.0, 300)
    small = flagged.filter("is_minority").select("label")
    return flagged.select("label", "n").join(small, "label", "left_anti")


@query("u5_retrain_union", "raw_flows", """
SELECT split, count(*) AS n FROM raw_flows WHERE split <> 'test' GROUP BY split""")
def _(spark, sf):
    from netloom.plans.augment import retrain_set
    flows = raw(spark, sf)
    both = retrain_set(flows.filter(F.col("split") == "train"), [flows.filter(F.col("split") == "val")])
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("u6_distinct_labels", "raw_flows", "SELECT DISTINCT split, label FROM raw_flows")
def _(spark, sf):
    return raw(spark, sf).select("split", "label").distinct()


KEY_TEXT = ", ".join(f"CAST({c} AS VARCHAR)" for c in RAW_KEY)


@query("w9_shuffle_key", "raw_flows", f"""
SELECT flow_no, md5(concat_ws(':', {KEY_TEXT}, '42')) AS shuffle_key FROM raw_flows""")
def _(spark, sf):
    return ranking.with_shuffle_key(raw(spark, sf).select(*RAW_KEY), RAW_KEY).select("flow_no", "shuffle_key")


@query("w10_random_sample", "raw_flows", f"""
SELECT flow_no, label FROM raw_flows ORDER BY md5(concat_ws(':', {KEY_TEXT}, '7')), flow_no LIMIT 2000""")
def _(spark, sf):
    flows = raw(spark, sf).select(*RAW_KEY, "label")
    return ranking.take_rows(flows, RAW_KEY, 2000, flows.count(), seed=7).select("flow_no", "label")
