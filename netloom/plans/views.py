"""Flow-shaped views over the given tables; one text serves Spark and the SQL twin.

Every view keeps all rows of its base table. Imbalance, dirt and prediction
errors are derived from the keys, never by leaving rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_FEATURES = ["f1", "f2", "f3", "f4", "f5"]
RAW_KEY = ["flow_no", "part_no", "supp_no"]

VIEW_SQL = {
    # dirty flows: NULL, NaN and both infinities; ten labels, one outside the taxonomy
    "raw_flows": """
SELECT l_orderkey * 8 + l_linenumber AS flow_no, l_partkey AS part_no, l_suppkey AS supp_no,
  CASE WHEN g % 97 = 0 THEN NULL ELSE l_quantity END AS f1,
  CASE WHEN g % 89 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN g % 83 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END AS f2,
  CASE WHEN g % 79 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS f3,
  l_tax AS f4, CAST(4 AS DOUBLE) AS f5,
  CASE WHEN h < 720 THEN CASE WHEN h % 2 = 0 THEN 'DDoS-ICMP_Flood' ELSE 'DDoS-UDP_Flood' END
       WHEN h < 890 THEN 'DoS-TCP_Flood' WHEN h < 950 THEN 'Mirai-udpplain'
       WHEN h < 975 THEN 'BenignTraffic' WHEN h < 985 THEN 'DNS_Spoofing'
       WHEN h < 992 THEN 'Recon-PortScan' WHEN h < 995 THEN 'DictionaryBruteForce'
       WHEN h < 997 THEN 'XSS' ELSE 'Unlisted_Label' END AS label,
  CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'test' ELSE 'val' END AS split
FROM (SELECT *, (l_orderkey*31 + l_partkey*17 + l_linenumber) % 1000 AS h,
             (l_orderkey*7 + l_linenumber*3) AS g FROM {lineitem}) b""",
    # decoded packets, both directions, three protocols
    "packets": """
SELECT event_id AS pkt_id, ts,
  CASE WHEN event_id % 2 = 0 THEN a_ip ELSE b_ip END AS src_ip,
  CASE WHEN event_id % 2 = 0 THEN b_ip ELSE a_ip END AS dst_ip,
  CASE WHEN proto = 'ICMP' THEN 0 WHEN event_id % 2 = 0 THEN a_port ELSE b_port END AS src_port,
  CASE WHEN proto = 'ICMP' THEN 0 WHEN event_id % 2 = 0 THEN b_port ELSE a_port END AS dst_port,
  proto, size, CASE WHEN proto = 'TCP' THEN tcp_flags ELSE 0 END AS tcp_flags
FROM (SELECT event_id, ts,
        concat('10.0.0.', CAST(user_id % 16 AS VARCHAR(10))) AS a_ip, CAST(1024 + user_id % 16 AS INT) AS a_port,
        concat('10.0.1.', CAST(k % 4 AS VARCHAR(10))) AS b_ip,
        CASE k % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53 WHEN 4 THEN 8080 ELSE 23 END AS b_port,
        CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'error' THEN 'ICMP' ELSE 'TCP' END AS proto,
        CAST(floor(value*10) AS INT) + 40 AS size, event_id % 256 AS tcp_flags
      FROM (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
              CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events}) e) p""",
    # scored flows: true and predicted macro code, confidence
    "scored_flows": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('10.0.0.', CAST(user_id AS VARCHAR(10))) AS src_ip,
  CAST(least(floor(value/50), 7) AS INT) AS y_true,
  CAST(CASE WHEN event_id % 17 = 0 THEN (least(floor(value/50), 7) + 1) % 8 ELSE least(floor(value/50), 7) END AS INT) AS y_pred,
  CAST((event_id*37) % 1000 AS DOUBLE) / 1000 AS confidence,
  CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 < 9 THEN 'test' ELSE 'val' END AS split
FROM {events}""",
    # decisions over the scored flows
    "decided": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('10.0.0.', CAST(user_id AS VARCHAR(10))) AS src_ip,
  concat('10.0.1.', CAST(event_id % 50 AS VARCHAR(10))) AS dst_ip,
  CASE CAST(least(floor(value/50), 7) AS INT) WHEN 0 THEN 'Benign' WHEN 1 THEN 'BruteForce' WHEN 2 THEN 'DDoS'
    WHEN 3 THEN 'DoS' WHEN 4 THEN 'Mirai' WHEN 5 THEN 'Recon' WHEN 6 THEN 'Spoofing' ELSE 'Web' END AS predicted_class,
  CAST((event_id*37) % 1000 AS DOUBLE) / 1000 AS confidence
FROM {events}""",
    # imbalanced points: the chosen rows keep their label, all others form class 0
    "vectors": """
SELECT vec_id AS id, CAST(CASE WHEN vec_id % (label + 1) = 0 THEN label ELSE 0 END AS INT) AS cls,
  CAST(embedding AS {doubles}) AS vec
FROM {embeddings}""",
}
BASE = {"raw_flows": "lineitem", "packets": "events", "scored_flows": "events",
        "decided": "events", "vectors": "embeddings"}


def sql_text(view: str) -> str:
    return VIEW_SQL[view].format(**{BASE[view]: BASE[view]}, doubles="DOUBLE[]").strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = BASE[name]
    text = VIEW_SQL[name].replace("{doubles}", "ARRAY<DOUBLE>")
    return spark.sql(text, **{base: table(spark, sf_dir, base)})
