"""Quota, sampling, nearest-neighbour and synthesis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.operators import knn, quotas, synth
from netloom.plans.q_columns import KEY_TEXT, raw
from netloom.plans.registry import query
from netloom.plans.views import RAW_KEY, table, view

R6 = lambda c: F.round(c, 6)
TARGET, MINORITY = 12_000, 800        # scaled to the test tables; defaults are 800 000 / 50 000

COUNTS = "counts AS (SELECT label, count(*) AS n FROM raw_flows GROUP BY label)"
QUOTAS = f"""{COUNTS},
base AS (SELECT *, n <= {2 * MINORITY} AS is_minority, least(n, {MINORITY}) AS kept FROM counts),
budget AS (SELECT greatest({TARGET} - coalesce(sum(kept) FILTER (WHERE is_minority), 0), 0) AS b, sum(n) FILTER (WHERE NOT is_minority) AS total FROM base),
quotas AS (SELECT label, n, is_minority, CAST(CASE WHEN is_minority THEN kept
  ELSE least(floor(b * (CAST(n AS DOUBLE) / total)), n) END AS BIGINT) AS quota FROM base, budget)"""


def counts(spark, sf):
    return quotas.class_counts(raw(spark, sf), "label")


@query("b1_stratified_quotas", "raw_flows", f"{QUOTAS} SELECT label, n, is_minority, quota FROM quotas")
def _(spark, sf):
    return quotas.stratified_quotas(counts(spark, sf), TARGET, MINORITY)


@query("b1_quotas_budget_spent", "raw_flows", f"""{COUNTS}
SELECT label, n, n <= 100000 AS is_minority, CAST(CASE WHEN n <= 100000 THEN least(n, 50000) ELSE 0 END AS BIGINT) AS quota FROM counts""")
def _(spark, sf):
    return quotas.stratified_quotas(counts(spark, sf), 1, 50_000)


@query("b2_quota_draw", "raw_flows", f"""{QUOTAS},
ranked AS (SELECT flow_no, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', {KEY_TEXT}, '42')), flow_no) AS rn FROM raw_flows)
SELECT flow_no, label FROM ranked JOIN quotas USING (label) WHERE rn <= quota""")
def _(spark, sf):
    drawn = quotas.stratified_sample(raw(spark, sf), "label", RAW_KEY, TARGET, MINORITY)
    return drawn.select("flow_no", "label")


@query("u2_per_class_union", "raw_flows", f"""{QUOTAS} SELECT label, quota AS n FROM quotas WHERE quota > 0""")
def _(spark, sf):
    # one pass over all classes takes the place of a filter and a union per class
    return quotas.class_counts(quotas.stratified_sample(raw(spark, sf), "label", RAW_KEY, TARGET, MINORITY), "label")


@query("b3_minority_classes", "raw_flows", f"""{COUNTS}
SELECT label, n, round(100.0 * n / (SELECT sum(n) FROM counts), 6) AS pct,
  100.0 * n / (SELECT sum(n) FROM counts) < 1.0 OR n < 1000 AS is_minority FROM counts""")
def _(spark, sf):
    return quotas.minority_flags(counts(spark, sf), 1.0, 1000).withColumn("pct", R6("pct"))


@query("b4_minority_first_subset", "raw_flows", f"""{COUNTS},
flags AS (SELECT *, 100.0 * n / (SELECT sum(n) FROM counts) < 1.0 OR n < 1000 AS small FROM counts),
budget AS (SELECT greatest(9000 - sum(n) FILTER (WHERE small), 0) AS b, sum(n) FILTER (WHERE NOT small) AS total FROM flags),
quotas AS (SELECT label, CAST(CASE WHEN small THEN n ELSE least(floor(b * (CAST(n AS DOUBLE) / total)), n) END AS BIGINT) AS quota FROM flags, budget),
ranked AS (SELECT flow_no, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', {KEY_TEXT}, '42')), flow_no) AS rn FROM raw_flows)
SELECT flow_no, label FROM ranked JOIN quotas USING (label) WHERE rn <= quota""")
def _(spark, sf):
    return quotas.minority_first_subset(raw(spark, sf), "label", RAW_KEY, 9000, 1.0, 1000).select("flow_no", "label")


@query("b8_estimated_output", "raw_flows", f"{COUNTS} SELECT max(n) * count(*) AS estimated_rows FROM counts")
def _(spark, sf):
    return quotas.estimated_output(counts(spark, sf))


@query("b9_generation_targets", "raw_flows", f"""{COUNTS}
SELECT label, n, CAST(greatest(least(floor((SELECT max(n) FROM counts) * 0.8) - n, 15000), 0) AS BIGINT) AS to_generate FROM counts""")
def _(spark, sf):
    return quotas.generation_targets(counts(spark, sf), cap=15_000)


@query("a29_synthetic_quality", "raw_flows", f"""{COUNTS},
r AS (SELECT label, n, (SELECT max(n) FROM counts) AS target FROM counts)
SELECT *, target - n AS synthetic, round((target - n) / CAST(n AS DOUBLE), 6) AS ratio,
  CASE WHEN (target - n) / CAST(n AS DOUBLE) <= 3 THEN 'Excellent' WHEN (target - n) / CAST(n AS DOUBLE) <= 10 THEN 'Good'
       WHEN (target - n) / CAST(n AS DOUBLE) <= 20 THEN 'Risky' ELSE 'Poor' END AS quality FROM r""")
def _(spark, sf):
    return quotas.synthetic_quality(counts(spark, sf)).withColumn("ratio", R6("ratio"))


@query("b11_quality_gate", "raw_flows", f"""{COUNTS}
SELECT label, n FROM counts WHERE ((SELECT max(n) FROM counts) - n) / CAST(n AS DOUBLE) > 20""")
def _(spark, sf):
    checked = quotas.quality_gate(counts(spark, sf), allow_poor=True)
    return checked.filter("quality = 'Poor'").select("label", "n")


# ---- neighbours and synthesis over the imbalanced points ------------------------
_D2 = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
SIZES = """sizes AS (SELECT cls, count(*) AS n FROM vectors GROUP BY cls),
smallest AS (SELECT min(n) AS lo, max(n) AS top FROM sizes)"""
PAIRS = f"pairs AS (SELECT a.id, a.cls, b.id AS nn_id, b.cls AS nn_cls, {_D2} AS d2 FROM vectors a JOIN vectors b ON a.id <> b.id)"
OWN = """own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS pos FROM pairs WHERE cls = nn_cls)"""
ANY = """everyone AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS pos FROM pairs)"""
KFIT = "(SELECT CASE WHEN lo <= {k} THEN greatest(1, lo - 1) ELSE {k} END FROM smallest)"
RANKED = """ranked AS (SELECT v.id, v.cls, n, row_number() OVER (PARTITION BY v.cls ORDER BY md5(concat_ws(':', CAST(v.id AS VARCHAR), '42')), v.id) AS rnk
  FROM vectors v JOIN sizes USING (cls))"""


def emit_sql(draws: str, k: str) -> str:
    """Synthetic rows for ``draws`` (id, cls, n_draws), from the k own-class neighbours."""
    return f"""draw AS (SELECT id, cls, unnest(generate_series(0, n_draws - 1)) AS draw FROM {draws} WHERE n_draws > 0),
picked AS (SELECT *, md5(concat_ws(':', CAST(id AS VARCHAR), CAST(draw AS VARCHAR), '42')) AS h FROM draw),
chosen AS (SELECT id, cls, draw, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u,
  CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % {k} + 1 AS pos FROM picked),
made AS (SELECT c.cls, c.id AS base_id, o.nn_id, c.draw, c.u, list_transform(list_zip(x.vec, y.vec), lambda p: p[1] + c.u * (p[2] - p[1])) AS vec
  FROM chosen c JOIN own o ON o.id = c.id AND o.pos = c.pos JOIN vectors x ON x.id = c.id JOIN vectors y ON y.id = o.nn_id)"""


SHOW = """SELECT cls, base_id, nn_id, draw, round(u, 9) AS u, round(vec[1], 6) AS v1, round(vec[2], 6) AS v2,
  round(vec[64], 6) AS v64, round(list_sum(vec), 4) AS total FROM made"""


def points(spark, sf):
    return view(spark, sf, "vectors")


def show(made):
    at = lambda i: F.round(F.element_at("vec", i), 6)
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 4)
    return made.select("cls", "base_id", "nn_id", "draw", F.round("u", 9).alias("u"), at(1).alias("v1"),
                       at(2).alias("v2"), at(64).alias("v64"), total.alias("total"))


def listed(with_nn):
    return with_nn.select("id", F.posexplode("nn").alias("p", "x")).select(
        "id", (F.col("p") + 1).alias("pos"), F.col("x.nn_id").alias("nn_id"), F.round("x.dist2", 6).alias("d2"))


@query("j4_knn_all_classes", "vectors", f"""{PAIRS}, {ANY}
SELECT id, CAST(pos AS INT) AS pos, nn_id, round(d2, 6) AS d2 FROM everyone WHERE pos <= 5""")
def _(spark, sf):
    return listed(knn.nearest(points(spark, sf), points(spark, sf), 5))


@query("j4_knn_same_class", "vectors", f"""{PAIRS}, {OWN}
SELECT id, CAST(pos AS INT) AS pos, nn_id, round(d2, 6) AS d2 FROM own WHERE pos <= 5""")
def _(spark, sf):
    return listed(knn.nearest(points(spark, sf), points(spark, sf), 5, within="cls"))


@query("j4_knn_pruned_cells", "vectors", f"""{PAIRS}, {ANY}
SELECT id, CAST(pos AS INT) AS pos, nn_id, round(d2, 6) AS d2 FROM everyone WHERE pos <= 3""")
def _(spark, sf):
    # the path large tables take: pivot cells, several blocks per cell
    p = points(spark, sf)
    return listed(knn.nearest(p, p, 3, block_rows=64, query_rows=50, n_pivots=8))


@query("j4_knn_two_levels", "", """v AS (SELECT event_id AS id, value / 10.0 AS x, CAST(user_id % 50 AS DOUBLE) AS y, CAST((event_id * 37) % 1000 AS DOUBLE) / 10.0 AS z FROM events),
near AS (SELECT a.id, min(struct_pack(d2 := (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), nn_id := b.id), 3) AS nn
  FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id),
flat AS (SELECT id, unnest(nn) AS x, unnest(generate_series(1, 3)) AS pos FROM near)
SELECT id, CAST(pos AS INT) AS pos, x.nn_id AS nn_id, round(x.d2, 6) AS d2 FROM flat""")
def _(spark, sf):
    # a quarter as many cells as events, above 2 048 from 8 192 events on: areas, then the cells in them
    p = table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.lit(0).alias("cls"),
        F.array(F.col("value") / 10.0, (F.col("user_id") % 50).cast("double"), ((F.col("event_id") * 37) % 1000).cast("double") / 10.0).alias("vec"))
    return listed(knn.nearest(p, p, 3, block_rows=8))


@query("b5_smote", "vectors", f"""{SIZES}, {PAIRS}, {OWN}, {RANKED},
shares AS (SELECT id, cls, CAST(greatest(ceil((top - n - (rnk - 1)) / CAST(n AS DOUBLE)), 0) AS BIGINT) AS n_draws FROM ranked, smallest WHERE n < top),
{emit_sql('shares', KFIT.format(k=5))}
{SHOW}""")
def _(spark, sf):
    return show(synth.smote(points(spark, sf)))


FOREIGN = """hood AS (SELECT e.id, e.cls, n, count(*) FILTER (WHERE nn_cls <> e.cls) AS n_foreign FROM everyone e JOIN sizes USING (cls), smallest
  WHERE n < top AND pos <= {m} GROUP BY e.id, e.cls, n)"""
ADASYN = f"""{SIZES}, {PAIRS}, {OWN}, {ANY}, {FOREIGN.format(m=KFIT.format(k=5))},
shares AS (SELECT id, cls, n_foreign, CAST(round_even(n_foreign * (top - n) / CAST(sum(n_foreign) OVER (PARTITION BY cls) AS DOUBLE), 0) AS BIGINT) AS n_draws FROM hood, smallest)"""


@query("b6_adasyn_counts", "vectors", f"{ADASYN} SELECT id, cls, n_foreign, n_draws FROM shares")
def _(spark, sf):
    return synth.adasyn_counts(points(spark, sf))


@query("b6_adasyn", "vectors", f"{ADASYN}, {emit_sql('shares', KFIT.format(k=5))} {SHOW}")
def _(spark, sf):
    return show(synth.adasyn(points(spark, sf)))


STATUS = f"""{SIZES}, {PAIRS}, {OWN}, {ANY}, {FOREIGN.format(m=KFIT.format(k=10))},
status AS (SELECT *, CASE WHEN n_foreign = {KFIT.format(k=10)} THEN 'noise' WHEN n_foreign * 2 >= {KFIT.format(k=10)} THEN 'danger' ELSE 'safe' END AS status FROM hood)"""


@query("b7_border_status", "vectors", f"{STATUS} SELECT id, cls, n_foreign, status FROM status")
def _(spark, sf):
    return synth.border_status(points(spark, sf)).select("id", "cls", "n_foreign", "status")


SEEDED = f"""{STATUS},
seeds AS (SELECT id, cls, n, count(*) OVER (PARTITION BY cls) AS n_seed,
  row_number() OVER (PARTITION BY cls ORDER BY md5(concat_ws(':', CAST(id AS VARCHAR), '42')), id) AS rnk FROM status WHERE status = 'danger'),
shares AS (SELECT id, cls, CAST(greatest(ceil((top - n - (rnk - 1)) / CAST(n_seed AS DOUBLE)), 0) AS BIGINT) AS n_draws FROM seeds, smallest)"""


@query("b7_borderline_smote", "vectors", f"{SEEDED}, {emit_sql('shares', KFIT.format(k=5))} {SHOW}")
def _(spark, sf):
    return show(synth.borderline_smote(points(spark, sf)))


# own-class neighbours first, then the foreign ones among the m nearest, reached half way
@query("b7_borderline_kind_2", "vectors", f"""{SEEDED},
mixed AS (SELECT id, nn_id, 1.0::DOUBLE AS reach, pos AS place FROM own WHERE pos <= {KFIT.format(k=5)}
  UNION ALL SELECT id, nn_id, 0.5::DOUBLE, 1000 + pos FROM everyone WHERE nn_cls <> cls AND pos <= {KFIT.format(k=10)}),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS pos, count(*) OVER (PARTITION BY id) AS width FROM mixed),
draw AS (SELECT id, cls, unnest(generate_series(0, n_draws - 1)) AS draw FROM shares WHERE n_draws > 0),
picked AS (SELECT *, md5(concat_ws(':', CAST(id AS VARCHAR), CAST(draw AS VARCHAR), '42')) AS h FROM draw),
chosen AS (SELECT p.id, p.cls, p.draw, n.nn_id, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * reach AS u
  FROM picked p JOIN near n ON n.id = p.id AND n.pos = CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % n.width + 1),
made AS (SELECT c.cls, c.id AS base_id, c.nn_id, c.draw, c.u, list_transform(list_zip(x.vec, y.vec), lambda p: p[1] + c.u * (p[2] - p[1])) AS vec
  FROM chosen c JOIN vectors x ON x.id = c.id JOIN vectors y ON y.id = c.nn_id)
{SHOW}""")
def _(spark, sf):
    return show(synth.borderline_smote(points(spark, sf), kind="borderline-2"))


@query("u1_merge_synthetic", "vectors", f"""{SIZES}
SELECT cls, n AS n_original, (SELECT top FROM smallest) - n AS n_synthetic, (SELECT top FROM smallest) AS n_final FROM sizes""")
def _(spark, sf):
    base = points(spark, sf)
    made = synth.smote(base)
    merged = synth.merge_synthetic(base.select("cls", "vec"), made.select("cls", "vec", "is_synthetic"))
    return merged.groupBy("cls").agg(F.count_if(~F.col("is_synthetic")).alias("n_original"),
                                     F.count_if("is_synthetic").alias("n_synthetic"), F.count(F.lit(1)).alias("n_final"))


@query("u3_synthetic_only", "vectors", f"""{SIZES} SELECT cls, (SELECT top FROM smallest) - n AS n FROM sizes WHERE n < (SELECT top FROM smallest)""")
def _(spark, sf):
    base = points(spark, sf).select("cls", "vec")
    made = synth.smote(points(spark, sf)).select("cls", "vec")
    extra = synth.synthetic_only(base.unionByName(made), base)
    return extra.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


@query("a30_accounting", "vectors", f"""{SIZES}
SELECT cls, n AS original, n AS sample, (SELECT top FROM smallest) AS augmented, (SELECT top FROM smallest) AS final,
  (SELECT top FROM smallest) - n AS generated, round(((SELECT top FROM smallest) - n) / CAST(n AS DOUBLE), 6) AS generated_ratio FROM sizes""")
def _(spark, sf):
    base = points(spark, sf).select("cls")
    final = base.unionByName(synth.smote(points(spark, sf)).select("cls"))
    return quotas.accounting("cls", base, base, final, final).withColumn("generated_ratio", R6("generated_ratio"))


@query("k3_phase_table", "vectors", f"""{SIZES}
SELECT 'original' AS phase, CAST(cls AS VARCHAR) AS class, n FROM sizes UNION ALL SELECT 'final', CAST(cls AS VARCHAR), (SELECT top FROM smallest) FROM sizes""")
def _(spark, sf):
    base = points(spark, sf).select("cls")
    return quotas.phase_table("cls", {"original": base, "final": base.unionByName(synth.smote(points(spark, sf)).select("cls"))})


@query("m5_knn_classifier", "vectors", f"""pairs AS (SELECT a.id, a.cls, b.id AS nn_id, b.cls AS nn_cls, {_D2} AS d2
  FROM vectors a JOIN vectors b ON a.id <> b.id),
near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nn_id) AS pos FROM pairs),
votes AS (SELECT id, cls, nn_cls, count(*) AS v, min(pos) AS first FROM near WHERE pos <= 5 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, first) AS r FROM votes)
SELECT id, cls, nn_cls AS predicted, v / 5.0::DOUBLE AS confidence FROM best WHERE r = 1""")
def _(spark, sf):
    # leave-one-out over every point
    p = points(spark, sf)
    return knn.classify(p, p, 5, exclude_self=True).select("id", "cls", "predicted", "confidence")
