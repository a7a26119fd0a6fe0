"""URL verdicts: listed rules by longest match, then association rules mined from the listed pages.

The pages a list names are the labels: Spark's FP-growth counts their URL tokens together with the item "blocked"; tokens that only spell the
listed rules take no part. Combinations that occur on at least ``MIN_PAGES`` blocked pages, at any size of the input, and nearly always on blocked
ones become rules for the pages no listed rule reaches; listed pages that are allowed speak against a rule. Rules match by an inverted index: the
distinct URLs' tokens are joined with the rules' tokens, and a rule fires where all its tokens were met.

Defined results: a null URL or one without "://" has an empty host and path, fits no rule and is allowed; equal URLs get
equal verdicts, repeated rows each get one; an empty table gives an empty result; only page_id and url are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.session import materialise

# Host, path, verdict of the listed rules.
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "=blocked"
MIN_PAGES, MIN_CONFIDENCE = 10, 0.9


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Host labels, the pieces of labels with a hyphen, and path segments without their extension; all-digit parts say nothing."""
    labels = F.split(host, r"\.")
    pieces = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    segments = F.transform(F.split(path, "/"), lambda x: F.substring_index(x, ".", 1))
    telling = lambda x: (x != "") & ~x.rlike("^[0-9]+$")
    tag = lambda t, xs: F.transform(F.filter(xs, telling), lambda x: F.concat(F.lit(t), x))
    return F.array_distinct(F.concat(tag("h:", labels), tag("w:", pieces), tag("p:", segments)))


def spelled(rules=LISTED) -> list[str]:
    """The tokens that spell the listed rules."""
    return sorted({"h:" + x for h, _, _ in rules for x in h.split(".")} | {"p:" + x for _, p, _ in rules for x in p.split("/") if x})


def mine(listed: DataFrame, n_pages: int) -> DataFrame:
    """rule_id, antecedent of the rules "these tokens -> blocked", of any length, without those that hold all tokens of a shorter one."""
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (MIN_PAGES - 0.5) / n_pages), minConfidence=MIN_CONFIDENCE).fit(listed)
    found = model.associationRules.where(F.get("consequent", F.lit(0)) == BLOCKED)
    found = materialise(found.select(F.xxhash64(F.sort_array("antecedent")).alias("rule_id"), "antecedent"), "url-rules")
    held = found.select("rule_id", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    inner = held.select(F.col("rule_id").alias("inner"), F.col("n").alias("needed"), "token")
    longer = held.join(inner, "token").where("needed < n").groupBy("rule_id", "inner").agg(
        F.count(F.lit(1)).alias("met"), F.first("needed").alias("needed")).where("met = needed").select("rule_id").distinct()
    return found.join(longer, "rule_id", "left_anti")


def judge(pages: DataFrame, rules=LISTED) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. Adaptive execution checks the size of the mined rules' index before it broadcasts it."""
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "listed": verdict})
    named = parts.where(F.col("listed").isNotNull())
    n_named = named.count()
    if n_named < MIN_PAGES:
        return parts.select("page_id", "host", "path", "rule", F.coalesce("listed", F.lit("allow")).alias("verdict"))
    telling = F.array_except(tokens(F.col("host"), F.col("path")), F.array(*map(F.lit, spelled(rules))))
    items = F.concat(telling, F.when(F.col("listed") == "block", F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>")))
    mined = materialise(mine(named.select(items.alias("items")), n_named), "url-rules")
    index = mined.select("rule_id", F.size("antecedent").alias("needed"), F.explode("antecedent").alias("token"))
    open_urls = parts.where(F.col("listed").isNull() & (F.col("host") != "")).select("url", "host", "path").distinct()
    met = open_urls.select("url", F.explode(tokens(F.col("host"), F.col("path"))).alias("token")).join(index, "token")
    fired = (met.groupBy("url", "rule_id").agg(F.count(F.lit(1)).alias("met"), F.first("needed").alias("needed"))
             .where("met = needed").select("url").distinct().withColumn("mined", F.lit("block")))
    return parts.join(fired, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"))
