"""A Merkle manifest of a dataset with nested-interval labels.

Every node of the tree carries the interval [lo, hi] of leaf ranks it covers, so a parent's interval contains its children's, and nothing else
is needed to find relatives. Nodes of one level are bucketed by the parent they must lie in (``lo`` divided by the parent's width), and a
containment join inside the bucket attaches the ancestor. The siblings of a node are the difference of the two intervals: children of its
parent that end before ``lo`` or begin after ``hi``, which is also their order, left and right.

A parent row holds its at most ``FAN`` children. Paths are attached from the top down, once for the ``FAN`` leaves of a run rather than for each
leaf, so that the last join, by far the largest, moves one row in ``FAN``. Texts are read once, for the leaves' digests.

The tree is built per language, ascending by id, and once more over the languages' roots. A row's proof is the list of siblings on its way up;
folding a leaf with them gives the root again exactly if nothing has changed.

Defined results: a null column counts as ``-``; a null id comes first; equal ids go by leaf digest and then by their place in the input (equal
rows have equal leaves, but proofs of their own places); an empty text has 0 bytes; a single row is its own root with an empty proof; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import ranked
from netloom.session import materialise

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """Byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row with ``text`` as its text."""
    return digest(*(framed(text if c == "text" else F.col(c)) for c in FIELDS))


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """lang, doc_id, leaf, altered (the leaf of the row with that text), n, and the row's rank in its language; written once."""
    rows = docs.select("doc_id", "lang", F.unhex(leaf(F.col("text"))).alias("leaf"),
                       F.unhex(leaf(F.col("text") if altered is None else altered)).alias("altered"),
                       F.monotonically_increasing_id().alias("row"))
    placed = ranked(materialise(rows, "digests"), ["lang"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("row")])
    return materialise(placed.select("lang", "doc_id", "leaf", "altered", "rank"), "leaves")


@dataclass(frozen=True)
class Tree:
    """``levels[0]`` are runs of leaves, and so on up: grp, bucket, lo, hi, kids (lo, hi, digest), digest. ``roots``: grp, digest."""

    levels: list[DataFrame]
    roots: DataFrame


def runs_of(nodes: DataFrame, width: int) -> DataFrame:
    """Parents over nodes (grp, lo, hi, digest) of one level: a bucket is one parent's interval of ``width`` leaves."""
    kids = F.sort_array(F.collect_list(F.struct("lo", "hi", "digest")))           # at most FAN of them
    rows = nodes.groupBy("grp", F.expr(f"lo div {width}").alias("bucket")).agg(kids.alias("kids"))
    together = F.array_join(F.transform("kids", lambda k: hexed(k["digest"])), "")
    return rows.select("grp", "bucket", F.get("kids", F.lit(0))["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "kids",
                       F.unhex(F.sha2(together, 256)).alias("digest"))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def build(leaf_nodes: DataFrame) -> Tree:
    """The trees of all groups at once over (grp, rank, digest). A group stops rising at its root; the tallest decides the number of levels."""
    sizes = leaf_nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes = leaf_nodes.select("grp", F.col("rank").alias("lo"), F.col("rank").alias("hi"), "digest")
    single = leaf_nodes.where("rank = 0").join(sizes.where("n = 1").select(F.col("grp").alias("_g")), F.col("grp").eqNullSafe(F.col("_g"))).select("grp", "digest")
    levels, roots, width = [], [single], FAN
    while width < most * FAN:
        found = materialise(runs_of(nodes, width), f"level{len(levels)}")
        tops = sizes.where(f"n <= {width} AND n > {width // FAN}").select(F.col("grp").alias("_g"))
        roots.append(found.where("bucket = 0").join(tops, F.col("grp").eqNullSafe(F.col("_g"))).select("grp", "digest"))
        done = sizes.where(f"n <= {width}").select(F.col("grp").alias("_g"))
        nodes = found.select("grp", "lo", "hi", "digest").join(done, F.col("grp").eqNullSafe(F.col("_g")), "left_anti")
        levels.append(found)
        width *= FAN
    return Tree(levels, reduce(DataFrame.unionByName, roots))


PATH = "array<struct<lo:bigint,hi:bigint,kids:array<struct<lo:bigint,hi:bigint,digest:binary>>>>"


def with_paths(tree: Tree) -> DataFrame:
    """The runs of leaves plus path: their own interval and their parent's children, then the parent's, up to the root.

    From the top down, each level's runs are joined to the runs one level up whose interval contains theirs.
    """
    above = None
    for i in reversed(range(len(tree.levels))):
        runs, width = tree.levels[i], FAN ** (i + 1)
        if above is None:
            above = runs.withColumn("path", F.array().cast(PATH))
            continue
        up = above.select(F.col("grp").alias("_g"), F.col("bucket").alias("_b"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"),
                          F.col("kids").alias("_kids"), F.col("path").alias("_path"))
        inside = (F.col("grp").eqNullSafe(F.col("_g")) & (F.expr(f"lo div {width * FAN}") == F.col("_b"))
                  & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi")))
        step = F.array(F.struct("lo", "hi", F.col("_kids").alias("kids")))
        path = F.when(F.col("_b").isNull(), F.array().cast(PATH)).otherwise(F.concat(step.cast(PATH), F.col("_path")))
        above = runs.join(up, inside, "left").select(*runs.columns, path.alias("path"))
    return above


def siblings(kids: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Hex digests of the parent's children left and right of [lo, hi]: what is left of its interval without the node's own."""
    joined = lambda found: F.array_join(F.transform(found, lambda k: hexed(k["digest"])), "")
    return joined(F.filter(kids, lambda k: k["hi"] < lo)), joined(F.filter(kids, lambda k: k["lo"] > hi))


def sides(path: Column) -> Column:
    """left and right siblings of every node on the path."""
    def one(step):
        left, right = siblings(step["kids"], step["lo"], step["hi"])
        return F.struct(left.alias("left"), right.alias("right"))
    return F.transform(path, one)


def folded(start: Column, way: Column) -> Column:
    """The digest reached from ``start`` by joining each step's siblings around it."""
    return F.aggregate(way, start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def all_of(way: Column) -> Column:
    return F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), "")


WAY = "array<struct<left:string,right:string>>"


def proofs(placed: DataFrame) -> DataFrame:
    """lang, doc_id, leaf, subroot, root, proof_sha256 and the root reached from ``altered``, for rows of ``leaves``."""
    nodes = placed.select(F.col("lang").alias("grp"), "rank", F.col("leaf").alias("digest"))
    tree = build(nodes)
    subroots = materialise(tree.roots, "subroots")
    order = ranked(subroots.select(F.lit(0).alias("all"), "grp", "digest"), ["all"], [F.col("grp").asc_nulls_first()])
    tops = materialise(order.select(F.lit(0).alias("grp"), "rank", "digest", F.col("grp").alias("lang")), "tops")
    crown = build(tops)
    root = crown.roots.select("digest")                                             # one row
    if crown.levels:
        runs = with_paths(crown).select("kids", sides(F.col("path")).alias("up"))
        at = runs.select("kids", "up", F.explode("kids").alias("me"))
        left, right = siblings(F.col("kids"), F.col("me")["lo"], F.col("me")["hi"])
        own = F.array(F.struct(left.alias("left"), right.alias("right")))
        way = at.select(F.col("me")["lo"].alias("_rank"), F.concat(own.cast(WAY), F.col("up")).alias("crown"))
        way = tops.join(way, F.col("rank") == F.col("_rank"))
    else:
        way = tops.withColumn("crown", F.array().cast(WAY))
    way = way.select(F.col("lang").alias("_lang"), F.col("digest").alias("subroot"), "crown")
    top = root.first()
    top = bytes(top[0]).hex() if top else ""

    steps = F.array().cast(WAY).alias("up")
    if tree.levels:
        runs = with_paths(tree).select("grp", "bucket", "kids", sides(F.col("path")).alias("up"))
        mine = placed.select("*", F.expr(f"rank div {FAN}").alias("_run")).join(
            runs, F.col("lang").eqNullSafe(F.col("grp")) & (F.col("_run") == F.col("bucket")))
        left, right = siblings(F.col("kids"), F.col("rank"), F.col("rank"))
        own = F.when(F.size("kids") > 1, F.array(F.struct(left.alias("left"), right.alias("right"))).cast(WAY)).otherwise(F.array().cast(WAY))
        # a lone leaf of its language is its own root; a lone leaf at the end of a longer language is hashed by itself
        own = F.when((F.size("kids") == 1) & (F.size("up") > 0), F.array(F.struct(F.lit("").alias("left"), F.lit("").alias("right"))).cast(WAY)).otherwise(own)
        mine = mine.withColumn("up", F.concat(own, F.col("up")))
    else:
        mine = placed.withColumn("up", steps)
    mine = mine.join(way, F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("way", F.concat("up", "crown"))
    return mine.select("lang", "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), F.lit(top).alias("root"),
                       F.sha2(all_of(F.col("way")), 256).alias("proof_sha256"), folded(hexed(F.col("altered")), F.col("way")).alias("folded_root"))


def verify(docs: DataFrame, altered: Column) -> DataFrame:
    """The manifest's row of every document, and whether the document as ``altered`` still leads to the root."""
    found = proofs(leaves(docs, altered))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(doc_id: Column, text: Column) -> Column:
    """Lower-cases A-Z in the text of every row whose id's crc32 divides by three."""
    chosen = F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 0
    return F.when(chosen, F.translate(text, UPPER, LOWER)).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    return verify(docs, tampered(F.col("doc_id"), F.col("text")))
