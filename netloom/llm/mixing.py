"""Mix sources to target weights by drawing fixed-length blocks.

Every source's documents are laid end to end and cut into blocks of a fixed number of words. The mix is a row of slots, dealt to output
shards of a fixed size. Every source's total is fixed first: its expected slots, rounded so that the totals add up and no cap is passed.
The totals are then spread over the shards: the shards are halved again and again, and each half's counts are a multivariate
hypergeometric draw, so every shard is filled and every source gets its total. Its slots are numbered through its shards; slot j maps to block
``permutation(j mod n)`` of epoch ``j div n``, a keyed pseudorandom permutation of the source's n blocks, so an epoch
uses each block once and no document is taken more than three times. Slots and documents meet in a join by block.

Places on a source's line are prefix sums in two steps, over bins of bounded size and within a bin, so that a source
with a third of all rows is spread over many tasks.

A mix has at most ``MAX_SOURCES`` sources, one row each; that table is collected to set targets, and the job stops if there are more.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are never taken; repeated
rows are documents of their own; empty tables give empty results; only doc_id, text and source are read by ``report``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from netloom.operators.small import bounded_rows
from netloom.session import materialise

BLOCK_WORDS, SHARD_SLOTS, BIN_ROWS, MAX_REPEATS, SEED = 64, 8192, 4096, 3, 20_260
MAX_SOURCES = 200_000
SHARDS_PER_TASK = 32          # a quarter of a million slots are mapped to blocks in one task
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], most: int = MAX_REPEATS) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is shared again by weight."""
    total, level, capped = sum(sizes), 0.0, [False] * len(sizes)
    while True:
        free = sum(w for w, c in zip(weights, capped) if not c)
        level = (total - sum(most * s for s, c in zip(sizes, capped) if c)) / free if free else 0.0
        above = [c or most * s < level * w for s, w, c in zip(sizes, weights, capped)]
        if above == capped:
            return [float(most * s) if c else level * w for s, w, c in zip(sizes, weights, capped)]
        capped = above


def source_table(sized: DataFrame) -> DataFrame:
    """source, si, source_size, target, n_blocks, n_bins and quota (slots), one row per source."""
    found = bounded_rows(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")), MAX_SOURCES)
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes, [1 + i % 3 for i in range(len(found))])
    rows = []
    for i, (r, size, target) in enumerate(zip(found, sizes, goal)):
        blocks = -(-size // BLOCK_WORDS)
        rows.append((r["source"], i, size, target, blocks, -(-int(r["docs"]) // BIN_ROWS), target * blocks / size if size else 0.0))
    return sized.sparkSession.createDataFrame(
        rows, "source string, si int, source_size long, target double, n_blocks long, n_bins int, quota double")


def binned(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with their source's figures and the bin they belong to on its line."""
    side = sources.select(F.col("source").alias("_src"), "si", "n_bins", "source_size", "target")
    rows = rows.join(F.broadcast(side), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    return rows.withColumn("bin", F.pmod(F.xxhash64("doc_id", "size"), F.greatest("n_bins", F.lit(1))).cast("int"))


def placed(rows: DataFrame, sized: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with si and at: where on its source's line of words a document begins.

    ``sized`` holds the same documents as ids, sources and sizes only; the bins' sums are taken from it.
    """
    rows, bins = binned(rows, sources), binned(sized, sources).groupBy("si", "bin").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("si").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select("si", "bin", F.coalesce(before, F.lit(0)).alias("bin_at"))
    inside = F.sum("size").over(Window.partitionBy("si", "bin").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(bins, ["si", "bin"]).withColumn("at", F.col("bin_at") + F.coalesce(inside, F.lit(0))).drop("bin_at", "n_bins", "bin")


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at the given places: a four-round Feistel network, walked until it lands below n."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & mask
        for r in range(4):
            left, right = right, left ^ (_mixed(right, key * 4 + r) & mask)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def totals(quota: list[float], blocks: list[int]) -> np.ndarray:
    """Whole slots of each source: quotas rounded down, and the largest fractions up, until they add up to the rounded sum; a source
    with words gets one at least (so the sum may be passed), and none more than its cap."""
    quota, cap = np.array(quota, float), MAX_REPEATS * np.array(blocks, np.int64)
    out = np.minimum(np.floor(quota + 1e-6).astype(np.int64), cap)
    out[(out == 0) & (quota > 0)] = 1
    spare = int(round(quota.sum())) - int(out.sum())
    able = np.flatnonzero((out < cap) & (out < quota - 1e-6))
    out[able[np.argsort(out[able] - quota[able], kind="stable")[:max(spare, 0)]]] += 1
    return out


def shard_counts(total: np.ndarray, shards: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The slots of each source in the given shards. A range of shards is halved by a draw seeded by the range, so all tasks agree;
    sums by source are the totals, and every shard but the last is full."""
    wanted, n_shards = set(shards), -(-int(total.sum()) // SHARD_SLOTS)
    todo = [(0, n_shards, total)]
    while todo:
        low, high, n = todo.pop()
        if not any(low <= s < high for s in wanted):
            continue
        if high - low == 1:
            yield low, n
            continue
        half = (low + high) // 2
        left = dealt(np.random.default_rng([SEED, low, high]), n, (half - low) * SHARD_SLOTS)
        todo += [(half, high, n - left), (low, half, left)]


def dealt(rng: np.random.Generator, n: np.ndarray, most: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``most`` slots out of n, source by source; beyond the generator's
    range by the normal that has the same mean and variance."""
    out, rest = np.zeros_like(n), int(n.sum())
    for i in np.flatnonzero(n).tolist():
        rest -= int(n[i])
        out[i] = drawn_of(rng, int(n[i]), rest, most)
        most -= int(out[i])
        if not most:
            break
    return out


def drawn_of(rng: np.random.Generator, good: int, bad: int, most: int) -> int:
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, most))
    share = good * most / (good + bad)
    spread = math.sqrt(max(0.0, share * bad * (good + bad - most)) / (good + bad) / (good + bad))
    return min(good, most, max(0, most - bad, int(round(rng.normal(share, spread)))))


def draws(sources: DataFrame) -> DataFrame:
    """si, block, epoch of every slot of the mix. It grows with the input although it starts from a short range, from which
    the optimiser would guess it small; joins with it must ask for a merge join."""
    spark = sources.sparkSession
    table = [r.asDict() for r in sources.orderBy("si").collect()]       # one row per source, bounded by MAX_SOURCES
    blocks = [int(r["n_blocks"]) for r in table]
    total = totals([r["quota"] for r in table], blocks)
    slots = int(total.sum())
    if not slots:
        return spark.createDataFrame([], "si int, block long, epoch int")
    n_shards = -(-slots // SHARD_SLOTS)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, n in shard_counts(total, batch["id"].tolist()):
                si = np.flatnonzero(n)
                yield pd.DataFrame({"si": si.astype(np.int32), "shard": shard, "n": n[si]})

    drawn = spark.range(n_shards, numPartitions=max(min(n_shards, 200), -(-n_shards // 1024))).mapInPandas(counts, "si int, shard long, n long")
    first = F.sum("n").over(Window.partitionBy("si").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    numbered = drawn.withColumn("first", F.coalesce(first, F.lit(0)))

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for si, start, n in zip(batch["si"].tolist(), batch["first"].tolist(), batch["n"].tolist()):
                slot = np.arange(start, start + n, dtype=np.int64)
                epochs = slot // blocks[si]
                for e in np.unique(epochs):
                    index = slot[epochs == e] % blocks[si]
                    yield pd.DataFrame({"si": np.int32(si), "block": permuted(index, blocks[si], SEED + si * MAX_REPEATS + int(e)), "epoch": np.int32(e)})

    # the rows are few and small, but the slots they stand for are not: their number decides how many tasks share them
    return numbered.repartition(-(-n_shards // SHARDS_PER_TASK), "si", "shard").mapInPandas(mapped, "si int, block long, epoch int")


def pieces(rows: DataFrame) -> DataFrame:
    """The parts of documents by block: si, at, block and how many of the document's words lie in it, from which word on."""
    end = F.col("at") + F.col("size")
    cut = rows.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.expr(f"at div {BLOCK_WORDS}"), F.expr(f"(at + size - 1) div {BLOCK_WORDS}"))))
    low = F.greatest(F.col("at"), F.col("block") * BLOCK_WORDS)
    high = F.least(end, (F.col("block") + 1) * BLOCK_WORDS)
    return cut.withColumns({"from": low - F.col("at"), "words": high - low})


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sized = materialise(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.regexp_count(
        F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size")), "mix")
    sources = source_table(sized)
    rows = placed(sized, sized, sources)
    keys = ["si", "at", "doc_id", "size", "source_size", "target"]
    times = draws(sources).groupBy("si", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces(rows.select(*keys)).join(times.hint("merge"), ["si", "block"], "left").groupBy(*keys).agg(
        F.sum(F.coalesce("times", F.lit(0)) * F.col("words")).alias("taken"))
    empty = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*columns).union(empty.select(*columns))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: a row per document and epoch with the words taken, in their order; columns as they came.

    A document taken whole keeps its text as it is; of others the drawn runs of words stay, joined by a line break.
    """
    names = docs.columns
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(
        F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"), F.struct(*names).alias("row"))
    sized = materialise(row.drop("row"), "mix")
    sources = source_table(sized)
    rows = materialise(placed(row, sized, sources), "mix")
    drawn = pieces(rows.select("si", "at", "size")).join(draws(sources).hint("merge"), ["si", "block"]).groupBy("si", "at", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("from", "words"))).alias("parts"), F.sum("words").alias("n"))
    joined = rows.join(drawn.hint("merge"), ["si", "at"]).where("size > 0")
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(runs(F.col("row.text"), F.col("parts")))
    taken = joined.select(*(F.col(f"row.{c}").alias(c) for c in names if c != "text"), text.alias("text")).select(*names)
    return taken.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else taken


@F.pandas_udf(StringType())
def runs(text: pd.Series, parts: pd.Series) -> pd.Series:
    out = []
    for t, p in zip(text.tolist(), parts.tolist()):
        words = [m.span() for m in re.finditer(WORD_PATTERN, t)]
        joined: list[list[int]] = []
        for part in p:
            if joined and joined[-1][1] == part["from"]:
                joined[-1][1] += part["words"]
            else:
                joined.append([part["from"], part["from"] + part["words"]])
        out.append("\n".join(t[words[a][0]:words[b - 1][1]] for a, b in joined))
    return pd.Series(out, dtype=object)
