"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped by length into bands of a fixed ratio, and a band is cut into blocks of bounded size. The longest
vectors and as many others give every query a first threshold, its k-th best product among them. Queries then visit only bands whose longest vector
could still beat a threshold. Inside a block a query's local cosine threshold picks the pruning: by length where any angle would do, by its
strongest coordinate where the angle must be small. Both are ranges in sorted lists; what is left is verified by exact products.

Blocks are packed, so what travels is a block of vectors in narrow whole numbers; a task holds one block of candidates and a bounded number
of query blocks, and copies of a vector spread over blocks by their ids.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; a repeated
(id, vector) row counts once; rows that share the query's id are its own; vectors of another dimension are no candidates; ties go to
the smaller id; an empty table gives an empty result; other columns are not read. Products beyond a 64-bit integer are held at its limits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.session import materialise

BLOCK_ROWS = 2048                # candidates in a block, queries in a block
TOGETHER = 32                    # query blocks that meet a candidate block in one task
BAND_RATIO = 1.1                 # lengths in a band differ at most by this factor
SEED_ROWS = 4096                 # vectors that give the first thresholds, half of them the longest, half by hash
COSINE_FOR_COORDINATES = 0.6     # from this local cosine threshold on, coordinates prune better than length
EXACT = float(2 ** 53)
LONG = 2 ** 63 - 1
PAIR_SCHEMA = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def prepared(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """id, q (integers), dim, length and band of each vector that takes part."""
    rows = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector), scale).alias("q")).distinct()
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = rows.select("vec_id", "q", F.size("q").alias("dim"), F.sqrt(square).alias("length"))
    return rows.withColumn("band", F.when(F.col("length") > 0, F.floor(
        F.log(F.col("length")) / F.lit(float(np.log(BAND_RATIO))))).otherwise(-1).cast("int"))


def products(queries: np.ndarray, cands: np.ndarray) -> np.ndarray:
    """Exact integer products; in float arithmetic where every partial sum stays exact."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * queries.shape[1]
    if bound < EXACT:
        return (queries.astype(np.float64) @ cands.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ cands.astype(object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def coordinate_range(u: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between which values a unit vector's coordinate must lie to reach this cosine with one whose coordinate is u."""
    spread = np.sqrt(np.maximum(0.0, (1 - cosine * cosine) * (1 - u * u))) + 1e-6
    low, high = u * cosine - spread, u * cosine + spread
    return np.where((low > -1) & ~(u < -cosine), low, -1.0), np.where(u > cosine, 1.0, high)


def reached(q: np.ndarray, q_len: np.ndarray, theta: np.ndarray, c: np.ndarray, c_len: np.ndarray, k: int | None = None,
            q_ids: np.ndarray | None = None, c_ids: np.ndarray | None = None):
    """Rows, columns and products of all pairs that reach their query's theta. The local cosine threshold of each query chooses
    between candidates by length, a prefix of those sorted by it, and candidates by a coordinate, a range of those sorted by it; both are found by
    binary search, and queries that share a list share one product. Never misses a pair. With k and ids, own rows are left out, and so
    is what falls below a query's k-th best product in its list."""
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(theta > 0, theta * (1 - 1e-9) / q_len, -np.inf)      # least length that could do; infinite where none does
    cosine = need / max(float(c_len.max()), 1e-300)
    alive, by_angle = cosine <= 1, cosine >= COSINE_FOR_COORDINATES
    lists = []
    by_length = np.flatnonzero(alive & ~by_angle)
    if len(by_length):
        order = np.argsort(c_len, kind="stable")
        lists.append((by_length, order[np.searchsorted(c_len[order], need[by_length].min()):]))
    by_angle = np.flatnonzero(alive & by_angle)
    if len(by_angle):
        q_unit, c_unit = q[by_angle] / q_len[by_angle, None], c / np.maximum(c_len, 1e-300)[:, None]
        focus = np.argmax(np.abs(q_unit), axis=1)
        for f in np.unique(focus):
            mine = np.flatnonzero(focus == f)
            low, high = coordinate_range(q_unit[mine, f], cosine[by_angle[mine]])
            order = np.argsort(c_unit[:, f], kind="stable")
            first = np.searchsorted(c_unit[order, f], low.min())
            lists.append((by_angle[mine], order[first:np.searchsorted(c_unit[order, f], high.max(), side="right")]))
    for rows, cols in lists:
        score = products(q[rows], c[cols])
        wanted = score >= theta[rows, None]
        if k is not None:
            own = q_ids[rows, None] == c_ids[cols]
            wanted &= ~own
            if score.shape[1] > k:
                wanted &= score >= np.partition(np.where(own, -LONG - 1, score), -k, axis=1)[:, -k, None]
        at, col = np.nonzero(wanted)
        yield rows[at], cols[col], score[at, col]


def best_of_block(queries: Block, cands: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query id, candidate id and product of the k best candidates in one block of every query that may profit from it."""
    found = [x for x in reached(queries.vectors, queries.lengths, queries.thetas, cands.vectors, cands.lengths, k, queries.ids, cands.ids)]
    if not found:
        return (np.empty(0, np.int64),) * 3
    row, col, score = (np.concatenate(x) for x in zip(*found))
    ids = cands.ids[col]
    order = np.lexsort((ids, ~score, row))                       # ~x falls as x rises, without overflow
    row, ids, score = row[order], ids[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return queries.ids[row[best]], ids[best], score[best]


# --- blocks ------------------------------------------------------------------

@dataclass(frozen=True)
class Block:
    ids: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    thetas: np.ndarray

    @staticmethod
    def of(row) -> Block:
        ids = np.frombuffer(row["ids"], np.int64)
        return Block(ids, np.frombuffer(row["data"], row["kind"]).reshape(len(ids), -1).astype(np.int64), np.frombuffer(row["lengths"]), np.frombuffer(row["thetas"]))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per block: its vectors in the narrowest whole numbers that hold them."""
    types = ", ".join(f"{c} int" for c in keys)

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack(group["q"].to_numpy()).astype(np.int64)
        kind = next(t for t in ("i1", "i2", "i4", "i8") if np.iinfo(t).min <= vectors.min() and vectors.max() <= np.iinfo(t).max)
        thetas, lengths = group["theta"].to_numpy(float), group["length"].to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(thetas > 0, thetas / lengths, 0.0)
        return pd.DataFrame([(*map(int, key), group["id"].to_numpy(np.int64).tobytes(), kind, vectors.astype(kind).tobytes(), lengths.tobytes(),
                              thetas.tobytes(), float(reach.min()), float(lengths.max()))],
                            columns=[*keys, "ids", "kind", "data", "lengths", "thetas", "reach", "longest"])
    return rows.groupBy(*keys).applyInPandas(
        pack, f"{types}, ids binary, kind string, data binary, lengths binary, thetas binary, reach double, longest double")


def meet(queries: DataFrame, cands: DataFrame, k: int) -> DataFrame:
    """The best candidates in each block for the queries whose threshold the block can reach. A task holds one block of candidates and at most
    ``TOGETHER`` blocks of queries, so a candidate block is sent once for so many query blocks."""
    queries = queries.withColumn("qs", F.expr(f"qb div {TOGETHER}").cast("int"))
    bands = F.broadcast(cands.groupBy("dim", "band").agg(F.max("longest").alias("_most"), (F.max("cb") + 1).alias("_blocks")))   # a row per ratio step

    def visits(blocks: DataFrame) -> DataFrame:
        seen = blocks.join(bands, "dim").where(F.col("reach") * (1 - 1e-9) <= F.col("_most")).drop("_most", "reach")
        return seen.withColumn("cb", F.explode(F.sequence(F.lit(0), (F.col("_blocks") - 1).cast("int")))).drop("_blocks")
    wanted = visits(queries.groupBy("dim", "qs").agg(F.min("reach").alias("reach")))
    sent = cands.select("dim", "band", "cb", "ids", "kind", "data", "lengths", "thetas").join(wanted, ["dim", "band", "cb"])
    sent = sent.select(*(F.col(c).alias(f"c_{c}") for c in sent.columns))
    asked = visits(queries.select("dim", "qs", "ids", "kind", "data", "lengths", "thetas", "reach"))

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.rename(columns=lambda name: name.removeprefix("c_"))
        found = [best_of_block(Block.of(a), Block.of(b), k) for b in c.to_dict("records") for a in q.to_dict("records")]
        found = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))
    keys = ["dim", "band", "cb", "qs"]
    return asked.groupBy(*keys).cogroup(sent.groupBy(*(f"c_{c}" for c in keys))).applyInPandas(kernel, PAIR_SCHEMA)


def top_k(vectors: DataFrame, k: int = 20, query_if: Column | None = None, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row that ``query_if`` picks (of all rows by default)."""
    rows = materialise(prepared(vectors, vec_id, vector, scale), "topk")
    picked = rows if query_if is None else rows.where(query_if)
    line = lambda df, *more: df.select(F.col("vec_id").alias("id"), "q", "dim", "length", *more)
    blank = F.lit(float("-inf")).alias("theta")

    # First thresholds from some of the vectors: a bounded table by its limits.
    seeds = rows.orderBy(F.desc("length"), "vec_id").limit(SEED_ROWS // 2).union(
        rows.orderBy(F.xxhash64("vec_id", "q"), "vec_id").limit(SEED_ROWS // 2)).select("vec_id", "q", "dim", "length").distinct()
    seeds = packed(line(seeds, F.lit(0).alias("band"), F.pmod(F.xxhash64("vec_id", "q"), F.lit(max(1, SEED_ROWS // BLOCK_ROWS))).cast("int").alias("cb"),
                        blank), ["dim", "band", "cb"])
    n_blocks = max(1, -(-picked.count() // BLOCK_ROWS))
    queries = line(picked, F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("qb"))
    first = meet(packed(queries.withColumn("theta", F.lit(float("-inf"))), ["dim", "qb"]), seeds, k)
    kth = F.sort_array(F.collect_list("score"), asc=False)                          # at most k for each of the seeds' few blocks
    least = first.groupBy(F.col("query_id").alias("_id")).agg(F.get(kth, F.lit(k - 1)).cast("double").alias("least"))
    queries = queries.join(least, F.col("id") == F.col("_id"), "left").withColumn("theta", F.coalesce("least", F.lit(float("-inf")))).drop("_id", "least")
    queries = materialise(packed(queries, ["dim", "qb"]), "topk")

    sizes = F.broadcast(rows.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks")))      # a row per ratio step
    placed = line(rows.join(sizes, ["dim", "band"]), "band", F.pmod(F.xxhash64("vec_id", "q"), "blocks").cast("int").alias("cb"), blank)
    pairs = meet(queries, materialise(packed(placed, ["dim", "band", "cb"]), "topk"), k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
