"""Synthetic minority rows: SMOTE, ADASYN, Borderline-SMOTE.

All three share one generator: a base point carries its few neighbour vectors
and emits its own draws, so the synthetic rows are never shuffled or joined.
Draws leave in blocks that are spread over the cluster first, because a tiny
class may have to emit millions of rows from a handful of points.

Points are (id long, cls, vec array<double>); only synthetic rows come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.columns import as_vector
from netloom.operators.blocks import n_tasks
from netloom.operators.encode import MACRO_COL, SPECIFIC_COL
from netloom.operators.knn import foreign_neighbours, matrix, nearest
from netloom.operators.ranking import hashed_rank
from netloom.operators.small import bounded_rows, small_side
from netloom.session import materialise

DRAWS_PER_BLOCK = 10_000
ROWS_PER_TASK = 1_000_000       # synthetic rows a task emits at most, on average
BATCH_NUMBERS = 500_000         # numbers of the vectors that leave a task together


def to_points(df: DataFrame, id_col, cls: str, features) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(cls).alias("cls"),
                     as_vector(features).alias("vec"))


def class_sizes(points: DataFrame) -> dict:
    return {r["cls"]: r["n"] for r in
            bounded_rows(points.groupBy("cls").agg(F.count(F.lit(1)).alias("n")))}


def fitting_k(smallest: int, k: int) -> int:
    """Fewer neighbours when the smallest class has no more than k rows."""
    return max(1, smallest - 1) if smallest <= k else k


def class_deficits(sizes: dict, strategy="auto") -> dict:
    """Rows each class is short of, by strategy name or explicit class targets."""
    if isinstance(strategy, dict):
        return {c: t - sizes[c] for c, t in strategy.items() if t > sizes.get(c, t)}
    top, low = max(sizes.values()), min(sizes.values())
    short = {c: top - n for c, n in sizes.items() if n < top}
    if strategy == "minority":
        return {c: d for c, d in short.items() if sizes[c] == low}
    if strategy == "not minority":
        return {c: d for c, d in short.items() if sizes[c] != low}
    if strategy in ("auto", "not majority", "all"):
        return short
    raise ValueError(f"unknown strategy {strategy!r}")


def raisable(sizes: dict, on_failure: str = "skip") -> dict:
    """Classes synthesis can work with. A class with a single row has no neighbour of its own: it is skipped, or with
    ``on_failure="unchanged"`` it stops synthesis for all classes, as the original call did."""
    if on_failure not in ("skip", "unchanged"):
        raise ValueError(f"unknown on_failure {on_failure!r}")
    if on_failure == "unchanged" and sizes and min(sizes.values()) < 2:
        return {}
    return {c: n for c, n in sizes.items() if n >= 2}


def plan_of(points: DataFrame, strategy="auto", on_failure: str = "skip") -> tuple[dict, dict, int]:
    """Class sizes, deficits of the classes to raise, and the size of the smallest class that has neighbours."""
    sizes = class_sizes(points)
    able = raisable(sizes, on_failure)
    short = {c: d for c, d in class_deficits(sizes, strategy).items() if c in able} if able else {}
    return sizes, short, min(able.values(), default=0)


def skipped_classes(points: DataFrame, strategy="auto") -> list:
    """Classes short of rows that synthesis cannot raise because they hold a single row."""
    sizes = class_sizes(points)
    return sorted((c for c in class_deficits(sizes, strategy) if sizes[c] < 2), key=str)


def _deficit_frame(points: DataFrame, sizes: dict, short: dict) -> DataFrame:
    schema = T.StructType([points.schema["cls"], T.StructField("n_class", T.LongType()),
                           T.StructField("deficit", T.LongType())])
    rows = [(c, sizes[c], d) for c, d in short.items()]
    return F.broadcast(points.sparkSession.createDataFrame(rows, schema))   # one row per class


def none_of(points: DataFrame) -> DataFrame:
    schema = T.StructType([
        points.schema["cls"], T.StructField("base_id", T.LongType()), T.StructField("nn_id", T.LongType()),
        T.StructField("draw", T.LongType()), T.StructField("u", T.DoubleType()),
        T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("is_synthetic", T.BooleanType())])
    return points.sparkSession.createDataFrame([], schema)


def _with_vectors(with_nn: DataFrame, points: DataFrame, reach) -> DataFrame:
    """Swap neighbour ids for (nn_id, reach, nn_vec); the list stays k long."""
    pairs = with_nn.select("id", F.posexplode("nn").alias("pos", "x")).select(
        "id", "pos", F.col("x.nn_id").alias("nn_id"), reach(F.col("x")).alias("reach"))
    vectors = points.select(F.col("id").alias("nn_id"), F.col("vec").alias("nn_vec"))
    lists = (pairs.join(vectors, "nn_id").groupBy("id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "nn_id", "reach", "nn_vec"))).alias("near")))
    return with_nn.drop("nn").join(lists, "id")


def _near(own: DataFrame | None, bases: DataFrame, seeds: DataFrame, k: int, knn_options: dict) -> DataFrame:
    """bases with ``near``, the k nearest of ``seeds`` of their class and their vectors; bases without any are left out."""
    if own is None:
        return _with_vectors(nearest(bases, seeds, k, within="cls", **knn_options).withColumn("nn", F.slice("nn", 1, k)), seeds, lambda x: F.lit(1.0))
    return own.withColumn("near", F.slice("nn", 1, k)).drop("nn").filter(F.size("near") > 0)


def own_neighbours(points: DataFrame, k: int = 5, strategy="auto", on_failure: str = "skip", **knn_options) -> DataFrame:
    """The k nearest of its own class for each point of a class that is short of rows."""
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    seeds = points.join(_deficit_frame(points, sizes, short).select("cls"), "cls", "left_semi")
    return nearest(seeds, seeds, fitting_k(smallest, k), within="cls", **knn_options)


def all_neighbours(points: DataFrame, k: int = 10, strategy="auto", on_failure: str = "skip", **knn_options) -> DataFrame:
    """The k nearest of any class for each point of a class that is short of rows, with n_class and deficit of its class."""
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    bases = points.join(_deficit_frame(points, sizes, short), "cls")
    return nearest(bases, points, fitting_k(smallest, k), **knn_options)


def _picks(ids: list, draws: np.ndarray, seed: int) -> np.ndarray:
    """Two 32-bit numbers per draw: the first sixteen hex digits of the md5 of "id:draw:seed". As in SQL, a null id leaves its place out."""
    tail = b":%d" % seed
    names = [b"" if i is None else b"%d:" % i for i in ids]
    raw = b"".join([md5(name + b"%d" % d + tail, usedforsecurity=False).digest() for name, d in zip(names, draws.tolist())])
    return np.frombuffer(raw, ">u4").reshape(-1, 4)[:, :2].astype(np.int64)


def _emit(bases: DataFrame, seed: int, n_rows: int) -> DataFrame:
    """n_draws synthetic rows per base point, about ``n_rows`` in all: base + u * (neighbour - base).

    The tasks are counted by the rows to emit: the blocks are few and small, and would be put together into a single task.
    """
    last = F.floor((F.col("n_draws") - 1) / DRAWS_PER_BLOCK)
    blocks = (bases.filter("n_draws > 0")
              .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
              .repartition(n_tasks(bases, n_rows, most=ROWS_PER_TASK), "id", "_b"))
    start, per_block = F.col("_b") * DRAWS_PER_BLOCK, DRAWS_PER_BLOCK
    has_reach = "reach" in bases.schema["near"].dataType.elementType.names
    part = lambda name: F.transform("near", lambda x: x[name]).alias(f"_{name}")
    sent = blocks.select("cls", "id", "vec", start.cast("long").alias("_start"),
                         F.least(F.lit(per_block).cast("long"), F.col("n_draws") - start).cast("long").alias("_n"),
                         part("nn_id"), part("nn_vec"), *[part("reach")] * has_reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec, counts, starts = matrix(batch.column("vec")), batch.column("_n").to_numpy(), batch.column("_start").to_numpy()
            ids, near = batch.column("id").to_pylist(), batch.column("_nn_id")
            size = near.value_lengths().to_numpy()
            first = np.cumsum(size) - size
            others, other_ids = matrix(batch.column("_nn_vec").flatten()), near.flatten()
            reach = batch.column("_reach").flatten().to_numpy() if has_reach else None
            most = max(1, BATCH_NUMBERS // vec.shape[1])
            ends = np.cumsum(counts)
            for low in range(0, int(ends[-1]), most):             # draws low to high of the batch, numbered over all its bases
                number = np.arange(low, min(low + most, int(ends[-1])))
                base = np.searchsorted(ends, number, side="right")
                draw = number - (ends[base] - counts[base]) + starts[base]
                picks = _picks([ids[i] for i in base.tolist()], draw, seed)
                at = first[base] + picks[:, 1] % size[base]
                u = picks[:, 0] / 4294967296.0
                if has_reach:
                    u = u * reach[at]
                made = vec[base] + u[:, None] * (others[at] - vec[base])
                ends_of = np.arange(len(number) + 1, dtype=np.int32) * vec.shape[1]
                taken = pa.array(base)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("cls").take(taken), batch.column("id").take(taken), other_ids.take(pa.array(at)), pa.array(draw, pa.int64()),
                     pa.array(u), pa.ListArray.from_arrays(pa.array(ends_of), pa.array(made.ravel())), pa.array(np.ones(len(number), bool))],
                    names=["cls", "base_id", "nn_id", "draw", "u", "vec", "is_synthetic"])

    return sent.mapInArrow(run, none_of(bases).schema)


def _even_draws(ranked: DataFrame) -> DataFrame:
    """Share a class's deficit evenly; the first ranks take the remainder."""
    left = F.col("deficit") - (F.col("rank") - 1)
    share = F.ceil(left / F.col("n_seed"))
    return ranked.withColumn("n_draws", F.greatest(share, F.lit(0)).cast("long"))


def smote(points: DataFrame, k: int = 5, strategy="auto", seed: int = 42, on_failure: str = "skip", own: DataFrame | None = None,
          **knn_options) -> DataFrame:
    """Raise every class to the largest by interpolating between same-class neighbours; see ``raisable`` for single rows.

    Here and below ``own`` and ``around`` are results of ``own_neighbours`` (with ``vectors``) and ``all_neighbours`` over the same points,
    written if several methods need them; without them each method searches for itself.
    """
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    if not short:
        return none_of(points)
    k = fitting_k(smallest, k)
    bases = points.select("id", "cls").join(_deficit_frame(points, sizes, short), "cls")
    seeds = points.join(_deficit_frame(points, sizes, short).select("cls"), "cls", "left_semi")
    ranked = hashed_rank(bases, "cls", ["id"], max(sizes[c] for c in short), seed)
    near = _near(own, seeds, seeds, k, knn_options)
    drawn = _even_draws(ranked.withColumn("n_seed", F.col("n_class"))).select("id", "n_draws")
    return _emit(near.join(drawn, "id"), seed, sum(short.values()))


def adasyn_counts(points: DataFrame, k: int = 5, strategy="auto", on_failure: str = "skip",
                  around: DataFrame | None = None, **knn_options) -> DataFrame:
    """id, cls, n_foreign, n_draws: deficits shared by how foreign a neighbourhood is.

    The neighbour search is written once; the totals and the counts both read it.
    """
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    k = fitting_k(smallest, k)
    bases = points.join(_deficit_frame(points, sizes, short), "cls")
    found = around if around is not None else nearest(bases, points, k, **knn_options)
    hard = materialise(foreign_neighbours(found.withColumn("nn", F.slice("nn", 1, k))).drop("nn", "vec"), "hardness")
    totals = small_side(hard.groupBy("cls").agg(F.sum("n_foreign").alias("_t")))
    # the neighbour count cancels out of r_i / sum(r); whole numbers keep the rounding stable
    share = F.rint(F.col("n_foreign") * F.col("deficit") / F.col("_t"))
    return hard.join(totals, "cls").select(
        "id", "cls", "n_foreign",
        F.when(F.col("_t") > 0, share).otherwise(0.0).cast("long").alias("n_draws"))


def adasyn(points: DataFrame, k: int = 5, strategy="auto", seed: int = 42, on_failure: str = "skip", own: DataFrame | None = None,
           around: DataFrame | None = None, **knn_options) -> DataFrame:
    """More synthetic rows where a class is surrounded by others.

    A class without any foreign neighbour gets no rows; with ``on_failure="unchanged"`` it stops synthesis for all
    classes, as the original call did.
    """
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    if not short:
        return none_of(points)
    counts = materialise(adasyn_counts(points, k, strategy, on_failure, around, **knn_options), "adasyn-counts")
    if on_failure == "unchanged":
        spread = bounded_rows(counts.groupBy("cls").agg(F.sum("n_foreign").alias("t")))
        if any(r["t"] == 0 for r in spread):
            return none_of(points)
    seeds = points.join(_deficit_frame(points, sizes, short).select("cls"), "cls", "left_semi")
    k = fitting_k(smallest, k)
    near = _near(own, seeds, seeds, k, knn_options)
    return _emit(near.join(counts.select("id", "n_draws"), "id"), seed, sum(short.values()))


def border_status(points: DataFrame, m: int = 10, strategy="auto", on_failure: str = "skip",
                  around: DataFrame | None = None, **knn_options) -> DataFrame:
    """noise (all m neighbours foreign), danger (half or more), else safe."""
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    m = fitting_k(smallest, m)
    bases = points.join(_deficit_frame(points, sizes, short), "cls")
    found = around if around is not None else nearest(bases, points, m, **knn_options)
    foreign = foreign_neighbours(found.withColumn("nn", F.slice("nn", 1, m)))
    status = (F.when(F.col("n_foreign") == m, "noise")
              .when(F.col("n_foreign") * 2 >= m, "danger").otherwise("safe"))
    return foreign.withColumn("status", status)


def borderline_smote(points: DataFrame, k: int = 5, m: int = 10, kind: str = "borderline-1",
                     strategy="auto", seed: int = 42, on_failure: str = "skip", own: DataFrame | None = None,
                     around: DataFrame | None = None, **knn_options) -> DataFrame:
    """SMOTE seeded only by danger points; a class without any gets no rows.

    ``borderline-2`` also interpolates towards foreign neighbours, at most half way.
    """
    if kind not in ("borderline-1", "borderline-2"):
        raise ValueError(f"unknown kind {kind!r}")
    sizes, short, smallest = plan_of(points, strategy, on_failure)
    if not short:
        return none_of(points)
    status = border_status(points, m, strategy, on_failure, around, **knn_options)
    danger = materialise(status.filter(F.col("status") == "danger").drop("n_class", "deficit", "status"), "danger")
    seeded = small_side(danger.groupBy("cls").agg(F.count(F.lit(1)).alias("n_seed")))
    bases = danger.select("id", "cls").join(seeded, "cls").join(_deficit_frame(points, sizes, short), "cls")
    ranked = hashed_rank(bases, "cls", ["id"], max(sizes[c] for c in short), seed)
    drawn = _even_draws(ranked).select("id", "n_draws")
    k = fitting_k(smallest, k)
    seeds = points.join(_deficit_frame(points, sizes, short).select("cls"), "cls", "left_semi")
    bases = danger.select("id", "cls", "vec")
    own = own.join(bases.select("id"), "id", "left_semi") if own is not None else None
    if kind == "borderline-1":
        near = _near(own, bases, seeds, k, knn_options)
    else:
        found = own if own is not None else nearest(bases, seeds, k, within="cls", **knn_options)
        found = found.withColumn("nn", F.slice("nn", 1, k))
        others = danger.select("id", F.filter("nn", lambda x: x["nn_cls"] != F.col("cls")).alias("_far"))
        both = found.join(others, "id")
        tagged = F.concat(F.transform("nn", lambda x: F.struct(x["nn_id"].alias("nn_id"), F.lit(1.0).alias("reach"))),
                          F.transform("_far", lambda x: F.struct(x["nn_id"].alias("nn_id"), F.lit(0.5).alias("reach"))))
        near = _with_vectors(both.withColumn("nn", tagged).drop("_far"), points, lambda x: x["reach"])
    return _emit(near.join(drawn, "id"), seed, sum(short.values()))


def as_rows(synthetic: DataFrame, features, cls_col: str = MACRO_COL) -> DataFrame:
    """Back to wide float columns; the specific code repeats the macro code."""
    values = [F.get("vec", F.lit(i)).cast("float").alias(f) for i, f in enumerate(features)]
    out = synthetic.select(*values, F.col("cls").cast("int").alias(cls_col), "is_synthetic")
    return out.withColumn(SPECIFIC_COL, F.col(cls_col))


def merge_synthetic(original: DataFrame, synthetic_rows: DataFrame) -> DataFrame:
    """Original rows first, then the synthetic ones, told apart by ``is_synthetic``."""
    return original.withColumn("is_synthetic", F.lit(False)).unionByName(synthetic_rows)


def assert_sizes(original: DataFrame, synthetic: DataFrame, merged: DataFrame) -> None:
    a, b, c = original.count(), synthetic.count(), merged.count()
    if a + b != c:
        raise ValueError(f"{a} original + {b} synthetic rows, but {c} merged")


def synthetic_only(merged: DataFrame, original: DataFrame) -> DataFrame:
    """What an augmented table has beyond the original, counted with copies."""
    return merged.exceptAll(original)
