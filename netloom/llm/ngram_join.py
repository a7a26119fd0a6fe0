"""Jaccard join of documents on word shingles by a MinHash LSH forest.

1. Each document becomes the set of its five-word shingles (64-bit hashes). Equal sets form a class; from here on only classes
   are compared, so copies cost nothing.
2. A signature of TREES x DEPTH minhashes per class is a path in each of TREES prefix tries. Paths are sorted, and a class first meets those
   that share its whole path. Its matched prefix is then shortened, place by place, until the estimated recall of its links reaches the
   target (``recall_reached``): at once where many close partners are found, at the shortest prefix where none is.
   A pair meets while either class still goes on, once, at the longest prefix it shares; sizes too far apart never meet.
3. Subtries at the shortest prefix any class may need are dealt to tasks. One with many classes is cut into blocks by their hashes,
   and every two blocks meet in a task of their own. Signatures that could belong to similar sets are tied by a spanning forest; what is
   tied already is not compared again. Components of these ties hold every pair that any trie proposes, and more.
4. Within a component all sets are compared exactly, block against block. Verified links give link counts and groups.

Pairs are compared inside tasks and leave them only as sums and spanning edges; no group is expanded into pairs of rows.

Defined results: words are runs of non-space characters; a text of fewer than five words is one shingle; null and empty texts,
and rows without an id, are classes of their own without links; repeated rows are copies; ties go to the smaller id; an
empty table gives an empty result; texts are read whole, whatever their length; only doc_id and text are read by ``links``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import fresh
from netloom.session import materialise

SHINGLE, TREES, DEPTH = 5, 16, 8
NUM, DEN = 4, 5                     # similarity NUM / DEN or more is a link
TARGET_RECALL = 0.9995
MAYBE = 0.6                         # share of equal minhashes from which a pair is worth an exact look; 0.8 less over five deviations
NODE_CLASSES, BLOCK = 1024, 256     # classes in a block of a subtrie, and of a component
NEAR = 128                          # neighbours on either side of a sorted path that a class's recall is estimated from
BATCH_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64


def prefix_depth(recall: float = TARGET_RECALL, similarity: float = NUM / DEN) -> int:
    """The longest prefix whose matches find a pair of this similarity often enough over all trees."""
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity ** depth) ** TREES < recall:
        depth -= 1
    return depth


def weakest_link(n: int) -> float:
    """The least similarity at the threshold or above that a set of n shingles can have to a different set; 0 if there is none."""
    found = []
    for m in range(-(-NUM * n // DEN), DEN * n // NUM + 1):
        both = -(-NUM * (n + m) // (NUM + DEN))
        if both <= min(n, m) and not both == n == m:
            found.append(both / (n + m - both))
    return min(found, default=0.0)


WEAKEST = np.array([weakest_link(n) for n in range(64)] + [NUM / DEN])      # larger sets come as close to the threshold as can be
LONELY = int(np.flatnonzero(WEAKEST)[0])                                    # smaller sets have no link to any other set


# --- shingles and signatures --------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SEEDS = mixed(np.arange(1, 2 * TREES * DEPTH + SHINGLE + 2, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
XOR, TIMES, STEPS = _SEEDS[:TREES * DEPTH], _SEEDS[TREES * DEPTH:2 * TREES * DEPTH], _SEEDS[2 * TREES * DEPTH:]
BASE = U(0x100000001B3)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; empty for a text without words."""
    if not texts:
        return []
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    inside = ~SPACE[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return [np.empty(0, U) for _ in texts]
    lengths = np.flatnonzero(inside & ~np.r_[inside[1:], False]) + 1 - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    powers = np.cumprod(np.r_[U(1), np.full(int(lengths.max()) - 1, BASE, U)])
    words = mixed(np.add.reduceat((raw[inside].astype(U) + U(1)) * powers[place], first) ^ (lengths.astype(U) * STEPS[SHINGLE]))
    total = np.zeros(max(0, len(words) - SHINGLE + 1), U)
    for k in range(SHINGLE if len(total) else 0):
        total += words[k:len(words) - SHINGLE + 1 + k] * STEPS[k]
    shingles = mixed(total)
    ends = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in data]))
    out, begin = [], 0
    for end in ends:
        if end - begin >= SHINGLE:
            out.append(np.unique(shingles[begin:end - SHINGLE + 1]))
        elif end > begin:
            out.append(mixed((words[begin:end] * STEPS[:end - begin]).sum(keepdims=True)))
        else:
            out.append(np.empty(0, U))
        begin = end
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(TREES * DEPTH, np.iinfo(U).max, U)
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, ((shingles[at:at + 2048, None] ^ XOR) * TIMES).min(axis=0))
    return (mixed(least) >> U(48)).astype(np.uint16)


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _parts(frame: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """A batch in parts of bounded text size."""
    size = frame[column].str.len().fillna(0).cumsum().to_numpy()
    for _, part in frame.groupby((size // BATCH_BYTES).astype(np.int64), sort=True):
        yield part


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, cls, n (shingles) and sig of every document; cls is null where there is nothing to compare."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, "text"):
                sets = shingle_sets([t or "" for t in part["text"].tolist()])
                known = part["doc_id"].notna().tolist()
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                    "cls": [class_of(s) if len(s) and k else None for s, k in zip(sets, known)], "n": [len(s) for s in sets],
                    "sig": [signature(s).tobytes() if len(s) and k else None for s, k in zip(sets, known)]})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, "doc_id long, cls binary, n long, sig binary")


# --- candidates ----------------------------------------------------------------

def forest_nodes(classes: DataFrame) -> DataFrame:
    """tree, prefix, block, blocks, cls, n, sig of the classes that share a subtrie, rooted at the shortest prefix the recall may ask for.
    ``classes`` has cls, sig and, if sizes are known, n."""
    classes = classes.select("cls", "sig", F.col("n") if "n" in classes.columns else F.lit(len(WEAKEST)).cast("long").alias("n"))
    classes = classes.where(F.col("n") >= LONELY)
    start = F.col("tree") * (2 * DEPTH) + 1
    paths = classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select(
        "cls", "tree", F.substring("sig", start, F.lit(2 * prefix_depth())).alias("prefix"))
    # counted by sums of parts and joined back by merge, which adaptive execution splits: no task holds a whole node
    sizes = paths.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("here")).where("here > 1")
    level = paths.join(sizes.hint("merge"), ["tree", "prefix"])
    blocks = F.ceil(F.col("here") / NODE_CLASSES).cast("int")
    cut = level.select("cls", "tree", "prefix", blocks.alias("blocks"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"))
    return cut.join(classes, "cls").select("tree", "prefix", "block", "blocks", "cls", "n", "sig")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    forest = Forest(n)
    return [(a, b) for a, b in pairs.tolist() if forest.tie(a, b)]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of a sorted partition as frames that hold whole key groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        head, tail = batch.iloc[:cut], batch.iloc[cut:]
        if held and len(head):
            yield pd.concat([*held, head])
            held = [tail]
        elif held and (held[-1][keys].iloc[-1] != tail[keys].iloc[0]).any():
            yield pd.concat(held)
            held = [tail]
        elif len(head):
            yield head
            held = [tail]
        else:
            held.append(tail)
    if held:
        yield pd.concat(held)


def _bounds(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    values = [frame[k].to_numpy() for k in keys]
    new = np.zeros(len(frame), bool)
    new[0] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new).tolist()
    return list(zip(starts, [*starts[1:], len(frame)]))


def agreement(sigs: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """How many minhashes of each signature equal those of one: flags are summed eight at a time, as the bytes of a word."""
    words = (sigs == sig).view(U).sum(axis=1, dtype=U)
    return (words * U(0x0101010101010101)) >> U(56)


def recall_reached(found: np.ndarray, weakest: float, depth: int) -> bool:
    """Whether matches at this depth find enough of a class's links, by the similarities of the partners that one tree has found.

    A partner of similarity s shares the prefix in one tree with probability s ** depth, so it stands for 1 / s ** depth partners, of which
    all trees together miss (1 - s ** depth) ** TREES. One partner more, as weak as a link can be, is always supposed."""
    seen = found ** depth
    missed = (1 - weakest ** depth) ** TREES + ((1 - seen) ** TREES / seen).sum()
    return bool(missed <= (1 - TARGET_RECALL) * (1 + (1 / seen).sum()))


def trie_ties(sigs: np.ndarray, sizes: np.ndarray, tree: int, label: np.ndarray, stop: np.ndarray, cut: int = 0) -> list[tuple[int, int]]:
    """A spanning forest of the positions whose signatures agree often enough, met while the prefixes of one trie are shortened.

    Positions with equal labels are tied already. ``stop`` holds the depth at which a class has reached its recall, 0 before. Both are brought
    up to date in place. With a cut, only positions before it meet those from it on, and stops stay as they are."""
    n, least, out = len(sigs), math.ceil(MAYBE * TREES * DEPTH), []
    order = np.lexsort(sigs[:, tree * DEPTH:(tree + 1) * DEPTH].T[::-1])
    sigs, sizes, tied, ended, first = sigs[order], sizes[order], label[order], stop[order], order < cut
    path = sigs[:, tree * DEPTH:(tree + 1) * DEPTH]
    common = np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1)          # places that neighbours share
    weakest = WEAKEST[np.minimum(sizes, len(WEAKEST) - 1)]
    inner = np.arange(1, n + 1)                                             # where the run of a longer prefix ends
    for depth in range(DEPTH, prefix_depth() - 1, -1):
        bounds = np.r_[0, np.flatnonzero(common < depth) + 1, n]
        run = np.searchsorted(bounds, np.arange(n), side="right")
        starts, ends = bounds[run - 1], bounds[run]
        for i in np.flatnonzero(ends > inner).tolist():
            apart = inner[i] + np.flatnonzero(tied[inner[i]:ends[i]] != tied[i])
            if not len(apart):
                continue
            other = sizes[apart]
            meet = (np.minimum(ended[apart], ended[i]) <= depth) & (DEN * other >= NUM * sizes[i]) & (DEN * sizes[i] >= NUM * other)
            apart = apart[meet & (first[apart] != first[i]) if cut else meet]
            for j in apart[agreement(sigs[apart], sigs[i]) >= least].tolist() if len(apart) else ():
                if tied[j] != tied[i]:
                    out.append((int(order[i]), int(order[j])))
                    tied[tied == tied[j]] = tied[i]
        if not cut and depth > prefix_depth():
            alone = (1 - weakest ** depth) ** TREES / (1 - TARGET_RECALL)   # partners' weight that is needed beside the supposed one
            ended[(ended == 0) & (alone <= 1)] = depth
            for i in np.flatnonzero((ended == 0) & (1 + (ends - starts - 1) / (NUM / DEN) ** depth >= alone)).tolist():
                low = max(starts[i], i - NEAR)
                near = low + np.flatnonzero(tied[low:min(ends[i], i + NEAR + 1)] == tied[i])
                alike = agreement(sigs[near[near != i]], sigs[i]) / (TREES * DEPTH)
                if recall_reached(alike[alike >= NUM / DEN], weakest[i], depth):
                    ended[i] = depth
        inner = ends
    if not cut:
        ended[ended == 0] = prefix_depth()
    label[order], stop[order] = tied, ended
    return out


def _signatures(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16).reshape(-1, TREES * DEPTH)


def candidate_ties(nodes: DataFrame) -> DataFrame:
    """a, b: ties between classes that may be similar, a spanning forest per trie node."""
    keys = ["tree", "prefix", "block"]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(batches, keys):
            sigs, cls, blocks = _signatures(b"".join(frame["sig"])), frame["cls"].tolist(), frame["blocks"].tolist()
            tree, sizes = frame["tree"].tolist(), frame["n"].to_numpy(np.int64)
            at, out = [], []
            for low, high in _bounds(frame, keys):
                label, stop = np.arange(high - low, dtype=np.int32), np.zeros(high - low, np.uint8)
                pairs = trie_ties(sigs[low:high], sizes[low:high], tree[low], label, stop) if high - low > 1 or blocks[low] > 1 else []
                if pairs or blocks[low] > 1:
                    all_ = (b"".join(cls[low:high]), *(x.tobytes() for x in (sigs[low:high], sizes[low:high], label, stop)))
                    at.append(low)
                    out.append(([cls[low + j] for _, j in pairs], [cls[low + i] for i, _ in pairs], *(all_ if blocks[low] > 1 else (None,) * 5)))
            if at:
                made = frame.iloc[at][[*keys, "blocks"]].reset_index(drop=True)
                yield made.assign(**{c: list(v) for c, v in zip(("a", "b", *held), zip(*out))})

    def between(frame: pd.DataFrame) -> pd.DataFrame:
        names, pairs = [], []
        if len(frame) == 2:                                     # a block may have stayed empty
            sigs, label = [_signatures(x) for x in frame["sigs"]], [np.frombuffer(x, np.int32) for x in frame["label"]]
            sizes, stop = (np.concatenate([np.frombuffer(x, t) for x in frame[c]]) for c, t in (("sizes", np.int64), ("stop", np.uint8)))
            names = [x[k:k + 16] for x in frame["all"] for k in range(0, len(x), 16)]
            cut = len(sigs[0])
            pairs = trie_ties(np.concatenate(sigs), sizes, int(frame["tree"].iloc[0]), np.concatenate([label[0], label[1] + cut]), stop, cut)
        return pd.DataFrame({"a": [max(names[i], names[j]) for i, j in pairs], "b": [min(names[i], names[j]) for i, j in pairs]}, dtype=object)

    held = ["all", "sigs", "sizes", "label", "stop"]
    spread = nodes.repartition(*keys).sortWithinPartitions(*keys, "cls")
    made = materialise(spread.mapInPandas(inside, "tree int, prefix binary, block int, blocks int, a array<binary>, b array<binary>, "
                                          + ", ".join(f"{c} binary" for c in held)), "forest")
    ties = made.select(F.explode(F.arrays_zip("a", "b")).alias("t")).select("t.a", "t.b")
    met = made.where("blocks > 1").withColumn("its", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("its <> block")
    met = met.select("tree", "prefix", F.least("block", "its").alias("x"), F.greatest("block", "its").alias("y"), *held)
    return ties.union(met.groupBy("tree", "prefix", "x", "y").applyInPandas(between, "a binary, b binary"))


def components(ties: DataFrame) -> DataFrame:
    """node, comp: the smallest node of each component, by alternating large and small stars over ties (a, b), b < a."""
    def mark(df: DataFrame):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    now = materialise(ties.where("a <> b").distinct(), "components")
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("m", "a").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "components")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialise(small.union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "components")
        if (after := mark(now)) == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct().toDF("node", "comp"))


# --- verification ---------------------------------------------------------------

def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share."""
    n = len(sets)
    if n <= 12:
        out = np.zeros((n, n), np.int64)
        for i in range(n):
            for j in range(i + 1, n):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.cumsum(np.r_[False, np.diff(column[order]) > 0]) if len(order) else column
    out = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        grid = np.zeros((n, 4096), np.float32)
        grid[owner[part], column[part] - low] = 1
        out += grid @ grid.T
    return out.astype(np.int64)


def linked(sets: list[np.ndarray], sides: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold; where there are two sides, only pairs across them."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hit = (NUM + DEN) * shared(sets) >= NUM * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(hit, False)
    return hit & (sides[:, None] != sides[None, :]) if sides.any() else hit


def verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """cls, links, other: parts of link counts of a class (other is null), and spanning edges between linked classes (links is 0).

    ``members`` has rep, cls, docs, comp and blocks. A component is cut into blocks by the classes' hashes; every two blocks meet once.
    """
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _parts(batch, "text"):
                made = shingle_sets([t or "" for t in part["text"].tolist()])
                right = [len(s) > 0 and class_of(s) == c for s, c in zip(made, part["cls"])]
                out = part.assign(set=[s.tobytes() for s in made])[right]
                yield out[["comp", "blocks", "cls", "docs", "set"]].drop_duplicates("cls")

    # one way to fetch texts at every size: the member table grows with the input and is never broadcast
    texts = members.hint("merge").join(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), "rep").select(
        "comp", "blocks", "cls", "docs", "text")
    block = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
    spread = texts.mapInPandas(sets, "comp binary, blocks int, cls binary, docs long, set binary").withColumn("mine", block).withColumn(
        "its", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("comp", F.least("mine", "its").alias("x"), F.greatest("mine", "its").alias("y"), "mine", "cls", "docs", "set")
    keys = ["comp", "x", "y"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(batches, keys):
            cls, docs_in, links = frame["cls"].tolist(), frame["docs"].to_numpy(), np.zeros(len(frame), np.int64)
            held = [np.frombuffer(s, U) for s in frame["set"]]
            side = (frame["mine"] != frame["x"]).to_numpy()
            edges = []
            for low, high in _bounds(frame, keys):
                if high - low < 2:
                    continue
                hit = linked(held[low:high], side[low:high])
                links[low:high] = hit @ docs_in[low:high]
                edges += [(cls[low + a], cls[low + b]) for a, b in spanning(np.argwhere(np.triu(hit)), high - low)]
            some = np.flatnonzero(links)
            yield pd.DataFrame({"cls": [cls[i] for i in some] + [max(e) for e in edges], "links": [int(links[i]) for i in some] + [0] * len(edges),
                                "other": [None] * len(some) + [min(e) for e in edges]})
    return spread.repartition(*keys).sortWithinPartitions(*keys, "cls").mapInPandas(rows, "cls binary, links long, other binary")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of the documents with the same shingles), group_id (smallest id linked directly or
    through others) and n_links (documents at the threshold, copies included) of every document."""
    profile = materialise(profiles(docs), "ngram-join")
    classes = materialise(profile.where(F.col("cls").isNotNull()).groupBy("cls", "n", "sig").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs")), "ngram-join")
    comps = components(candidate_ties(forest_nodes(classes)))
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    members = comps.join(sizes, "comp").select(F.col("node").alias("cls"), "comp", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = materialise(members.join(classes.select("cls", "rep", "docs"), "cls"), "ngram-join")
    proof = materialise(verified(docs, members), "ngram-join")
    counts = proof.groupBy("cls").agg(F.sum("links").alias("links"))
    groups = components(proof.where(F.col("other").isNotNull()).select(F.col("cls").alias("a"), F.col("other").alias("b")))
    known = classes.select("cls", "rep", "docs").join(counts, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.withColumn("comp", F.coalesce("comp", "cls"))
    least = known.groupBy("comp").agg(F.min("rep").alias("group_id"))
    known = known.join(least, "comp").select(
        "cls", F.col("rep").alias("class_id"), "group_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"))
    return profile.select("doc_id", "cls").join(known, "cls", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("group_id", "doc_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group: the one with the smallest id stays. Rows that share an id stay or go together,
    but for exact repeats, of which one stays; rows without an id stay."""
    stay = links(docs).where("doc_id = group_id").select("doc_id").distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(stay.hint("merge"), "doc_id", "left_semi")
    text, row = fresh(docs, "_text"), fresh(docs, "_row")
    rest = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias(fresh(docs, "_none")))))
    first = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(rest))
    known = known.withColumn(text, F.xxhash64("text")).withColumn(row, first).where(F.col(row) == 1)
    return known.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()))
