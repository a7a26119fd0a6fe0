"""Shards from fixed virtual slots and a versioned slot map.

A record hashes to one of ``SLOTS`` slots, whatever the number of shards. Bytes are summed per slot, and a map, a table of one row per slot,
says which shard holds it. The map is what changes: a new shard, a shard that goes, or one that has grown too large moves whole slots, and each
edit is stored as a version of its own beside the ones before. Records are never hashed anew.

A slot heavier than an eighth of a shard (one id on a third of all rows, say) is cut into parts by the row's number, so that no single slot
unbalances a shard. The map has at most ``SLOTS`` entries and eight more for each shard, so it is edited on the driver and broadcast.

Defined results: a null text has no bytes and crc32 0, a null id hashes like any other id; repeated rows are placed each; a text longer than a
shard's fair share takes a shard nearly alone; an empty table gives an empty result and a map without entries; other columns are kept by
``assign`` and not read.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import ranked
from netloom.session import materialise, scratch

SLOTS = 8192
PARTS_OF_A_SHARD = 8             # no slot or part of one is planned heavier than this share of a shard
ROW_BYTES = 16
MAP_SCHEMA = "version int, slot int, parts int, part int, bytes long, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards, and per (slot, part) its bytes and its shard. ``parts`` says into how many parts a slot is cut."""

    version: int
    shards: int
    parts: dict[int, int] = field(default_factory=dict)
    sizes: dict[tuple[int, int], int] = field(default_factory=dict)
    shard_of: dict[tuple[int, int], int] = field(default_factory=dict)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for key, shard in self.shard_of.items():
            out[shard] += self.sizes[key]
        return out

    def edited(self, moves: dict[tuple[int, int], int], shards: int | None = None) -> SlotMap:
        return replace(self, version=self.version + 1, shards=shards or self.shards, shard_of={**self.shard_of, **moves})

    def with_sizes(self, sizes: dict[tuple[int, int], int]) -> SlotMap:
        """The same places under newly counted bytes; a slot seen for the first time goes where least lies."""
        known = {k: s for k, s in self.shard_of.items() if k in sizes}
        held = replace(self, version=self.version + 1, sizes=sizes, shard_of=known)
        return replace(held, shard_of={**known, **_lightest_first(sizes, held.loads(), [k for k in sizes if k not in known])})

    def grown(self) -> SlotMap:
        """One more shard, filled to its fair share from the fullest ones; slots move into it only."""
        loads, new = self.loads(), self.shards
        fair = sum(loads) / (new + 1)
        held = self._by_shard()
        moves, took = {}, 0
        heap = [(-n, s) for s, n in enumerate(loads) if n]
        heapq.heapify(heap)
        while heap and took < fair:
            load, shard = heapq.heappop(heap)
            fits = [k for k in held[shard] if took + self.sizes[k] <= fair and -load - self.sizes[k] >= took]
            if not fits:
                continue
            key = fits[0]
            held[shard].remove(key)
            moves[key] = new
            took += self.sizes[key]
            heapq.heappush(heap, (load + self.sizes[key], shard))
        return self.edited(moves, new + 1)

    def drained(self, shard: int) -> SlotMap:
        """The shard is emptied over all others; its number stays, without rows, so that no other row moves."""
        leaving = [k for k, s in self.shard_of.items() if s == shard]
        loads = self.loads()
        loads[shard] = None
        return self.edited(_lightest_first(self.sizes, loads, leaving))

    def rebalanced(self, tolerance: float = 0.01) -> SlotMap:
        """Slots leave shards above ``1 + tolerance`` of the fair share for the emptiest ones, as long as that narrows the gap."""
        loads, held, moves = self.loads(), self._by_shard(), {}
        limit = (1 + tolerance) * sum(loads) / self.shards
        for shard in sorted(range(self.shards), key=loads.__getitem__, reverse=True):
            for key in held[shard]:
                low = min(range(self.shards), key=loads.__getitem__)
                if loads[shard] <= limit:
                    break
                if self.sizes[key] and loads[low] + self.sizes[key] < loads[shard]:
                    loads[shard] -= self.sizes[key]
                    loads[low] += self.sizes[key]
                    moves[key] = low
        return self.edited(moves)

    def _by_shard(self) -> dict[int, list]:
        """The slots of each shard, heaviest first."""
        held = defaultdict(list)
        for key in sorted(self.shard_of, key=lambda k: (-self.sizes[k], k)):
            held[self.shard_of[key]].append(key)
        return held

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, slot, self.parts.get(slot, 1), part, self.sizes[slot, part], shard)
                for (slot, part), shard in sorted(self.shard_of.items())]
        return spark.createDataFrame(rows, MAP_SCHEMA)


def _lightest_first(sizes: dict, loads: list[int | None], keys: list) -> dict:
    """Heaviest key first, each to the shard that holds least; a load of None takes no part."""
    heap = [(n, s) for s, n in enumerate(loads) if n is not None]
    heapq.heapify(heap)
    out = {}
    for key in sorted(keys, key=lambda k: (-sizes[k], k)):
        load, shard = heapq.heappop(heap)
        out[key] = shard
        heapq.heappush(heap, (load + sizes[key], shard))
    return out


def planned(sizes: dict[tuple[int, int], int], parts: dict[int, int], shards: int) -> SlotMap:
    """The first version: the heaviest slot first, each to the shard that holds least."""
    return SlotMap(1, shards, parts, sizes, _lightest_first(sizes, [0] * shards, list(sizes)))


# --- records -----------------------------------------------------------------

def slot_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def part_of(row: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(row), parts).cast("int")


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, crc32 of the text, slot and a row number, written once: all that follows leaves the texts alone."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
                       slot_of(F.col(key)).alias("virtual_slot"), F.monotonically_increasing_id().alias("row"))
    return materialise(rows, "sized")


def parted(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """The rows with the part of their slot; only slots that are cut are named, at most eight for each shard."""
    cut = [(s, n) for s, n in parts.items() if n > 1]
    if not cut:
        return rows.withColumn("part", F.lit(0))
    side = rows.sparkSession.createDataFrame(cut, "_slot int, _parts int")
    return rows.join(F.broadcast(side), F.col("virtual_slot") == F.col("_slot"), "left").withColumn(
        "part", F.coalesce(part_of(F.col("row"), F.col("_parts")), F.lit(0))).drop("_slot", "_parts")


def slot_bytes(rows: DataFrame, shards: int) -> tuple[dict, dict]:
    """(bytes per (slot, part), parts per slot): two aggregates of at most ``SLOTS`` rows and a bounded number of parts."""
    whole = {r[0]: r[1] for r in rows.groupBy("virtual_slot").agg(F.sum("size")).collect()}
    limit = max(1, sum(whole.values()) // (shards * PARTS_OF_A_SHARD))
    parts = {slot: min(-(-n // limit), shards * PARTS_OF_A_SHARD) for slot, n in whole.items() if n > limit}
    sizes = {(slot, 0): n for slot, n in whole.items() if slot not in parts}
    if parts:
        heavy = parted(rows.where(F.col("virtual_slot").isin(list(parts))), parts)
        sizes.update({(r[0], r[1]): r[2] for r in heavy.groupBy("virtual_slot", "part").agg(F.sum("size")).collect()})
    return sizes, parts


def assign(rows: DataFrame, slots: SlotMap) -> DataFrame:
    """Rows of ``sized`` plus part and shard by the map's version."""
    places = slots.frame(rows.sparkSession).select(F.col("slot").alias("_s"), F.col("part").alias("_p"), "shard")
    rows = parted(rows, slots.parts)
    return rows.join(F.broadcast(places), (F.col("virtual_slot") == F.col("_s")) & (F.col("part") == F.col("_p"))).drop("_s", "_p")


def save(slots: SlotMap, spark: SparkSession, folder: str) -> str:
    """Write one version; an existing version is never written again."""
    path = f"{folder.rstrip('/')}/version={slots.version}-{slots.shards}"
    slots.frame(spark).coalesce(1).write.parquet(path)
    return path


def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    """A stored version, by default the latest."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    stored = {int(n.split("=")[1].split("-")[0]): n for n in names if n.startswith("version=")}
    name = stored[max(stored) if version is None else version]
    rows = spark.read.schema(MAP_SCHEMA).parquet(f"{folder.rstrip('/')}/{name}").collect()      # bounded: one row per slot or part
    return SlotMap(int(name.split("=")[1].split("-")[0]), int(name.rsplit("-", 1)[1]), {r["slot"]: r["parts"] for r in rows if r["parts"] > 1},
                   {(r["slot"], r["part"]): r["bytes"] for r in rows}, {(r["slot"], r["part"]): r["shard"] for r in rows})


def report(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its size, shard and place there, by a new map that is stored as version 1 and read again."""
    spark = docs.sparkSession
    rows = sized(docs.select(key, text), key, text)
    sizes, parts = slot_bytes(rows, shards)
    folder = scratch(spark, "slot-map")
    save(planned(sizes, parts, shards), spark, folder)
    slots = load(spark, folder)
    placed = ranked(assign(rows, slots), ["shard"], [F.col("virtual_slot"), F.col("part"), F.col(key), F.col("row")], "slot")
    return placed.select(F.col(key).cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slots.version).alias("map_version"))
