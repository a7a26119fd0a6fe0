"""Phrase collocations counted by direct-address tiles.

1. Tasks cut texts into pieces and words and write chunks of about ``CHUNK_WORDS`` words of one language: its distinct words with counts, and
   the text as numbers into them. Words are counted over chunks, and those frequent enough get ids by frequency rank.
2. The plane of (left id, right id) is cut into tiles. Both axes are banded: the first band holds ``SIDE`` ids, each next one twice as many as
   the one before, so few tiles cover any vocabulary, and frequent words share small tiles. A tile addresses its cells directly (row times width plus column).
   In a chunk, cells of a crowded tile are counted by a dense bincount, those of a sparse one as sorted coordinates with counts (COO).
3. Chunks' tiles are added up tile by tile, again dense or by merging sorted coordinates. Where a tile may hold much, its cells are dealt by
   remainder over parts, as many as a bound on its occurrences asks for (the smaller one of its row band's and its column band's words), so
   no task holds an unbounded tile.
4. Frequent pairs are ranked by frequency in turn. Each tile answers its chunks with the frequent cells they brought, a pair becomes one symbol
   with its rank as id, and the same tiles count (pair, next word) for phrases of three words. A phrase of three is looked at only if both pairs in it are frequent, which
   loses none: no phrase occurs more often than its parts.

Scores are exact: ``div`` on 38-digit decimals.

Defined results: a null text is empty; a null language is ``und``; repeated rows count each; texts are read whole, whatever their length;
phrases of equal score and count go by their bytes; a language without frequent phrases has no rows; an empty table gives an empty result; extra
columns are not read. Ids of words that reach the least count must fit 31 bits in one language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import ranked
from netloom.operators.small import small_side
from netloom.session import materialise

LEAST = 10                        # occurrences a phrase needs
ABSORBED = 50                     # percent of a phrase's occurrences inside a longer one that drop it
CHUNK_WORDS = 1 << 18             # words and ids of a chunk are held at once, by a worker and in a row
SIDE = 1024                       # ids in the first band
DENSE_CELLS = 1 << 22             # largest tile, or part of one, that is counted densely
PART_WORDS = 1 << 21              # occurrences that one part of a tile is planned for
GROUP_BYTES = 16 << 20            # of a written file's row groups
# Parquet looks at the size of its pages and row groups after a hundred rows, unless told otherwise; chunks are so wide that a whole file would be
# one page, held several times over on and off the heap.
WIDE = {"parquet.page.size.row.check.min": "1"}
CHUNK_SCHEMA = "chunk long, lang string, n_words long, words array<string>, counts array<long>, codes binary"
TILE_SCHEMA = "lang string, tile int, parts long, part long, chunk long, cells binary, counts binary"
SUM_SCHEMA = "lang string, tile int, part long, chunk long, lefts array<long>, rights array<long>, counts array<long>, hits array<long>"

_BREAK = b"\xff"                  # never part of UTF-8
_BYTES = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


# --- 1 chunks ----------------------------------------------------------------

def tokens(text: str) -> list[bytes]:
    """Words, and a break for every separator."""
    return text.encode("utf-8", "replace").translate(_BYTES).replace(_BREAK, b" \xff ").split()


def chunk_row(serial: int, lang: str, held: list[pa.Array]) -> pa.RecordBatch:
    """A chunk: its distinct words, their counts, and the text as numbers into them, -1 for a break."""
    found = pa.chunked_array(held).combine_chunks().dictionary_encode()
    words, codes = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    counts = np.bincount(codes, minlength=len(words)).astype(np.int64)
    real = pc.not_equal(words, pa.scalar(_BREAK)).to_numpy(zero_copy_only=False)
    to = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [pa.array([serial]), pa.array([lang]), pa.array([int(counts[real].sum())]), listed(words.filter(pa.array(real)).cast(pa.string())),
         listed(pa.array(counts[real])), pa.array([to[codes].tobytes()], pa.binary())], ["chunk", "lang", "n_words", "words", "counts", "codes"])


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to chunks of one language; a chunk is written when its language has enough words or the task holds too many."""
    from pyspark import TaskContext
    context = TaskContext.get()
    serial = (context.partitionId() if context else 0) << 32
    held: dict[str, list[pa.Array]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = tokens(text)
            found.append(_BREAK)
            held.setdefault(lang, []).append(pa.array(found, pa.binary()))
            sizes[lang] = sizes.get(lang, 0) + len(found)
            full = lang if sizes[lang] >= CHUNK_WORDS else None
            if full is None and sum(sizes.values()) >= 2 * CHUNK_WORDS:
                full = max(sizes, key=sizes.__getitem__)
            if full is not None:
                serial += 1
                yield chunk_row(serial, full, held.pop(full))
                del sizes[full]
    for lang in held:
        serial += 1
        yield chunk_row(serial, lang, held[lang])


def written(rows: DataFrame, name: str) -> DataFrame:
    """A table of wide rows, in pages and row groups of bounded size."""
    return materialise(rows, name, **WIDE, **{"parquet.block.size": str(GROUP_BYTES)})


def chunks_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(rows.mapInArrow(chunked, CHUNK_SCHEMA), "chunks")


# --- 2 tiles -----------------------------------------------------------------

def band_of(ids: np.ndarray) -> np.ndarray:
    """0 for ids below SIDE, then one more for each doubling."""
    return np.frexp(ids // SIDE)[1]


def band_start(band: int) -> int:
    return SIDE << (band - 1) if band else 0


def band_width(band: int) -> int:
    return SIDE << max(band - 1, 0)


def counted(cells: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, and how often each occurs: a dense bincount for a crowded tile, else sorted coordinates."""
    if span <= DENSE_CELLS and len(cells) * 8 >= span:
        dense = np.bincount(cells)
        at = np.flatnonzero(dense)
        return at, dense[at]
    return np.unique(cells, return_counts=True)


def added(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells, ascending, and the sums of their counts, by the same two ways."""
    low, span = int(cells.min()), int(cells.max()) - int(cells.min()) + 1
    if span <= DENSE_CELLS and len(cells) * 8 >= span:
        dense = np.zeros(span, np.int64)
        np.add.at(dense, cells - low, counts)
        at = np.flatnonzero(dense)
        return at + low, dense[at]
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return cells[first], np.add.reduceat(counts, first, dtype=np.int64)


def cell_type(tile: int, parts: int):
    """The narrowest whole number that holds the cells of a tile's part."""
    return np.uint32 if band_width(tile >> 6) * band_width(tile & 63) // parts < 2 ** 32 else np.int64


def tiles_of(lang: str, chunk: int, left: np.ndarray, right: np.ndarray, rows: dict[int, int], cols: dict[int, int]) -> pd.DataFrame:
    """One row per tile and part that the pairs touch. ``rows`` and ``cols`` are the occurrences in each band of the whole language."""
    out = []
    tiles = (band_of(left) << 6) | band_of(right)
    order = np.argsort(tiles, kind="stable")
    tiles, left, right = tiles[order], left[order], right[order]
    starts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]]) if len(tiles) else []
    for a, b in zip(starts, [*starts[1:], len(tiles)]):
        tile = int(tiles[a])
        i, j = tile >> 6, tile & 63
        cells, counts = counted((left[a:b] - band_start(i)) * band_width(j) + (right[a:b] - band_start(j)), band_width(i) * band_width(j))
        parts = -(-min(rows[i], cols[j]) // PART_WORDS)
        kind = cell_type(tile, parts)
        for part in range(parts):
            at = cells % parts == part if parts > 1 else slice(None)
            mine = cells[at] // parts
            if len(mine):
                out.append((lang, tile, parts, part, chunk, mine.astype(kind).tobytes(), counts[at].astype(np.int32).tobytes()))
    return frame(out, TILE_SCHEMA)


def by_band(ids: DataFrame, name: str) -> DataFrame:
    """lang, and the occurrences in each band of its ids: a row per language."""
    of = F.expr(f"id div {SIDE}")
    banded = ids.groupBy("lang", F.when(of > 0, F.length(F.bin(of))).otherwise(0).cast("int").alias("band")).agg(F.sum("f").alias("f"))
    return banded.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("band", "f"))).alias(name))      # at most 64 bands


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


# --- 3 sums ------------------------------------------------------------------

def sums(tiles: DataFrame, least: int, answer: bool) -> DataFrame:
    """Frequent cells of every tile: one row with their ids and counts (its chunk is null), and, if asked for, one row for each chunk that
    brought some, with their places in that list."""
    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lang, tile, parts, part = key[0], *map(int, key[1:])          # plain numbers: cells outgrow 32 bits
        i, j = tile >> 6, tile & 63
        brought = [np.frombuffer(c, cell_type(tile, parts)) for c in group["cells"]]      # as narrow as they came: only sums are widened
        cells, counts = added(np.concatenate(brought), np.concatenate([np.frombuffer(c, np.int32) for c in group["counts"]]))
        cells, counts = cells[counts >= least], counts[counts >= least]
        whole = cells.astype(np.int64) * parts + part
        out = [(lang, tile, part, None, whole // band_width(j) + band_start(i), whole % band_width(j) + band_start(j), counts, None)] if len(cells) else []
        for chunk, mine in zip(group["chunk"].tolist(), brought) if answer and len(cells) else ():
            at = np.minimum(np.searchsorted(cells, mine), len(cells) - 1)
            at = at[cells[at] == mine]
            if len(at):
                out.append((lang, tile, part, chunk, None, None, None, at))
        return frame(out, SUM_SCHEMA).astype({"chunk": "Int64"})
    return written(tiles.groupBy("lang", "tile", "parts", "part").applyInPandas(add, SUM_SCHEMA), "sums")


def frequent(found: DataFrame) -> DataFrame:
    """lang, tile, part, at, left, right, f of the frequent pairs in the sums."""
    rows = found.where("chunk IS NULL").select("lang", "tile", "part", F.posexplode(F.arrays_zip("lefts", "rights", "counts")).alias("at", "x"))
    return rows.select("lang", "tile", "part", "at", F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"), F.col("x.counts").alias("f"))


# --- 4 phrases ---------------------------------------------------------------

def with_ids(chunks: DataFrame, occurrences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """chunk, lang, ids: the chunk's words by frequency rank, -1 for rarer words and breaks."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, lang, codes, local in zip(batch["chunk"], batch["lang"], batch["codes"], batch["local"]):
                codes, local = np.frombuffer(codes, np.int32), np.asarray(local, np.int64)
                to = np.full(int(codes.max()) + 2, -1, np.int32)               # its last place stands for -1
                to[local >> 32] = local & 0x7FFFFFFF
                yield frame([(chunk, lang, to[codes].tobytes())], "chunk, lang, ids")
    one = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("id"))
    local = occurrences.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(
        F.collect_list(one).alias("local"))                                     # at most a chunk's distinct words
    rows = chunks.select("chunk", "lang", "codes").join(local, "chunk")
    return written(rows.mapInPandas(encode, "chunk long, lang string, ids binary"), "encoded")


def pair_tiles(encoded: DataFrame, bands: DataFrame) -> DataFrame:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, lang, raw, band in zip(*(batch[c] for c in ("chunk", "lang", "ids", "words"))):
                ids = np.frombuffer(raw, np.int32).astype(np.int64)
                at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
                yield tiles_of(lang, chunk, ids[at], ids[at + 1], dict(band), dict(band))
    return encoded.join(bands, "lang").mapInPandas(count, TILE_SCHEMA)


def known_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """chunk, and the keys and ids of its frequent pairs, from the tiles' answers."""
    def pick(answers: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        listed = listed.sort_values("at")
        left, right, ids = (listed[c].to_numpy(np.int64) for c in ("left", "right", "id"))
        keys = (left << 32) | right
        return frame([(chunk, keys[at].tobytes(), ids[at].tobytes()) for chunk, at in zip(answers["chunk"], answers["hits"])], "chunk, keys, ids")
    answers = found.where("chunk IS NOT NULL").select("lang", "tile", "part", "chunk", "hits")
    listed = pairs.select(F.col("lang").alias("l"), F.col("tile").alias("t"), F.col("part").alias("p"), "at", "left", "right", "id")
    picked = answers.groupBy("lang", "tile", "part").cogroup(listed.groupBy("l", "t", "p")).applyInPandas(pick, "chunk long, keys binary, ids binary")
    return picked.groupBy("chunk").agg(F.collect_list(F.struct("keys", "ids")).alias("known"))          # one for each tile


def triple_tiles(encoded: DataFrame, known: DataFrame, bands: DataFrame) -> DataFrame:
    """Tiles of (pair, next word), where the next word forms a frequent pair with the pair's second word as well."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, lang, raw, of_tiles, rows, cols in zip(*(batch[c] for c in ("chunk", "lang", "ids", "known", "pairs", "words"))):
                ids = np.frombuffer(raw, np.int32).astype(np.int64)
                keys, ranks = (np.concatenate([np.frombuffer(x[c], np.int64) for x in of_tiles]) for c in ("keys", "ids"))
                order = np.argsort(keys)
                keys, ranks = keys[order], ranks[order]
                wanted = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), (ids[:-1] << 32) | ids[1:], -1)
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                pair = np.where(keys[at] == wanted, ranks[at], -1)
                at = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
                yield tiles_of(lang, chunk, pair[at], ids[at + 2], dict(rows), dict(cols))
    return encoded.join(known, "chunk").join(bands, "lang").mapInPandas(count, TILE_SCHEMA)


def share(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = "CAST({} AS DECIMAL(38, 0))"
    return F.expr(f"({wide.format(1000000)} * {a} * {a}) div ({wide.format(left)} * {right})")


def mine(docs: DataFrame, least: int = LEAST, absorbed: int = ABSORBED, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words."""
    chunks = chunks_of(docs, text, lang)
    totals = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    listed = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    occurrences = listed.select("chunk", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("count"))
    vocabulary = occurrences.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= least)
    vocabulary = materialise(ranked(vocabulary, ["lang"], [F.desc("f"), F.col("word")], "id"), "vocabulary")
    bands = by_band(vocabulary, "words")
    encoded = with_ids(chunks, occurrences, vocabulary)

    found = sums(pair_tiles(encoded, small_side(bands)), least, True)
    pairs = materialise(ranked(frequent(found), ["lang"], [F.desc("f"), F.col("left"), F.col("right")], "id"), "pairs")
    bands = small_side(by_band(pairs, "pairs").join(bands, "lang"))
    triples = frequent(sums(triple_tiles(encoded, known_pairs(found, pairs), bands), least, False))
    return best(vocabulary, pairs, triples, totals, absorbed, top)


def best(vocabulary: DataFrame, pairs: DataFrame, triples: DataFrame, totals: DataFrame, absorbed: int, top: int) -> DataFrame:
    def word(n: int) -> DataFrame:
        return vocabulary.select("lang", F.col("id").alias(f"i{n}"), F.col("word").alias(f"w{n}"), F.col("f").alias(f"f{n}"))

    def pair(x: int, y: int, *more: Column) -> DataFrame:
        return pairs.select("lang", F.col("left").alias(f"i{x}"), F.col("right").alias(f"i{y}"), F.col("f").alias(f"f{x}{y}"), *more)

    threes = triples.select("lang", F.col("left").alias("p"), F.col("right").alias("i3"), F.col("f").alias("a"))
    threes = threes.join(pair(1, 2, F.col("id").alias("p")), ["lang", "p"]).join(pair(2, 3), ["lang", "i2", "i3"])
    inside = threes.select("lang", F.col("i1").alias("i1"), F.col("i2").alias("i2"), "a").union(threes.select("lang", "i2", "i3", "a"))
    inside = inside.groupBy("lang", "i1", "i2").agg(F.max("a").alias("longest"))
    for n in (1, 2, 3):
        threes = threes.join(word(n), ["lang", f"i{n}"])
    first, second = share("a", "f1", "f23"), share("a", "f12", "f3")
    early = first <= second
    threes = threes.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                           F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least(first, second).alias("score"))
    twos = pair(1, 2).join(inside, ["lang", "i1", "i2"], "left").where(
        F.col("longest").isNull() | (100 * F.col("longest") < absorbed * F.col("f12"))).join(word(1), ["lang", "i1"]).join(word(2), ["lang", "i2"])
    twos = twos.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f12").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"),
                       share("f12", "f1", "f2").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    kept = twos.unionByName(threes).withColumn("rank", rank).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("int"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
