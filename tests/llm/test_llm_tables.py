"""Sharding, phrase mining and the manifest against brute force: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from netloom.llm import collocations, merkle, sharding
from tests.llm.test_llm_operators import DOCS, LONG, PROSE, TEXTS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in (
        "rank", "row", "shard", "slot", "size", "part", "digest", "grp", "leaf", "word", "chunk", "n", "_pos", "_part", "_first")})


ROWS = [(i, t, ("en", None, "fr", "EN", "é")[i % 5], None if i % 7 == 0 else f"s{i % 3}", None if i % 4 == 0 else i) for i, t in enumerate(TEXTS * 3)]
ODD = ROWS + [ROWS[3], ROWS[3], (None, "no Id", "en", "s", 5), (None, None, None, None, None), (-5, "Minus A", "zh", "s", 7)]


# --- 11 sharding -------------------------------------------------------------

def test_shards_are_near_equal_and_gapless(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), "x" * int(n), "en", "s", 1) for i, n in enumerate(rng.integers(0, 400, 3000))] + [(7, "hot " * 20, "en", "s", 1)] * 1500 + ODD[:0]
    got = sharding.report(table(spark, rows), 8).collect()
    assert len(got) == len(rows)
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) < 1.02 * sum(loads.values()) / 8 and min(loads.values()) > 0.98 * sum(loads.values()) / 8     # a third of all rows share one id
    for shard in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_sizes_and_checksums(spark):
    got = sharding.report(table(spark, ODD)).collect()
    want = sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"], r["map_version"]) for r in got} == {("bytes", None, 1)} and all(0 <= r["shard"] < 40 for r in got)
    assert sharding.report(table(spark, ODD).limit(0)).count() == 0


def test_map_edits_move_only_what_they_must(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = {(s, 0): int(n) for s, n in enumerate(rng.integers(1, 1000, 2000))}
    first = sharding.planned(sizes, {}, 10)
    assert max(first.loads()) - min(first.loads()) < 1000
    grown = first.grown()
    moved = {k for k in sizes if grown.shard_of[k] != first.shard_of[k]}
    assert all(grown.shard_of[k] == 10 for k in moved) and grown.version == 2 and grown.shards == 11
    assert max(grown.loads()) < 1.02 * min(grown.loads())
    drained = grown.drained(3)
    assert drained.loads()[3] == 0 and all(drained.shard_of[k] == s for k, s in grown.shard_of.items() if s != 3)
    heavier = {k: n * (5 if first.shard_of[k] == 0 else 1) for k, n in sizes.items()}
    uneven = first.with_sizes({**heavier, (5000, 0): 10})
    even = uneven.rebalanced(0.02)
    assert max(even.loads()) <= 1.02 * sum(even.loads()) / 10 < max(uneven.loads())
    assert all(uneven.shard_of[k] == s for k, s in even.shard_of.items() if uneven.shard_of[k] != 0)
    folder = str(tmp_path / "map")
    for m in (first, grown, drained):
        sharding.save(m, spark, folder)
    assert sharding.load(spark, folder) == drained and sharding.load(spark, folder, 2) == grown


# --- 12 phrases --------------------------------------------------------------

def brute_phrases(rows, least, absorbed, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = collections.defaultdict(list)
    for p, a in often.items():
        lang, words = p[0], p[1:]
        inside = lambda q: any(q[i:i + len(words)] == words for i in range(1, len(q) - len(words) + 1))
        if any(q[0] == lang and len(q) > len(p) and inside(q) and 100 * b >= absorbed * a for q, b in often.items()):
            continue
        cuts = [(1000000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def phrase_rows(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "gamma", "délta", "eps\x00", "New", "york", "city", "of", "the"] + [f"w{i}" for i in range(40)]
    weights = np.array([8.0] * 10 + [1.0] * 40)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 60), p=weights / weights.sum()))
        rows.append((i, text.replace("of the", "of the New york city, ").replace("w3", "\n").replace("w7 ", "\t"), (None, "en", "fr", "und")[i % 4], "s", 1))
    return rows + [(900, None, "en", "s", 1), (901, "", None, "s", 1), (902, "..,,\n", "en", "s", 1), (903, "the the the the", "rare", "s", 1)] + rows[:5]


def test_phrases(spark, monkeypatch):
    rows = phrase_rows(4)
    want = brute_phrases(rows, 5, 50, 30)
    assert len({r[0] for r in want}) == 3
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, collocations.mine(table(spark, rows), 5, 50, 30).select(columns).collect())) == want
    assert collocations.mine(table(spark, rows).limit(0)).count() == 0


def test_phrases_over_many_bands_parts_and_chunks(spark, monkeypatch):
    """Small bands, parts and chunks, so that every tile is cut and met by many chunks, dense ones and sparse ones alike."""
    rows = phrase_rows(5)
    want = brute_phrases(rows, 5, 50, 30)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for name, value in (("SIDE", 4), ("PART_WORDS", 40), ("CHUNK_WORDS", 150), ("DENSE_CELLS", 64)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.mine(table(spark, rows), 5, 50, 30).select(columns).collect())) == want


def test_long_text_and_scores_beyond_64_bits(spark):
    rows = [(1, LONG + " " + LONG, "en", "s", 1)]
    assert brute_phrases(rows, 10, 50, 2000) == sorted(map(tuple, collocations.mine(table(spark, rows)).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
    big = spark.createDataFrame([(3 * 10 ** 12, 4 * 10 ** 12, 5 * 10 ** 12)], "a long, l long, r long")
    assert big.select(collocations.share("a", "l", "r")).first()[0] == 450000


def test_chunks_lie_in_row_groups_and_pages_of_bounded_size(spark):
    """A chunk's row is wide: no file may be one page, whatever its number of rows, and no chunk outgrow a worker."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(x.tobytes().hex() for x in rng.integers(0, 2 ** 32, 2 ** 16, np.uint32)), "en", "s", 1) for i in range(24)]
    chunks = collocations.chunks_of(table(spark, rows).coalesce(1), "text", "lang")
    assert chunks.agg({"n_words": "sum"}).first()[0] == 24 * 2 ** 16
    assert chunks.agg({"n_words": "max"}).first()[0] <= 2 ** 18 + 2 ** 16
    (path,) = chunks.inputFiles()
    written = pq.ParquetFile(path.removeprefix("file://")).metadata
    groups = [written.row_group(i) for i in range(written.num_row_groups)]
    assert written.num_rows > 5 and len(groups) > 1
    assert max(g.total_byte_size for g in groups) < 2 * 2 ** 24


def test_cells_of_wide_tiles_are_counted_exactly():
    """Cells beyond 32 bits, as in tiles of rare words, go through the same two ways of counting."""
    left, right = np.array([5, 2 ** 28, 2 ** 28, 2 ** 28 + 1]), np.array([2 ** 29, 2 ** 29 + 7, 2 ** 29 + 7, 3])
    bands = {i: 10 ** 9 for i in range(32)}
    found = collections.Counter()
    for r in collocations.tiles_of("en", 1, left, right, bands, bands).itertuples():
        i, j = r.tile >> 6, r.tile & 63
        cells = np.frombuffer(r.cells, collocations.cell_type(r.tile, r.parts)).astype(np.int64) * r.parts + r.part
        for cell, n in zip(cells.tolist(), np.frombuffer(r.counts, np.int32).tolist()):
            found[cell // collocations.band_width(j) + collocations.band_start(i), cell % collocations.band_width(j) + collocations.band_start(j)] += n
    assert found == collections.Counter(zip(left.tolist(), right.tolist()))


# --- 13 manifest -------------------------------------------------------------

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    def leaf(r, text):
        i, _, lang, source, n = r
        return h(*map(framed, (i, source, lang, n, text)))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        out = []
        for nodes in levels[:-1]:
            low = i // 8 * 8
            out.append((nodes[low:i], nodes[i + 1:low + 8]))
            i //= 8
        return out
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = collections.defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, lower(r[1]) if hit else r[1]), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    crown = climb([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, _, leaf_, altered, doc_id) in enumerate(sorted(groups[g])):
            steps, node = way(trees[g], i) + way(crown, at), altered
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((repr(doc_id), leaf_, trees[g][-1][0], crown[-1][0], h(*(x for left, right in steps for x in (*left, *right))), node, node == crown[-1][0]))
    return sorted(out)


def manifest_rows(df):
    got = df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted((repr(r[0]), *r[1:]) for r in got)


def test_manifest(spark):
    for rows in (ODD, ROWS[:1], [r for r in ROWS if r[2] == "en"], [(i, f"Text {i}", "en" if i < 600 else f"l{i % 11}", "s", i) for i in range(700)]):
        assert manifest_rows(merkle.report(table(spark, rows))) == brute_manifest(rows)
    assert merkle.report(table(spark, ODD).limit(0)).count() == 0


def test_only_changed_texts_fail(spark):
    rows = [(i, "All Upper" if i % 2 else "all lower", "en", "s", 1) for i in range(60)]
    for r in merkle.report(table(spark, rows)).collect():
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] % 2 == 1
        assert r["verified"] != changed


def test_long_and_plain_texts_have_their_digest(spark):
    rows = [(1, LONG, "en", "s", 1), (2, PROSE[0], "en", "s", 1)]
    assert {r["leaf"] for r in merkle.report(spark.createDataFrame(rows, DOCS)).collect()} == {r[1] for r in brute_manifest(rows)}
