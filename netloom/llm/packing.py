"""Pack tokenised documents into fixed-length sequences by multiway differencing.

A document longer than a sequence fills whole sequences of its own; what remains is cut into pieces of at most an eighth of a
sequence. A task gathers pieces until they fill a group of windows up to a small margin, cutting the last one so that the total fits, and
splits the group by Karmarkar-Karp: partial partitions are merged, largest spread first, with opposing imbalances, which
leaves windows of nearly equal sums. If one exceeds its capacity, the window count rises and the group is split again. The
rest at the end of a task, less than one sequence, is cut at powers of two, which need no padding.

Everything happens where a document is read: nothing is shuffled or gathered, a task holds one group, and a lost task
repeats its own sequences. Sequence ids carry the task's partition number.

Tokens come from a public tokenizer file, one white-space separated chunk at a time; chunks seen before are looked up in two generations.
Neither normalisation nor splitting of this tokenizer reaches over ASCII white space, so the ids equal those of the whole text.

Defined results: a null text is empty and has only the end id; repeated rows are packed each; texts of any length are
cut, never dropped; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 4096, 2
PIECE, WINDOWS, MARGIN = CAPACITY // 8, 24, 32
CACHE_CHUNKS = 400_000           # in each of two generations
ID_BYTES = 4


# --- tokens ------------------------------------------------------------------

def _byte_letters() -> dict[str, str]:
    """The byte-level alphabet for letters up to U+00FF: each UTF-8 byte stands as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + n)
    return {chr(c): "".join(names[b] for b in chr(c).encode()) for c in range(256)}


class ChunkIds(dict):
    """Chunk of text (bytes without ASCII white space) -> its ids as little-endian 32-bit bytes."""

    LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+\Z")
    # a word with its punctuation, which this tokenizer always splits; quotes and angle brackets may belong together
    TAIL = re.compile(r"(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([!#-&*-.:;?]+)\Z", re.DOTALL)

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        self.plain = str.maketrans({chr(b): m for b, m in ((ord(c), m) for c, m in _byte_letters().items()) if b > 127})

    def __missing__(self, chunk: bytes) -> bytes:
        done = self.older.get(chunk)
        if done is None:
            done = self.encoded(chunk.decode("utf-8", "replace"))
        if len(self) >= CACHE_CHUNKS:                # chunks in use move on to the new generation, the others go with the next one
            self.older = dict(self)
            self.clear()
        self[chunk] = done
        return done

    def encoded(self, text: str) -> bytes:
        if self.LETTERS.match(text):
            if (low := text.lower()) != text and self.LETTERS.match(low):
                return self[low.encode()]
            ids = [t.id for t in self.tokenizer.model.tokenize(low.translate(self.plain))]
        elif tail := self.TAIL.match(text):
            return self[tail[1].encode()] + self[tail[2].encode()]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)

    def of_text(self, text: str | None, end: bytes) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "surrogatepass").split())) + end


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One cache per worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


# --- windows -----------------------------------------------------------------

def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp into k windows: positions of the sizes in each."""
    heap = [(-s, i, [s] + [0] * (k - 1), [[i]] + [[] for _ in range(k - 1)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        sums, members = [x + y for x, y in zip(a, reversed(b))], [x + y for x, y in zip(in_a, reversed(in_b))]
        order = sorted(range(k), key=sums.__getitem__, reverse=True)
        sums, members = [sums[i] for i in order], [members[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, members))
        tie += 1
    return heap[0][3] if heap else []


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``, as few as differencing allows."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


@dataclass(slots=True)
class Piece:
    doc_id: int | None
    start: int
    ids: memoryview                   # cuts share the document's ids
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // ID_BYTES

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (Piece(self.doc_id, self.start, self.ids[:n * ID_BYTES], self.doc_tokens),
                Piece(self.doc_id, self.start + n, self.ids[n * ID_BYTES:], self.doc_tokens))


class Packer:
    """Packs one task's documents; yields (piece, sequence number, offset)."""

    def __init__(self):
        self.pending: list[Piece] = []
        self.total = 0
        self.sequences = 0

    def place(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for p in pieces:
            yield p, self.sequences, offset
            offset += p.length
        self.sequences += 1

    def add(self, doc: Piece) -> Iterator[tuple[Piece, int, int]]:
        while doc.length >= CAPACITY:
            whole, doc = doc.cut(CAPACITY)
            yield from self.place([whole])
        while doc.length:
            piece, doc = doc.cut(min(PIECE, doc.length))
            self.pending.append(piece)
            self.total += piece.length
        if self.total >= WINDOWS * (CAPACITY - MARGIN):
            yield from self.flush(WINDOWS)

    def flush(self, k: int) -> Iterator[tuple[Piece, int, int]]:
        """Pack as many pending tokens as fill k windows up to the margin; the rest stays pending."""
        rest, spare = [], self.total - k * (CAPACITY - MARGIN)
        while spare > 0:
            last = self.pending.pop()
            if last.length > spare:
                keep, last = last.cut(last.length - spare)
                self.pending.append(keep)
            spare -= last.length
            rest.append(last)
        group, self.pending = self.pending, rest[::-1]
        self.total = sum(p.length for p in self.pending)
        for w in windows([p.length for p in group]):
            yield from self.place([group[i] for i in w])

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        if k := self.total // (CAPACITY - MARGIN):
            yield from self.flush(k)
        while self.total:
            take, size = [], 1 << (self.total.bit_length() - 1)
            while size:
                piece = self.pending.pop(0)
                if piece.length > size:
                    piece, rest = piece.cut(size)
                    self.pending.insert(0, rest)
                take.append(piece)
                size -= piece.length
                self.total -= piece.length
            yield from self.place(take)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (an array) if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyspark import TaskContext
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        ids_of, end, packer = chunk_ids(tokenizer_path), end_id.to_bytes(ID_BYTES, "little"), Packer()

        def frame(placed: list[tuple[Piece, int, int]]) -> pd.DataFrame:
            out = pd.DataFrame([(p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, first + s, o) for p, s, o in placed],
                               columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            if with_ids:
                out["ids"] = [np.frombuffer(p.ids, "<u4").astype(np.int32) for p, _, _ in placed]
            return out

        placed: list[tuple[Piece, int, int]] = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = memoryview(ids_of.of_text(text, end))
                placed += packer.add(Piece(None if doc_id is None or doc_id != doc_id else int(doc_id), 0, ids, len(ids) // ID_BYTES))
                if len(placed) > 5000:
                    yield frame(placed)
                    placed = []
        placed += packer.finish()
        if placed:
            yield frame(placed)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, schema + ", ids array<int>" * with_ids)
