"""Secrets in texts, found through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived, which every text with a match fulfils: what stands one after
the other is joined by AND, alternatives by OR; short classes and optional parts are written out, repeats of any length and large classes end a
literal, and what is left of it counts if it has three letters. A batch of documents is one shard of the index: the
trigrams that occur in any query get posting lists over the shard's documents, the lists are intersected and united as the query
says, and only those candidates are verified by the regular expression. A rule without a mandatory trigram, such as the
bare hexadecimal run, scans every document. Shards need no shuffle, and a lost executor costs its own batches only.

Defined results: a null text is empty; overlapping spans of different kinds all stand; spans of one kind are leftmost and do not
overlap; a text of any length is one document of one shard; repeated rows each get a result; an empty table gives
an empty result; only the text is read, other columns pass by.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20            # text indexed at a time; one longer document is a shard of its own


SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def scheme_start(m: re.Match) -> int | None:
    """Where the scheme before "://" begins: at the first letter of the run of scheme characters; looked up backwards, so long runs cost their length once."""
    text, at = m.string, m.start()
    while at and text[at - 1] in SCHEME:
        at -= 1
    return next((i for i in range(at, m.start()) if text[i].isalpha()), None)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fits: Callable[[re.Match], bool] = lambda m: True
    flags: int = re.ASCII
    start: Callable[[re.Match], int | None] = re.Match.start


# The three base kinds in their listed order. A run of hexadecimal digits is matched whole or not at
# all, so its least length may stand in the pattern.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 12, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# Further kinds: formats of well-known credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\Z)"),
    Rule("git_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"\b[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"://[^\s/:@]+:[^\s/:@]{6,}@", start=scheme_start),
)
RULES = BASE + ADDED

# --- Boolean queries ---------------------------------------------------------
# A query is None (any text may match), a trigram, or ("and" | "or", queries).

MOST_LITERALS, LONGEST_LITERAL = 64, 24          # beyond these a literal ends and a new one begins


def joined(how: str, queries: list):
    """AND leaves out what says nothing; OR says nothing if one of its parts does."""
    if how == "and":
        queries = [q for q in queries if q is not None]
    elif any(q is None for q in queries):
        return None
    queries = list(dict.fromkeys(queries))
    return queries[0] if len(queries) == 1 else (how, tuple(queries)) if queries else None


def of_literals(literals: set[str]):
    """One of the literals occurs: all trigrams of one of them."""
    def one(word: bytes):
        return joined("and", [int.from_bytes(word[i:i + 3], "big") for i in range(len(word) - 2)])
    return joined("or", [one(w.encode("utf-8", "surrogatepass")) for w in sorted(literals)])


def lowered(code: int) -> str:
    return chr(code + 32) if 65 <= code <= 90 else chr(code)


def written_out(op, value) -> set[str] | None:
    """All texts, A-Z lowered, that a part can match, if they are few; None if not."""
    if op is sre.LITERAL:
        return {lowered(value)}
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {""}
    if op is sre.IN and value[0][0] is not sre.NEGATE:
        codes = [c for kind, x in value for c in ([x] if kind is sre.LITERAL else range(x[0], min(x[1], x[0] + MOST_LITERALS) + 1) if kind is sre.RANGE else [None] * 99)]
        return {lowered(c) for c in codes} if len(codes) <= MOST_LITERALS and None not in codes and len({lowered(c) for c in codes}) <= 8 else None
    if op is sre.SUBPATTERN:
        return None if value[1] or value[2] else sequence_of(value[3])
    if op is sre.BRANCH:
        found = [sequence_of(part) for part in value[1]]
        return None if None in found or len(set().union(*found)) > MOST_LITERALS else set().union(*found)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[1] == 1:
        found = sequence_of(value[2])
        return None if found is None else found | ({""} if value[0] == 0 else set())
    return None


def times(a: set[str], b: set[str]) -> set[str] | None:
    made = {x + y for x in a for y in b} if len(a) * len(b) <= 4 * MOST_LITERALS else None
    return made if made is not None and len(made) <= MOST_LITERALS and max(map(len, made)) <= LONGEST_LITERAL else None


def sequence_of(parts) -> set[str] | None:
    """What the parts match one after the other, written out."""
    return reduce(lambda a, b: None if a is None or b is None else times(a, b), (written_out(*p) for p in parts), {""})


def derived(parts):
    """The query of parts that stand one after the other."""
    found, literal = [], {""}
    for op, value in parts:
        more = written_out(op, value)
        longer = None if more is None else times(literal, more)
        if longer is not None:
            literal = longer
            continue
        found.append(of_literals(literal))
        literal = more if more is not None else {""}
        if more is not None:
            continue
        if op is sre.SUBPATTERN:
            found.append(None if value[1] or value[2] else derived(value[3]))
        elif op is sre.BRANCH:
            found.append(joined("or", [derived(part) for part in value[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] >= 1:
            found.append(derived(value[2]))
    return joined("and", [*found, of_literals(literal)])


def trigram_query(pattern: str, flags: int = re.ASCII):
    """The Boolean query every text with a match fulfils. Case folding beyond A-Z, which the index does not know, leaves none."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return None
    return derived(sre_parse.parse(pattern, flags))


def trigrams_in(query) -> set[int]:
    return set() if query is None else {query} if isinstance(query, int) else set().union(*map(trigrams_in, query[1]))


class Shard:
    """Posting lists of the wanted trigrams over some documents."""

    def __init__(self, texts: list[str], wanted: np.ndarray):
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data])          # one separator after each document
        raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8).copy()
        raw += ((raw >= 65) & (raw <= 90)).astype(np.uint8) * 32
        self.n, self.lists = len(texts), {}
        # Two-byte openings first: only places that can begin a wanted trigram are looked at closer.
        opening = np.zeros(65536, bool)
        opening[wanted >> 8] = True
        at = np.flatnonzero(opening[(raw[:-2].astype(np.uint16) << 8) | raw[1:-1]]) if len(raw) > 2 else np.empty(0, int)
        grams = (raw[at].astype(np.uint32) << 16) | (raw[at + 1].astype(np.uint32) << 8) | raw[at + 2]
        hit = np.isin(grams, wanted)
        grams, docs = grams[hit], np.searchsorted(ends, at[hit], side="right")
        order = np.argsort(grams, kind="stable")
        grams, docs = grams[order], docs[order]
        starts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.empty(0, int)
        for a, b in zip(starts, np.r_[starts[1:], len(grams)]):
            self.lists[int(grams[a])] = np.unique(docs[a:b])

    def matching(self, query) -> np.ndarray:
        """Documents that fulfil the query, by intersecting and uniting posting lists."""
        if query is None:
            return np.arange(self.n)
        if isinstance(query, int):
            return self.lists.get(query, np.empty(0, int))
        how, parts = query
        found = [self.matching(q) for q in parts]
        if how == "or":
            return np.unique(np.concatenate(found))
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(found, key=len))


def scan(texts: list[str], rules: tuple[Rule, ...] = RULES, full: bool = False) -> list[list[tuple[int, int, int]]]:
    """(start, end, rule index) of every span in each text, ordered by start, then by the rules' order; ``full`` goes without the index."""
    queries = [None if full else trigram_query(r.pattern, r.flags) for r in rules]
    wanted = np.array(sorted(set().union(*map(trigrams_in, queries)) or {0}), np.uint32)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    shard = Shard(texts, wanted)
    for k, rule in enumerate(rules):
        pattern = re.compile(rule.pattern, rule.flags)
        for i in shard.matching(queries[k]):
            spans = ((rule.start(m), m.end(), k) for m in pattern.finditer(texts[i]) if rule.fits(m))
            found[i] += [s for s in spans if s[0] is not None]
    for spans in found:
        spans.sort(key=lambda s: (s[0], s[2], s[1]))
    return found


def _shards(texts: list[str], size: int = BATCH_BYTES) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The secrets of a text as an array of (kind, start, end), in code points, end exclusive."""
    @F.pandas_udf(SPANS)
    def find(batch: pd.Series) -> pd.Series:
        out = []
        for part in _shards([t or "" for t in batch.tolist()]):
            out += [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans] for spans in scan(part, rules)]
        return pd.Series(out, dtype=object)
    return find(text)


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, b, k in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of their spans and all spans as text."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s for part in _shards([t or "" for t in batch["text"].tolist()]) for s in scan(part)]
            base = [[s for s in spans if s[2] < len(BASE)] for spans in found]
            count = lambda kind: [sum(s[2] == kind for s in spans) for spans in base]  # noqa: E731, B023
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
                "base_sha256": [hashlib.sha256(_joined(s, RULES).encode()).hexdigest() for s in base],
                "spans": [_joined(s, RULES) for s in found]})
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by a mark; overlapping spans become one. n_chars follows the text."""
    @F.pandas_udf("string")
    def clean(batch: pd.Series) -> pd.Series:
        values = batch.tolist()
        out = []
        for part in _shards([t or "" for t in values]):
            for text, spans in zip(part, scan(part)):
                pieces, at = [], 0
                for start, end, _ in spans:
                    if start >= at:
                        pieces += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join(pieces) + text[at:] if spans else text)
        return pd.Series([None if v is None else t for v, t in zip(values, out)], dtype=object)
    done = docs.withColumn("text", clean(F.col("text")))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
