"""License notices found by template markup.

A template is a line of words. ``[...]`` encloses an optional region, ``{n}`` stands for up to n replaceable words, all other
words are mandatory. Each template is compiled into a token automaton; a text holds the notice where a run of
its words is accepted, that is where the mandatory wording stands exactly, in order, with nothing but the allowed regions between.

Only documents that hold the longest mandatory word of some template, or a word of a base phrase, are split into words; for
the others the words are merely counted, on the bytes of a whole batch.

Defined results: a null text has no words; labels are distinct and sorted; repeated rows each get a result; texts of any
length are read whole; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Public notices as templates; words as they stand after lower-casing and splitting.
TEMPLATES = (
    ("mit", "[this {3} is] [released] [licensed] [distributed] under the [terms of the] mit [open source] license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "licensed under the [terms of the] apache license [version] 2 0"),
    ("apache-2.0", "licensed under the apache license [version] v2 0"),
    ("gpl-3.0", "licensed under the [terms of the] gnu general public license [as published by {6}] [either] version 3"),
    ("gpl-2.0", "licensed under the [terms of the] gnu general public license [as published by {6}] [either] version 2"),
    ("lgpl", "under the [terms of the] gnu lesser general public license"),
    ("agpl-3.0", "under the [terms of the] gnu affero general public license"),
    ("cc-by-4.0", "licensed under [a] [the] [creative commons] cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under [a] [the] [creative commons] cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under [a] [the] [creative commons] cc by sa 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international [public] license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted [provided that the following conditions are met]"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("copyright", "copyright [c] {8} all rights reserved"),
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
BATCH_BYTES = 8 << 20


@dataclass
class Automaton:
    """Token automaton: per state the words it takes, whether it takes any word, and the states it reaches for free."""
    label: str
    takes: list[dict[bytes, int]] = field(default_factory=list)
    anyword: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    last: int = 0
    anchor: bytes = b""

    def state(self) -> int:
        self.takes.append({})
        self.anyword.append(None)
        self.free.append([])
        return len(self.takes) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepts_from(self, words: list[bytes], at: int) -> bool:
        states = self.closed({0})
        while self.last not in states:
            if not states or at >= len(words):
                return False
            word, at = words[at], at + 1
            states = self.closed({t for s in states for t in (self.takes[s].get(word), self.anyword[s]) if t is not None})
        return True

    def openings(self) -> set[bytes] | None:
        """Words an accepted run can begin with; None if any word can."""
        start = self.closed({0})
        return None if any(self.anyword[s] is not None for s in start) else {w for s in start for w in self.takes[s]}


def compiled(label: str, template: str) -> Automaton:
    auto = Automaton(label)
    at, open_at, mandatory = auto.state(), [], []
    for part in re.findall(r"\[|\]|\{\d+\}|[^\s\[\]{}]+", template):
        if part == "[":
            open_at.append(at)
        elif part == "]":
            end = auto.state()
            auto.free[at].append(end)
            auto.free[open_at.pop()].append(end)
            at = end
        elif part[0] == "{":
            end = auto.state()
            auto.free[at].append(end)
            for _ in range(int(part[1:-1])):
                step = auto.state()
                auto.anyword[at] = step
                auto.free[step].append(end)
                at = step
            at = end
        else:
            step = auto.state()
            auto.takes[at][part.encode()] = step
            at = step
            if not open_at:
                mandatory.append(part.encode())
    auto.last, auto.anchor = at, max(mandatory, key=len)
    return auto


class Matcher:
    def __init__(self, templates=TEMPLATES, base=BASE):
        self.automata = [compiled(*t) for t in templates]
        self.base = [(tuple(p.encode().split()), label) for p, label in base]
        self.by_opening: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.openings():
                self.by_opening.setdefault(w, []).append(a)
        anchors = {a.anchor for a in self.automata} | {min(p, key=lambda w: (-len(w), w)) for p, _ in self.base}
        self.anchor = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(sorted(anchors, key=lambda w: (-len(w), w))) + rb")(?![0-9a-z\x80-\xff])")
        self.anchors = sorted(anchors)

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        first = {p[0]: [] for p, _ in self.base}
        for p, label in self.base:
            first[p[0]].append((p, label))
        return [(i, label) for i, w in enumerate(words) if w in first for p, label in first[w] if tuple(words[i:i + len(p)]) == p]

    def notices(self, words: list[bytes]) -> set[str]:
        return {a.label for i, w in enumerate(words) if w in self.by_opening for a in self.by_opening[w] if a.accepts_from(words, i)}


def word_counts(texts: list[bytes]) -> np.ndarray:
    """Words per lower-cased text, counted over the joined bytes."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = IN_WORD[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.diff(np.searchsorted(starts, ends), prepend=0)


def scan(texts: list[str], matcher: Matcher) -> list[dict]:
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out = []
    for raw, n in zip(data, word_counts(data) if data else []):
        row = {"n_words": int(n), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
        if any(a in raw for a in matcher.anchors) and matcher.anchor.search(raw):
            words = WORD.findall(raw)
            places, found = matcher.places(words), matcher.notices(words)
            base = {label for _, label in places}
            if places:
                row |= {"n_base": len(places), "first_word": min(p for p, _ in places), "last_word": max(p for p, _ in places)}
            row |= {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | found)),
                    "score": 1.0 if found else 0.5 if base else 0.0}
        out.append(row)
    return out


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, words, places of base phrases, labels and score: 1 where a template is accepted, 0.5 where only a base phrase stands."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates)
        for batch in batches:
            texts, ids, at = [t or "" for t in batch["text"].tolist()], batch["doc_id"], 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) <= BATCH_BYTES:
                    size += len(texts[end])
                    end += 1
                found = pd.DataFrame(scan(texts[at:end], matcher))
                found[["first_word", "last_word"]] = found[["first_word", "last_word"]].astype("Int64")
                found.insert(0, "doc_id", ids.iloc[at:end].reset_index(drop=True))
                yield found
                at = end
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(rows, f"doc_id long, {RESULT}")
