"""License scans by template-markup matching.

A template is licence wording with marked regions: <<optional>> ... <<end>> may be left
out, and <<any N>> stands for up to N words of any kind.  Each template compiles into an
automaton over words; a text is accepted where its words run through all mandatory words
of a template, in order and with nothing between them but what the regions allow.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import LOWER, map_text

#: Phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates and their labels.
TEMPLATES = (
    ("under the <<optional>>terms of the<<end>> mit <<optional>>x11<<end>> license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this <<any 3>> and associated documentation files", "mit"),
    ("apache license <<optional>>version<<end>> 2 <<optional>>0<<end>>", "apache-2"),
    ("apache 2 <<optional>>0<<end>> license", "apache-2"),
    ("cc by nc <<optional>>sa<<end>> <<optional>>nd<<end>> <<optional>><<any 1>> 0<<end>>", "cc-by-nc"),
    ("creative commons attribution non <<optional>>-<<end>> commercial <<optional>><<any 2>> international<<end>> license", "cc-by-nc"),
    ("creative commons attribution noncommercial <<optional>><<any 2>> international<<end>> license", "cc-by-nc"),
    ("gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license <<optional>>as published by the free software foundation either<<end>> version <<any 1>>", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("all rights <<optional>>are<<end>> reserved", "all-rights-reserved"),
)
_WORDS = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else LOWER[c] for c in range(256))
_MARK = re.compile(r"<<(optional|end|any) ?(\d*)>>")


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all that is not ASCII."""
    return text.encode().translate(_WORDS).split()


class Automaton:
    """A template as a word automaton without empty moves.

    ``arcs[state]`` maps a word, or None for any word, to next states with what the step
    adds to the number of mandatory words; ``final`` holds accepting states."""

    def __init__(self, template: str):
        # a chain of steps; an optional region may be jumped over
        self.steps: list[tuple[bytes | None, int]] = []
        jumps: dict[int, list[int]] = {}
        open_at: list[int] = []
        at = 0
        for mark in [*_MARK.finditer(template), None]:
            for w in words(template[at : mark.start() if mark else None]):
                self.steps.append((w, 0 if open_at else 1))
            if mark is None:
                break
            at = mark.end()
            if mark[1] == "optional":
                open_at.append(len(self.steps))
            elif mark[1] == "end":
                jumps.setdefault(open_at.pop(), []).append(len(self.steps))
            else:
                end = len(self.steps) + int(mark[2])
                for _ in range(int(mark[2])):
                    jumps.setdefault(len(self.steps), []).append(end)
                    self.steps.append((None, 0))
        if open_at or not any(m for _, m in self.steps):
            raise ValueError(f"a region is open, or no word is mandatory: {template}")
        self.reach = [self._closure(i, jumps) for i in range(len(self.steps) + 1)]
        self.first = {self.steps[i][0] for i in self.reach[0] if i < len(self.steps)}
        if None in self.first or len(self.steps) in self.reach[0]:
            raise ValueError(f"a template must begin with words: {template}")

    @staticmethod
    def _closure(state: int, jumps: dict[int, list[int]]) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for nxt in jumps.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)

    def match(self, text: list[bytes], start: int) -> tuple[int, int] | None:
        """(words, mandatory words) of the longest match that begins at ``start``."""
        last = len(self.steps)
        live = dict.fromkeys(self.reach[0], 0)
        best = None
        for n, word in enumerate(text[start : start + last], 1):
            nxt: dict[int, int] = {}
            for state, mandatory in live.items():
                if state < last and self.steps[state][0] in (None, word):
                    for s in self.reach[state + 1]:
                        nxt[s] = max(nxt.get(s, 0), mandatory + self.steps[state][1])
            if last in nxt:
                best = n, nxt[last]
            if not (live := nxt):
                break
        return best


class Scanner:
    """All templates and base phrases, by the words that may begin them."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = [(Automaton(t), label) for t, label in base]
        self.all = [(a, label, True) for a, label in self.base] + [(Automaton(t), label, False) for t, label in templates]
        self.by_first: dict[bytes, list[tuple[Automaton, str, bool]]] = {}
        for entry in self.all:
            for w in entry[0].first:
                self.by_first.setdefault(w, []).append(entry)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, int, str, bool]]]:
        """The number of words, and each match: first word, words, mandatory words, label,
        and whether it is a base phrase."""
        own = words(text)
        found = []
        if not self.by_first.keys().isdisjoint(own):
            marked = np.flatnonzero(np.fromiter(map(self.by_first.__contains__, own), bool, len(own)))
            for at in marked.tolist():
                for automaton, label, is_base in self.by_first[own[at]]:
                    if m := automaton.match(own, at):
                        found.append((at, *m, label, is_base))
        return len(own), found


def scan(docs: DataFrame, keep: dict[str, str] | None = None, text: str = "text", base=BASE, templates=TEMPLATES, spans: bool = False) -> DataFrame:
    """The columns of ``keep`` (doc_id by default), n_words, n_base (all places of base
    phrases), first_word and last_word (their smallest and largest first word; null
    without any), base_labels and labels (distinct, sorted, comma-joined; labels has the
    templates' too), score, and with ``spans`` every match.

    score: the largest share of mandatory words in a matched stretch, 0 without a match.
    Null texts are empty.  Whole texts; rows are independent of each other."""

    def make():
        scanner = Scanner(base, templates)

        def work(texts):
            out = [[] for _ in range(8)]
            for t in texts:
                n, found = scanner.scan(t) if t else (0, [])
                at = [f[0] for f in found if f[4]]
                row = (n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({f[3] for f in found if f[4]})),
                       ",".join(sorted({f[3] for f in found})), max((f[2] / f[1] for f in found), default=0.0),
                       [{"label": f[3], "first": f[0], "words": f[1]} for f in found])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out if spans else out[:7]

        return work

    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_text(docs, keep or {"doc_id": "doc_id"}, text, make, added + ", matches array<struct<label string, first int, words int>>" * spans)
