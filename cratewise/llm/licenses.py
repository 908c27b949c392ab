"""Licence wording in third-party notices, matched by template markup.

A template is the wording of a licence notice with marked regions: optional ones between
``<<beginOptional>>`` and ``<<endOptional>>``, replaceable ones as
``<<var;name="...";match="...">>``. It compiles to an automaton over word tokens: words
outside the regions must stand exactly as written, an optional region may be skipped, a
replaceable one takes one or more words that match its expression, as many as there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ALNUM, LOWER, Fingerprints, pieces, runs

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MARK = re.compile(r'<<(beginOptional|endOptional|var;name="[^"]*";match="(?P<match>[^"]*)")>>')

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Templates and their labels, beyond the base phrases.
TEMPLATES = {
    "gpl-notice": '<<beginOptional>>This <<var;name="work";match="[a-z]+">> is <<endOptional>>licensed under the <<beginOptional>>terms of the <<endOptional>>'
    'GNU <<beginOptional>>Lesser <<endOptional>>General Public License<<beginOptional>> version <<var;name="version";match="[0-9]+">><<endOptional>>',
    "apache-notice": '<<beginOptional>>This <<var;name="work";match="[a-z]+">> is <<endOptional>>licensed under the Apache License'
    '<<beginOptional>> Version <<var;name="version";match="[0-9]+">><<endOptional>>',
    "cc-notice": '<<beginOptional>>This <<var;name="work";match="[a-z]+">> is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>>'
    '<<beginOptional>>the <<endOptional>>CC BY<<beginOptional>> <<var;name="terms";match="nc|nd|sa">><<endOptional>>'
    '<<beginOptional>> <<var;name="version";match="[0-9]+">><<endOptional>>',
    "mit-notice": "Released under the <<beginOptional>>terms of the <<endOptional>>MIT License",
    "mit-grant": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-terms": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "no-warranty": 'provided as is without warranty of any kind<<beginOptional>> express or implied<<endOptional>>',
    "lgpl": "GNU Lesser General Public License",
    "cc-share-alike": 'CC BY <<beginOptional>>NC <<endOptional>>SA<<beginOptional>> <<var;name="version";match="[0-9]+">><<endOptional>>',
}


@dataclass(frozen=True)
class Automaton:
    """States 0..n; ``steps[s]`` lists (test, next), a test being a word or an expression.

    ``must`` holds words that every accepted text contains, ``opens`` the words that can
    come first, or None if an expression can.
    """

    label: str
    steps: tuple[tuple[tuple[bytes | re.Pattern, int], ...], ...]
    jumps: tuple[frozenset[int], ...]
    must: frozenset[bytes]
    opens: frozenset[bytes] | None

    def longest(self, words: list[bytes]) -> int:
        """How many of the leading ``words`` the longest accepted reading takes; 0 if none."""
        return max(self.stop(words.__getitem__, 0, len(words), {}), 0)

    def stop(self, word: Callable[[int], bytes], start: int, end: int, reach: dict[tuple[int, int], int]) -> int:
        """Where the longest accepted reading of the words from ``start`` to ``end`` stops; -1 if there is none.

        ``reach`` keeps, for all starts in one text, how far a state at a word gets, so
        that no pair of state and word is read twice however long a region runs.
        """
        final, trail = len(self.steps) - 1, []
        at, now = start, set(self.jumps[0])
        while now := [s for s in now if (s, at) not in reach]:
            w = word(at) if at < end else None
            onward = {s: [t for test, to in self.steps[s] if w is not None and _accepts(test, w) for t in self.jumps[to]] for s in now}
            trail.append((at, onward))
            at, now = at + 1, {t for ts in onward.values() for t in ts}
        for at, onward in reversed(trail):
            for s, ts in onward.items():
                reach[s, at] = max([at if s == final else -1, *(reach[t, at + 1] for t in ts)])
        return max(reach[s, start] for s in self.jumps[0])


def _accepts(test: bytes | re.Pattern, word: bytes) -> bool:
    return test == word if isinstance(test, bytes) else test.fullmatch(word) is not None


def compile_template(label: str, markup: str) -> Automaton:
    steps: list[list] = [[]]
    skips: list[tuple[int, int]] = []
    opened: list[int] = []
    must: set[bytes] = set()

    def add(test) -> None:
        steps[-1].append((test, len(steps)))
        steps.append([])

    at = 0
    for mark in [*MARK.finditer(markup), None]:
        for w in WORD.findall(markup[at : mark.start() if mark else None].lower().encode()):
            add(w)
            if not opened:
                must.add(w)
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            opened.append(len(steps) - 1)
        elif mark[1] == "endOptional":
            skips.append((opened.pop(), len(steps) - 1))
        else:
            test = re.compile(mark["match"].encode())
            add(test)
            steps[-1].append((test, len(steps) - 1))  # and any number more
    if opened or not must:
        raise ValueError(f"template {label}: an optional region is left open, or no wording is mandatory")
    jumps = [{s} for s in range(len(steps))]
    for s in reversed(range(len(steps))):
        for a, b in skips:
            if a == s:
                jumps[s] |= jumps[b]
    tests = [t for s in jumps[0] for t, _ in steps[s]]
    opens = frozenset(tests) if all(isinstance(t, bytes) for t in tests) else None
    return Automaton(label, tuple(map(tuple, steps)), tuple(map(frozenset, jumps)), frozenset(must), opens)


def _prints(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    return Fingerprints(raw).of(starts, starts + [len(w) for w in words])


class Scanner:
    """Base phrases and templates over the words of one block of texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(p.encode().split(), _prints(p.encode().split()), label) for p, label in phrases.items()]
        self.automata = [compile_template(k, v) for k, v in templates.items()]
        self.must = [_prints(sorted(a.must)) for a in self.automata]
        self.opens = [_prints(sorted(a.opens)) if a.opens else None for a in self.automata]

    def scan(self, raw: np.ndarray, off: np.ndarray) -> list[dict]:
        buf = LOWER[raw]
        starts, ends = runs(ALNUM[buf], off)
        at = np.searchsorted(starts, off)
        names = Fingerprints(buf).of(starts, ends)
        row = np.repeat(np.arange(len(off) - 1), np.diff(at))
        data = buf.tobytes()

        def word(i: int) -> bytes:
            return data[starts[i] : ends[i]]

        out = [
            {"n_words": int(n), "base": [], "matches": []} for n in np.diff(at)
        ]
        for words, prints, label in self.phrases:
            k = len(words)
            found = np.flatnonzero(names[: len(names) - k + 1] == prints[0]) if len(names) >= k else np.zeros(0, dtype=np.int64)
            for j in range(1, k):
                found = found[names[found + j] == prints[j]]
            for i in found[row[found] == row[found + k - 1]].tolist() if len(found) else []:
                if [word(i + j) for j in range(k)] == words:
                    out[row[i]]["base"].append((i - at[row[i]], i - at[row[i]] + k, label))
        for automaton, must, opens in zip(self.automata, self.must, self.opens, strict=True):
            rows = None
            for m in must:
                holding = np.unique(row[names == m])
                rows = holding if rows is None else np.intersect1d(rows, holding, assume_unique=True)
                if not len(rows):
                    break
            for r in rows.tolist():
                a, b = at[r], at[r + 1]
                tries = np.arange(a, b) if opens is None else a + np.flatnonzero(np.isin(names[a:b], opens))
                done, reach = a, {}
                for i in tries.tolist():
                    if i >= done:
                        stop = automaton.stop(word, i, b, reach)
                        if stop > i:
                            out[r]["matches"].append((i - a, stop - a, automaton.label))
                            done = stop
        return out


_PLACE = "array<struct<start:bigint,end:bigint,label:string>>"
_FOUND = f"struct<n_words:bigint,base:{_PLACE},matches:{_PLACE}>"
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))


def _scan(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(phrases, templates)

        def places(found: list[tuple]) -> list[dict]:
            return [{"start": int(s), "end": int(e), "label": x} for s, e, x in sorted(found)]

        for texts in batches:
            rows = [r for _, buf, off in pieces(texts) for r in scanner.scan(buf, off)]
            yield pa.StructArray.from_arrays(
                [pa.array([r["n_words"] for r in rows], pa.int64()), pa.array([places(r["base"]) for r in rows], _PLACES),
                 pa.array([places(r["matches"]) for r in rows], _PLACES)],
                names=["n_words", "base", "matches"],
            )

    return run


def licensed_notices(notices: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """``notices`` with ``found``: its words, the base phrases and the template wordings in it.

    ``notices`` is (name, notice), the texts that credit third parties, with any further
    columns, all returned but an earlier ``found``. ``found`` is (n_words, base, matches); ``base`` holds every
    place where a base phrase's words stand one after another, ``matches`` the longest
    wording a template accepts from each place on, leftmost first and without overlap.
    Both are (start, end, label) in words from 0, sorted.

    * Words are runs of letters and digits, A-Z lower-cased; what parts words is ignored.
    * Null and empty notices have no words. Rows that repeat are read each.
    * An empty table gives no rows. A notice of any length is read whole.
    """
    scan = F.arrow_udf(_scan(phrases or PHRASES, templates or TEMPLATES), _FOUND, F.ArrowUDFType.SCALAR_ITER)
    return notices.withColumn("found", scan(F.coalesce("notice", F.lit(""))))
