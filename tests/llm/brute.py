"""Plain one-process versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def shingles(text: str | None, width: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def note_classes(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {h: shingles(t) for h, t in rows}
    root = {h: h for h in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, seen = defaultdict(set), {}
    for h in sorted(sets):
        s = sets[h]
        if s and s in seen:
            root[h] = find(seen[s])
        elif s:
            seen[s] = h
            for g in s:
                holders[g].add(h)
    for h in seen.values():
        common = defaultdict(int)
        for g in sets[h]:
            for o in holders[g]:
                common[o] += 1
        for o, n in common.items():
            if o < h and 100 * n >= 80 * (len(sets[h]) + len(sets[o]) - n):
                a, b = sorted((find(h), find(o)))
                root[b] = a
    return {h: (len(s), find(h)) for h, s in sets.items()}


def passages(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """(bytes, removed, spans, digest of what is left) of each note."""
    seen, out = {}, {}
    for h, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen.setdefault(raw[i : i + length], (h, i)) != (h, i):
                gone[i : i + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[h] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def secrets(text: str | None) -> tuple[int, int, int, str]:
    """The base kinds straight from their patterns."""
    t, found = text or "", []
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, (kind, pattern, group, least) in enumerate(
        [("assign", assign, 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]
    ):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in pattern.finditer(t) if len(m.group(group)) >= least]
    digest = hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest()
    return (*(sum(x[1] == k for x in found) for k in range(3)), digest)


def licenses(text: str | None) -> tuple:
    """Words, places of base phrases, their least and largest start, their labels."""
    w = words(text)
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    at = [(i, x) for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))
