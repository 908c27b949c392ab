"""Secrets in cached lookup responses, found through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: trigrams
that any match must contain. Postings of those trigrams are built for each block of
texts, intersected and united as the query says, and only the candidates are searched.
A rule that fixes no trigram is searched in every text.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, pieces

# A query is a conjunction of alternatives, each alternative a set of trigrams that must
# all occur: [[{"aki", "kia"}], ...]. An empty conjunction admits every text.
Query = list[list[frozenset[str]]]

_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more.

    ``scan`` may give an equivalent pattern that a full search runs faster.
    """

    kind: str
    pattern: str
    group: int
    least: int
    scan: str | None = None


# The three base kinds first, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0, 0),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = ("assign", "access", "hex")


def _trigrams(strings: set[str]) -> list[frozenset[str]] | None:
    """The alternatives that one of ``strings`` occurs; None when a string fixes nothing."""
    if any(len(s) < 3 for s in strings):
        return None
    return [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)]


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that any match of ``pattern`` must contain.

    The parsed expression is read from left to right with the set of strings that its
    latest exact stretch can be; an inexact part ends the stretch, whose strings then
    give one conjunct.
    """
    query: Query = []

    def flush(strings: set[str]) -> None:
        alternatives = _trigrams(strings)
        if alternatives:
            query.append(alternatives)

    def exact(node) -> set[str] | None:
        """All strings a part can match, lower-cased, when they are few."""
        kind, arg = node
        name = str(kind)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            if all(str(k) == "LITERAL" for k, _ in arg):
                return {chr(x).lower() for _, x in arg}
            return None
        if name == "SUBPATTERN":
            return exact_all(arg[-1])
        if name == "BRANCH":
            parts = [exact_all(x) for x in arg[1]]
            return None if any(p is None for p in parts) else set().union(*parts)
        if name == "MAX_REPEAT" and arg[1] != parser.MAXREPEAT and arg[1] <= 4:
            one = exact_all(arg[2])
            if one is None:
                return None
            out, power = set(), {""}
            for k in range(arg[1] + 1):
                if k >= arg[0]:
                    out |= power
                power = {a + b for a in power for b in one}
                if len(power) > _MOST_STRINGS:
                    return None
            return out
        if name == "AT":
            return {""}
        return None

    def exact_all(items) -> set[str] | None:
        strings = {""}
        for node in items:
            more = exact(node)
            if more is None:
                return None
            strings = {a + b for a in strings for b in more}
            if len(strings) > _MOST_STRINGS:
                return None
        return strings

    def walk(items) -> None:
        strings = {""}
        for node in items:
            more = exact(node)
            joined = None if more is None else {a + b for a in strings for b in more}
            if joined is not None and len(joined) <= _MOST_STRINGS:
                strings = joined
                continue
            flush(strings)
            strings = more if more is not None and len(more) <= _MOST_STRINGS else {""}
            if more is None and str(node[0]) == "SUBPATTERN":
                walk(node[1][-1])
        flush(strings)

    walk(parser.parse(pattern))
    return query


class TrigramIndex:
    """Postings of the trigrams that some queries ask for, over one block of texts."""

    def __init__(self, trigrams: list[str]) -> None:
        self.names = trigrams
        codes = [(b[0] << 16) | (b[1] << 8) | b[2] for b in (t.encode() for t in trigrams)]
        self.slot = np.full(1 << 24, -1, dtype=np.int16)
        self.slot[codes] = np.arange(len(codes))
        self.first = np.zeros(256, dtype=bool)
        self.first[[c >> 16 for c in codes]] = True

    def postings(self, buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
        """Trigram -> sorted rows of the block that contain it, A-Z taken as a-z."""
        low = LOWER[buf]
        at = np.flatnonzero(self.first[low[:-2]]) if len(low) > 2 else np.zeros(0, dtype=np.int64)
        code = (low[at].astype(np.int32) << 16) | (low[at + 1].astype(np.int32) << 8) | low[at + 2]
        which = self.slot[code]
        at, which = at[which >= 0], which[which >= 0]
        row = np.searchsorted(off, at, side="right") - 1
        inside = at + 2 < off[row + 1]
        pairs = np.unique((which[inside].astype(np.int64) << 40) | row[inside])
        split = np.split(pairs & ((1 << 40) - 1), np.searchsorted(pairs >> 40, np.arange(1, len(self.names))))
        return dict(zip(self.names, split, strict=True))


def candidates(query: Query, postings: dict[str, np.ndarray], rows: int) -> np.ndarray:
    """Rows that satisfy ``query``: postings intersected within, united across alternatives."""
    found = np.arange(rows)
    for alternatives in query:
        any_of = [_all_of([postings[t] for t in sorted(alt)]) for alt in alternatives]
        found = np.intersect1d(found, np.unique(np.concatenate(any_of)), assume_unique=True)
    return found


def _all_of(lists: list[np.ndarray]) -> np.ndarray:
    lists = sorted(lists, key=len)
    out = lists[0]
    for x in lists[1:]:
        out = np.intersect1d(out, x, assume_unique=True)
    return out


def spans_of(rule: Rule, found: Iterator[re.Match]) -> list[tuple[int, int]]:
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    vocabulary = sorted({t for q in queries for alts in q for alt in alts for t in alt if t.isascii()})
    queries = [[[frozenset(t for t in alt if t.isascii()) for alt in alts] for alts in q if all(any(t.isascii() for t in alt) for alt in alts)] for q in queries]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = TrigramIndex(vocabulary)
        searches = [re.compile(r.scan or r.pattern) for r in rules]
        for texts in batches:
            out: list[list[dict]] = []
            for rows, buf, off in pieces(texts):
                n = len(off) - 1
                part = texts.slice(rows.start, n)
                postings = index.postings(buf, off)
                hits: list[list[tuple]] = [[] for _ in range(n)]
                held: dict[int, str | None] = {}
                for k, (rule, query, search) in enumerate(zip(rules, queries, searches, strict=True)):
                    for i in candidates(query, postings, n).tolist():
                        if i not in held:
                            held[i] = part[i].as_py()
                        if held[i]:
                            hits[i] += [(s, k, e) for s, e in spans_of(rule, search.finditer(held[i]))]
                out += [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(h)] for h in hits]
            yield pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return run


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def found_secrets(responses: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``responses`` with ``secrets``: (kind, start, end) of every secret in the response.

    ``responses`` is (hash, response_json) of the lookup cache, with any further columns,
    all returned; ``response_json`` is searched as plain text. Places are code points,
    end exclusive, sorted by start and then in the order of ``rules``.

    * Null and empty responses hold none; rows that repeat are searched each.
    * An empty table gives no rows. A response of any length is searched whole.
    * The index lives only as long as its block, so nothing is stored or shuffled.
    """
    scan = F.arrow_udf(_scan(rules), _SPANS, F.ArrowUDFType.SCALAR_ITER)
    return responses.withColumn("secrets", scan(F.coalesce("response_json", F.lit(""))))


def without_secrets(responses: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[removed]") -> DataFrame:
    """``responses`` with every secret replaced by ``mask``, overlapping ones by one."""
    found = found_secrets(responses, rules)
    text = F.col("response_json")
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate("secrets", state, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    return found.withColumn("response_json", F.when(F.size("secrets") > 0, cut).otherwise(text)).drop("secrets")
