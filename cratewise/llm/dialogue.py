"""Cheapest repair of conversations, by dynamic programming over a grammar.

The faults and roles of a conversation are a string over twelve symbols. The strings of
many conversations are compressed together by Re-Pair; each rule of the grammar gets one
min-plus transfer matrix between the states of the role pattern, worked out from the two
matrices of its sides, with the edits as ropes. Conversations that share rules share them.

The reference project keeps no conversations, so this operator is general.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import cmp_to_key

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage

CHUNK = 1 << 16  # turns of a piece of a conversation
BATCH = 1 << 18  # symbols that one grammar covers, or one longer conversation
HELD_RULES = 1 << 16  # matrices a task keeps for later grammars

BLANK = r"[\x20\x09-\x0D]"
ROLES, FAULTS = "sua", 3  # symbol = role (3: any other) * 3 + fault (0 none, 1 to delete, 2 truncated)

# States of the pattern (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
STATES, ENDS = 4, (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E68


class Rope:
    """A string of edits as a tree of shared parts, with a fingerprint to compare them by."""

    __slots__ = ("left", "right", "size", "mark", "shift", "leaf")

    def __init__(self, leaf: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.leaf, self.left, self.right = leaf, left, right
        if leaf is None:
            self.size, self.shift = left.size + right.size, left.shift * right.shift % _PRIME
            self.mark = (left.mark * right.shift + right.mark) % _PRIME
        else:
            self.size, self.mark, self.shift = len(leaf), 0, 1
            for c in leaf:
                self.mark, self.shift = (self.mark * _BASE + ord(c)) % _PRIME, self.shift * _BASE % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.size:
            return other
        if not other.size:
            return self
        if self.size + other.size <= 16 and self.leaf is not None and other.leaf is not None:
            return Rope(self.leaf + other.leaf)
        return Rope(None, self, other)

    def __str__(self) -> str:
        out, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.leaf is not None:
                out.append(rope.leaf)
            else:
                stack += (rope.right, rope.left)
        return "".join(out)

    def before(self, other: Rope) -> bool:
        """Whether this string is ASCII-less; equal parts are skipped whole."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x.size == y.size and x.mark == y.mark:
                continue
            if x.leaf is None and (x.size >= y.size or y.leaf is not None):
                a += (x.right, x.left)
                b.append(y)
            elif y.leaf is None:
                b += (y.right, y.left)
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.leaf[:n] != y.leaf[:n]:
                    return x.leaf < y.leaf
                a += [Rope(x.leaf[n:])] if x.size > n else []
                b += [Rope(y.leaf[n:])] if y.size > n else []
        return not a and bool(b)


Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


def _less(x: tuple[int, Rope], y: tuple[int, Rope]) -> bool:
    return x[0] < y[0] or (x[0] == y[0] and x[1].before(y[1]))


def times(rows: Matrix, by: Matrix) -> Matrix:
    """The min-plus product; of equal costs the ASCII-least edits stay.

    Edits of equal cost over the same turns are never one the start of the other: what is
    beyond would be insertions, which cost. So the least of two stays the least whatever follows.
    """
    out = []
    for row in rows:
        line: list[Entry] = []
        for q in range(STATES):
            best = None
            for k in range(STATES):
                if row[k] is not None and by[k][q] is not None:
                    cost = row[k][0] + by[k][q][0]
                    if best is None or cost <= best[0]:
                        entry = (cost, row[k][1] + by[k][q][1])
                        if best is None or _less(entry, best):
                            best = entry
            line.append(best)
        out.append(line)
    return out


def _put(matrix: Matrix, p: int, q: int, cost: int, letter: str) -> None:
    entry = (cost, Rope(letter))
    if matrix[p][q] is None or _less(entry, matrix[p][q]):
        matrix[p][q] = entry


def _nothing() -> Matrix:
    return [[None] * STATES for _ in range(STATES)]


def insertions() -> Matrix:
    """The cheapest insertions that lead from state to state."""
    out = _nothing()
    for p in range(STATES):
        state, n = p, 0
        while out[p][state] is None:
            out[p][state] = (INSERT * n, Rope("I" * n))
            state, n = STEP[state, "a" if state == 2 else "u"], n + 1
    return out


def symbol_matrix(symbol: int) -> Matrix:
    """The edits of one turn, after any insertions before it."""
    role, fault = ROLES[symbol // FAULTS : symbol // FAULTS + 1], symbol % FAULTS
    out, more = _nothing(), TRUNCATED if fault == 2 else 0
    for p in range(STATES):
        _put(out, p, p, DELETE, "D")
        if fault != 1:
            if (p, role) in STEP:
                _put(out, p, STEP[p, role], KEEP + more, "K")
            for to in "ua":
                if (p, to) in STEP:
                    _put(out, p, STEP[p, to], REROLE + more, "R")
    return times(insertions(), out)


def re_pair(strings: list[bytes], first: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (left, right) numbered from ``first`` on, and the strings over them.

    Again and again the most frequent pair of neighbours becomes a rule, until no pair
    occurs twice without overlap. Ties go to the pair of lesser symbols.
    """
    symbols: list[int] = []
    ends = [0]
    for s in strings:
        symbols += s
        ends.append(len(symbols))
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    for a, b in zip(ends, ends[1:], strict=False):
        if b > a:
            before[a], after[b - 1] = -1, -1
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n):
        if after[i] >= 0:
            places[symbols[i], symbols[after[i]]].add(i)
    heap = [(-len(at), pair) for pair, at in places.items() if len(at) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        at = places.get(pair, ())
        if len(at) < 2:
            continue
        if -count != len(at):
            heapq.heappush(heap, (-len(at), pair))
            continue
        spots, taken = [], set()
        for i in sorted(at):  # occurrences that do not overlap, from the left
            if i not in taken:
                spots.append(i)
                taken.add(after[i])
        del places[pair]
        if len(spots) < 2:
            continue
        new = first + len(rules)
        rules.append(pair)
        touched = set()
        for i in spots:
            j = after[i]
            p, q = before[i], after[j]
            if p >= 0:
                places[symbols[p], pair[0]].discard(p)
            if q >= 0:
                places[pair[1], symbols[q]].discard(j)
            symbols[i], symbols[j] = new, -1
            after[i] = q
            if q >= 0:
                before[q] = i
                places[new, symbols[q]].add(i)
                touched.add((new, symbols[q]))
            if p >= 0:
                places[symbols[p], new].add(p)
                touched.add((symbols[p], new))
        for pair in touched:
            if len(places[pair]) > 1:
                heapq.heappush(heap, (-len(places[pair]), pair))
    out = []
    for a, b in zip(ends, ends[1:], strict=False):
        line, i = [], a
        while a < b and i >= 0:
            line.append(symbols[i])
            i = after[i]
        out.append(line)
    return rules, out


class Repairs:
    """Cheapest edits of symbol strings; matrices are kept by what they stand for and shared."""

    def __init__(self) -> None:
        self.signs = 4 * FAULTS
        self.base = [symbol_matrix(x) for x in range(self.signs)]
        self.closing = insertions()
        self.held: dict[tuple, Matrix] = {}
        self.known: dict[bytes, tuple[int, str]] = {}

    def of(self, strings: list[bytes]) -> list[tuple[int, str]]:
        """(cost, edits) of every string."""
        new = sorted({s for s in strings if s not in self.known})
        if len(self.known) + len(new) > HELD_RULES:
            self.known = {s: self.known[s] for s in strings if s in self.known}
        rules, lines = re_pair(new, self.signs)
        matrices = list(self.base)
        names: list = list(range(self.signs))
        for left, right in rules:
            name = (names[left], names[right]) if names[left].__class__ is int or names[right].__class__ is int else None
            made = self.held.get(name) if name else None
            if made is None:
                made = times(matrices[left], matrices[right])
                if name and len(self.held) < HELD_RULES:
                    self.held[name] = made
            matrices.append(made)
            names.append(name or object())
        start: Matrix = [[(0, Rope("")), None, None, None]]
        for string, line in zip(new, lines, strict=True):
            row = start
            for symbol in line:
                row = times(row, matrices[symbol])
            row = times(row, self.closing)
            cost, edits = min((row[0][q] for q in ENDS if row[0][q] is not None), key=cmp_to_key(lambda x, y: -1 if _less(x, y) else 1))
            self.known[string] = (cost, str(edits))
        return [self.known[s] for s in strings]


def _ordered(conversations: DataFrame) -> DataFrame:
    """The turns with ``a`` and ``b``, which tell turns of one conversation and number apart and give them an order."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(7), "role", "text")})


def _faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, initial, fault) of ordered turns: the first fault as 1 blank, 2 duplicate, 3 truncated, or 0."""
    solid = F.regexp_replace("text", BLANK, "")
    narrow = turns.select(
        "conv_id", "turn", "a", "b", F.substring("role", 1, 1).alias("initial"),
        (F.length(solid) == 0).alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "a", "b").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("blank"), 1).when(F.col("seen"), 2).when(F.col("cut"), 3).otherwise(0)
    return narrow.withColumn("seen", seen).select("conv_id", "turn", "a", "b", "initial", fault.alias("fault"))


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("number", pa.int64()), ("symbols", pa.binary()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
])
_LEGAL = ("su", "ua", "au")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to pieces of conversations: their symbols, their counts, and what their ends need."""
    piece, number = None, 0

    def closed() -> dict:
        return {**piece, "symbols": bytes(piece["symbols"])}

    for batch in batches:
        out = []
        for conv, turn, a, b, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if piece is None or conv != piece["conv_id"] or len(piece["symbols"]) >= CHUNK:
                if piece is not None:
                    out.append(closed())
                number += 1
                piece = dict.fromkeys(_PIECE.names[10:], 0) | {
                    "conv_id": conv, "turn": turn, "a": a, "b": b, "number": number, "symbols": bytearray(), "first": initial, "low": None, "high": None
                }
            else:
                piece["illegal"] += piece["last"] + initial not in _LEGAL
            piece["last"] = initial
            if turn is not None:
                piece["turns"] += turn != piece["high"]
                piece["low"] = turn if piece["low"] is None else piece["low"]
                piece["high"] = turn
            if fault:
                piece[("blank", "duplicate", "truncated")[fault - 1]] += 1
            role = ROLES.find(initial) if initial else -1
            piece["symbols"].append((role if role >= 0 else 3) * FAULTS + (0, 1, 1, 2)[fault])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
    if piece is not None:
        yield pa.RecordBatch.from_pylist([closed()], schema=_PIECE)


_REPORT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("cost", pa.int64()), ("audit", pa.string()),
])


def _joined(conv: int | None, pieces: list[dict]) -> dict:
    """The counts of a whole conversation from its pieces in order."""
    out = {"conv_id": conv} | {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(p["last"] + q["first"] not in _LEGAL for p, q in zip(pieces, pieces[1:], strict=False))
    known = [p for p in pieces if p["low"] is not None]
    turns = sum(p["turns"] for p in known) - sum(p["high"] == q["low"] for p, q in zip(known, known[1:], strict=False))
    return out | {"gaps": known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0}


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repairs = Repairs()
    for batch in batches:
        convs, pieces = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        strings = [b"".join(p["symbols"] for p in ps) for ps in pieces]
        at = 0
        while at < len(strings):
            end, held = at, 0
            while end < len(strings) and (end == at or held + len(strings[end]) <= BATCH):
                held += len(strings[end])
                end += 1
            rows = [
                _joined(c, ps) | {"cost": cost, "audit": audit}
                for c, ps, (cost, audit) in zip(convs[at:end], pieces[at:end], repairs.of(strings[at:end]), strict=True)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=_REPORT)
            at = end


def repair_plans(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation: its faults and cheapest repair.

    ``conversations`` is (conv_id, turn, role, text), further columns ignored; ``conv_id``
    and ``turn`` are integers. Turns are taken by number, nulls first, and at one number
    by a hash of role and text. A turn's first fault counts: blank (nothing but blank
    characters), duplicate (role and text seen earlier), truncated (the last solid
    character is none of ``.!?``). ``gaps`` are the numbers missing between the first and
    the last one, ``illegal`` the neighbours whose initials are not su, ua or au.

    Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty user
    or assistant turn anywhere 2; a truncated turn that stays adds 1; blank and duplicate
    turns must go. ``audit`` has the initials of the cheapest edits in order that give
    role initials ``(s?(ua)+)?``, the ASCII-least of equal ones.

    * A null role or text is one blank; a role with another initial, or none, cannot be kept.
    * A null conv_id is a conversation of its own. Repeated rows are turns each.
    * No turns give no rows. ``audit`` and the symbols of a conversation take one byte
      per turn; nothing else of a conversation is held at once, and its turns are dealt
      over tasks by range, so a very long one is many pieces.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "a", "b"]
    rows = _faults(_ordered(conversations)).select("conv_id", "turn", "a", "b", "initial", F.col("fault").cast("int").alias("fault"))
    rows = cut_lineage(rows)  # ranges are drawn from it, then it is dealt
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "conv_id long, turn long, a long, b long, number long, symbols binary, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
    pieces = spread.mapInArrow(_pieces, kind)
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*_PIECE.names[1:]))).alias("pieces"))
    return whole.mapInArrow(_solved, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Sorted rows (conv_id, kind, role, text), a plan before its turns, to (conv_id, place, role, text).

    ``place`` 0 with no role opens a conversation.
    """
    conv, audit, at, state, place = None, "", 0, 0, 0

    def role_of() -> str:
        return "assistant" if state == 2 else "user"

    def put(role: str, text: str) -> tuple:
        nonlocal state, place
        state, place = STEP[state, role[0]], place + 1
        return conv, place, role, text

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            at += 1
            yield put(role_of(), "")

    for batch in batches:
        out: list[tuple] = []
        for c, kind, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0:
                out += inserted()
                conv, audit, at, state, place = c, text, 0, 0, 0
                out.append((conv, 0, None, None))
                continue
            out += inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                out.append(put(role if edit == "K" else role_of(), text))
        yield out
    yield list(inserted())


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _edited(batches):
        kept = [r for r in rows if r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = digest = None
    for rows in _edited(batches):
        done = []
        for c, place, role, text in rows:
            if place == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        yield _digest_rows(done)
    if digest is not None:
        yield _digest_rows([(conv, digest.hexdigest())])


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])


def _planned(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Every plan before its turns in order; a conversation streams through one task, as its transcript is one sequence."""
    turns = _ordered(conversations).select("conv_id", F.lit(1).alias("kind"), "role", "text", "turn", "a", "b")
    none = F.lit(None).cast("long")
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("audit").alias("text"), none.alias("turn"), none.alias("a"), none.alias("b"))
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "a", "b"]
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")


def repaired_turns(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the conversations as their ``plans`` (:func:`repair_plans`) repair them, from place 1 on."""
    return _planned(conversations, plans).mapInArrow(_turns, "conv_id long, place long, role string, text string")


def repaired_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired turns as ``role:text`` lines; that of nothing where all turns go."""
    return _planned(conversations, plans).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
