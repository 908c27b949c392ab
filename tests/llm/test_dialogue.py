"""Repair of conversations against a search over all edits, and its edge cases."""

import hashlib
import itertools
import random
import re

import pytest

from cratewise.llm import dialogue

SCHEMA = "conv_id long, turn long, role string, text string, fault int, audit string, a string"
PATTERN = re.compile(r"(s?(ua)+)?")
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_faults(rows):
    """[(initial, fault)] of turns in order."""
    seen, out = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role[:1], 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0))
        seen.add((role, text))
    return out


def plain_repair(turns, most):
    """(cost, audit, role initials) by trying every sequence of edits that costs at most ``most``."""
    best = []

    def go(i, cost, audit, roles):
        if cost > most:
            return
        if i == len(turns) and PATTERN.fullmatch(roles):
            best.append((cost, audit, roles))
        after = NEXT[roles[-1:]]
        for r in "ua":
            if r in after:
                go(i, cost + 2, audit + "I", roles + r)
        if i < len(turns):
            initial, fault = turns[i]
            go(i + 1, cost + 3, audit + "D", roles)
            if fault not in (1, 2):
                cut = fault == 3
                if initial and initial in after:
                    go(i + 1, cost + cut, audit + "K", roles + initial)
                for r in "ua":
                    if r in after:
                        go(i + 1, cost + 2 + cut, audit + "R", roles + r)

    go(0, 0, "", "")
    return min(best)


def code(turns):
    roles = "sua"
    return bytes((roles.index(i) if i and i in roles else 3) * 3 + (0, 1, 1, 2)[f] for i, f in turns)


def test_edits_equal_a_search_over_all():
    rng = random.Random(5)
    cases = [list(c) for n in range(3) for c in itertools.product([(i, f) for i in ("s", "u", "a", "x") for f in (0, 1, 3)], repeat=n)]
    cases += [[(rng.choice("suuaax"), rng.choice((0, 0, 0, 1, 3))) for _ in range(rng.randint(3, 6))] for _ in range(150)]
    solver = dialogue.Repairs()
    got = solver.of([code(c) for c in cases])
    for case, (cost, audit) in zip(cases, got, strict=True):
        assert plain_repair(case, cost) [:2] == (cost, audit)
    assert solver.of([code(c) for c in cases]) == got


def test_one_grammar_or_many_give_the_same():
    rng = random.Random(6)
    strings = [bytes(rng.choice((0, 3, 3, 6, 6, 9, 4, 5)) for _ in range(rng.choice((1, 5, 40, 700)))) for _ in range(40)] + [b"\x03\x06" * 3000, b"\x06" * 501]
    together = dialogue.Repairs().of(strings)
    assert together == [dialogue.Repairs().of([s])[0] for s in strings]
    for string, (cost, audit) in zip(strings, together, strict=True):  # straight through, one turn after another
        row = [[(0, dialogue.Rope("")), None, None, None]]
        for symbol in string:
            row = dialogue.times(row, dialogue.symbol_matrix(symbol)) if len(string) < 800 else row
        if len(string) < 800:
            row = dialogue.times(row, dialogue.insertions())[0]
            assert min((row[q][0], str(row[q][1])) for q in dialogue.ENDS if row[q]) == (cost, audit)
    assert together[40] == (0, "K" * 6000)


def test_grammars_spell_their_strings():
    rng = random.Random(7)
    strings = [bytes(rng.choice((1, 1, 1, 2)) for _ in range(n)) for n in (0, 1, 2, 3, 50, 400)] + [b"\x01" * 9]
    rules, lines = dialogue.re_pair(strings, 12)

    def spell(symbol):
        return [symbol] if symbol < 12 else [x for side in rules[symbol - 12] for x in spell(side)]

    assert [[x for s in line for x in spell(s)] for line in lines] == [list(s) for s in strings]
    pairs = [p for line in lines for p in zip(line, line[1:], strict=False)]
    assert rules and all(pairs.count(p) < 2 or p[0] == p[1] for p in pairs)


def test_ropes_compare_as_their_strings():
    rng = random.Random(8)
    texts = ["".join(rng.choice("DIK") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["K" * 40, "K" * 41]

    def rope(t):
        if len(t) < 3:
            return dialogue.Rope(t)
        k = rng.randint(1, len(t) - 1)
        return dialogue.Rope(None, rope(t[:k]), rope(t[k:]))

    for a in texts:
        for b in texts:
            assert rope(a).before(rope(b)) == (a < b)


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 2, "user", "And"), (1, 3, "assistant", " \t"), (1, 5, "assistant", "Well?"),
    (2, None, "user", "no number."), (2, 3, "system", "Rules."), (2, 3, "system", "Rules."), (2, 7, "user", "Go."),
    (3, 1, None, None), (4, 4, "tool", "Result."), (4, 4, "", "No role."), (5, 1, "system", "Only."), (6, 2, "user", "x" * 200_000 + "."),
    (None, 1, "user", "Nobody."), (None, 2, "assistant", "Right."),
] + [(7, t, "user" if t % 3 else "assistant", f"turn {t % 50}.") for t in range(400)]


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in ROWS], SCHEMA)


def in_order(conv):
    rows = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ROWS if c == conv]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def check(spark, talks):
    plans = dialogue.repair_plans(talks).cache()
    got = {r["conv_id"]: r for r in plans.collect()}
    assert set(got) == {r[0] for r in ROWS}
    said = {}
    for r in sorted(dialogue.repaired_turns(talks, plans).collect(), key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in dialogue.repaired_digests(talks, plans).collect()}
    for conv, plan in got.items():
        if conv == 4:
            continue  # two turns of one number: their order is by a hash
        rows = in_order(conv)
        turns = plain_faults(rows)
        numbers = [t for t, _, _ in rows if t is not None]
        assert plan["gaps"] == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert [plan["blank"], plan["duplicate"], plan["truncated"]] == [sum(f == k for _, f in turns) for k in (1, 2, 3)]
        assert plan["illegal"] == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        if len(turns) < 9:
            assert (plan["cost"], plan["audit"]) == plain_repair(turns, plan["cost"])[:2]
        roles = "".join(r[:1] for r, _ in said.get(conv, []))
        assert PATTERN.fullmatch(roles)
        kept = [x for e, x in zip(plan["audit"].replace("I", ""), rows, strict=True) if e != "D"]
        assert [x for _, x in said.get(conv, []) if x] == [x for _, _, x in kept]
        lines = "\n".join(f"{r}:{x}" for r, x in said.get(conv, []))
        assert digests[conv] == hashlib.sha256(lines.encode()).hexdigest()
    assert got[4]["audit"] in ("RR", "DD") and got[4]["cost"] == 4
    assert (got[3]["audit"], got[3]["cost"]) == ("D", 3) and digests[3] == hashlib.sha256(b"").hexdigest()


def test_conversations_equal_a_plain_repair(spark, talks):
    check(spark, talks)


def test_pieces_of_long_conversations_join(spark, talks, monkeypatch):
    monkeypatch.setattr(dialogue, "CHUNK", 7)
    check(spark, talks)


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    plans = dialogue.repair_plans(none)
    assert plans.count() == 0 and dialogue.repaired_turns(none, plans).count() == 0 and dialogue.repaired_digests(none, plans).count() == 0
