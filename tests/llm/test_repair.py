"""Conversation repair against a plain programme over strings, against all edit sequences, and on hard rows."""

import hashlib
import itertools
import re
import zlib

import pytest

from netweave.llm import repair as rp
from netweave.llm.queries import op11_conversation_repair

SPACE = re.compile(r"[\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults_of(rows):
    """Rows of a conversation in order with their first faults."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = SPACE.sub("", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return rows, out


def plain_repair(rows):
    """(cost, audit, repaired lines) by a programme over suffixes, every value a whole string."""
    rows, faults = faults_of(rows)
    best = {q: (0, "", ()) if q in (0, 3) else (10**9, "", ()) for q in range(4)}

    def inserts(best):
        for _ in range(4):
            for q in range(4):
                for c, role in (("u", "user"), ("a", "assistant")):
                    if c in NEXT[q]:
                        cost, audit, lines = best[NEXT[q][c]]
                        best[q] = min(best[q], (cost + 5, "I" + audit, (f"{role}:", *lines)))
        return best

    best = inserts(best)
    for (_, _, role, text), fault in zip(reversed(rows), reversed(faults)):
        now, more = {}, 5 if fault == "truncated" else 0
        for q in range(4):
            cost, audit, lines = best[q]
            choices = [(cost + 2, "D" + audit, lines)]
            if fault in (None, "truncated"):
                if role[:1] in NEXT[q]:
                    cost, audit, lines = best[NEXT[q][role[:1]]]
                    choices.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                for c, new in (("u", "user"), ("a", "assistant")):
                    if c in NEXT[q]:
                        cost, audit, lines = best[NEXT[q][c]]
                        choices.append((cost + more + 1, "R" + audit, (f"{new}:{text}", *lines)))
            now[q] = min(choices)
        best = inserts(now)
    return best[0]


def plain_result(conv, rows):
    rows, faults = faults_of(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    initials = [r[2][:1] for r in rows]
    cost, audit, lines = plain_repair(rows)
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def expected(kept, originals):
    return sorted((plain_result(c, [r for r in kept if r[0] == c]) for c in {r[0] for r in originals}), key=str)


def found(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def all_edits(initials, faults):
    """Least (cost, audit) over every sequence of edits with up to two inserts between rows."""
    best = None
    gaps = [""] + ["I" * n for n in (1, 2)]
    for edits in itertools.product("DKR", repeat=len(initials)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults)):
            continue
        for spaces in itertools.product(gaps, repeat=len(initials) + 1):
            audit = spaces[0] + "".join(e + s for e, s in zip(edits, spaces[1:]))
            cost, row, slots = 0, 0, []
            for e in audit:
                cost += {"D": 2, "I": 5, "K": 0, "R": 1}[e]
                if e == "I":
                    slots.append("ua")
                    continue
                if e != "D":
                    slots.append(initials[row] if e == "K" else "ua")
                    cost += 5 if faults[row] == "truncated" else 0
                row += 1
            if (best is None or (cost, audit) < best) and any(GRAMMAR.fullmatch("".join(c)) for c in itertools.product(*slots)):
                best = (cost, audit)
    return best


def test_programme_against_all_edit_sequences():
    roles = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    for initials in itertools.chain.from_iterable(itertools.product("suat", repeat=n) for n in range(4)):
        for faults in itertools.product((None, "truncated"), repeat=len(initials)):
            rows = [(1, k, roles[c], f"text {k}" + ("" if f else ".")) for k, (c, f) in enumerate(zip(initials, faults))]
            assert plain_repair(rows)[:2] == all_edits(initials, faults), (initials, faults)


def test_query_on_the_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_conversation_repair(spark, small)) == expected(plain_damage(rows), rows)


ODD = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "no end"), (1, 2, "assistant", "Same turn!"), (1, 5, "tool", "Out."),
    (2, None, "user", "No number?"), (2, None, "user", "No number?"), (2, 3, None, "No role."), (2, 4, "assistant", None),
    (None, 1, "assistant", "No id."), (None, None, None, None), (3, 1, "system", "Alone."), (4, 1, "", "Empty role."), (4, 2, "user", " \t\n "),
    (5, 1, "user", "x " * 50_000 + "."), (5, 2, "Assistant", "Upper initial."), (6, -3, "user", "A."), (6, 7, "assistant", "B."),
    *[(7, k, "user", "Copies.") for k in range(30)], *[(8, k, "su aua"[k % 6] * 2, f"Row {k}" + ".?!x"[k % 4]) for k in range(40)],
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("chunk, fan", [(1024, 1024), (3, 2), (1, 2)])
def test_hard_rows_and_chunks(spark, chunk, fan):
    turns = spark.createDataFrame([(*r, 1, "k", 2) for r in ODD], SCHEMA + ", pos int, key string, part int")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    assert found(rp.repair(turns, config=rp.RepairConfig(chunk, fan, 8))) == expected(plain, ODD)


def test_damage_drops_whole_conversations(spark):
    gone = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    rows = [(k, 0, "user", "Hi.") for k in range(200)]
    turns = spark.createDataFrame(rows, SCHEMA)
    out = {r.conv_id: r for r in rp.repair(rp.damaged(turns), keys=turns).collect()}
    assert gone and len(out) == 200
    assert all((out[k].cost, out[k].audit, out[k].n_rows, out[k].repaired_sha256) == (0, "", 0, hashlib.sha256(b"").hexdigest()) for k in gone)
    assert found(rp.repair(rp.damaged(turns), keys=turns)) == expected(plain_damage(rows), rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rp.repair(none).collect() == [] and rp.repair(rp.damaged(none), keys=none).collect() == []
