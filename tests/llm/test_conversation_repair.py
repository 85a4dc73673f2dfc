"""Repair of conversations against a search over all edits, in one stretch and in many."""

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quarrybook.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, _row int, conv string"
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) of the cheapest, ASCII-least repair of (role, text, fault), by plain recursion with memory."""

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        wanted = "assistant" if state == 2 else "user"
        after = {"user": 2, "assistant": 3}[wanted]
        ways = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            cost, audit, lines = best(i, after, inserted + 1)
            ways.append((cost + 2, "I" + audit, (wanted + ":", *lines)))
        if i < len(rows):
            role, text, fault = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            ways.append((cost + 3, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                more = 1 if fault == "truncated" else 0
                for letter, new, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    to = {"s": 1 if state == 0 else None, "u": 2 if state != 2 else None, "a": 3 if state == 2 else None}.get(new[:1])
                    if to is not None:
                        cost, audit, lines = best(i + 1, to, 0)
                        ways.append((cost + price + more, letter + audit, (f"{new}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, 0, 0)


def judged(rows):
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(conversations):
    out = {}
    for conv, rows in conversations.items():
        ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        found = judged([(r[1], r[2]) for r in ordered])
        cost, audit, lines = cheapest(tuple(found))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(found, found[1:])]
        out[conv] = (*(sum(f == k for *_, f in found) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def table():
    rnd = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "admin", "", None])
            text = rnd.choice(["Yes.", "No!", "cut", "  ", "", "Why?\n", "a. b", None, "é…", f"{turn}."])
            rows.append((conv, rnd.choice([turn, turn, turn, None]), role, text))
    rows += [(100, 5, "user", "x" * 300_000 + "."), (100, 5, "user", "x" * 300_000 + ".")]
    rows += [(200, t, "assistant" if t % 3 else "user", f"{t % 70}." if t % 4 else "cut") for t in range(120)]  # one conversation over many stretches
    return rows


@pytest.mark.parametrize("bits", [14, 2])
def test_equals_a_search_over_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "STRETCH_BITS", bits)
    rows = table()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(7)
    repair = cr.Repair(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report().collect()}
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        conversations[conv].append((turn, " " if role is None else role, " " if text is None else text))
    want = expected(conversations)
    assert got == want
    lines = defaultdict(list)
    for r in repair.rows().orderBy("conv_id", "place").collect():
        assert r["edit"] in "KRI" and (r["edit"] != "I" or (r["text"] == "" and r["turn"] is None))
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for conv, found in want.items():
        assert hashlib.sha256("\n".join(lines[conv]).encode()).hexdigest() == found[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines[conv]))


def test_halving_equals_one_pass_for_every_sequence_of_codes():
    rnd = random.Random(2)
    roles, faults = ("system", "user", "assistant", "tool"), ("", "truncated", "blank", "duplicate")
    for _ in range(400):
        codes = "".join(rnd.choices(sorted(cr.MOVES), k=rnd.randint(1, 14)))
        rows = tuple((roles[(ord(c) - 65) // 4], "t", faults[(ord(c) - 65) % 4]) for c in codes)
        tables = [cr.TABLES[c] for c in codes]
        end, cost = cr._end(tables)
        audit = "".join(e[0] for e in cr._edits(codes, 0, end)) + "I" * len(cr.ENDINGS[end])
        assert (cost, audit) == cheapest(rows)[:2]


def test_damage_and_empty(spark):
    rows = [(c, t, "user", "Hi. You!") for c in range(40) for t in (0, 1, 3)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    found = cr.repair_damaged(df)
    assert found.count() == 41 and found.where("gaps > 0").count() > 20
    assert cr.damage(df).count() < len(rows) + 20
    empty = cr.repair_damaged(df.limit(0))
    assert empty.collect() == [] and empty.columns == found.columns
    gone = df.where(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")) % 20 == 0).where("turn is not null")
    left = cr.repair_damaged(gone).collect()
    assert left and all((r["cost"], r["audit"], r["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest()) for r in left)
