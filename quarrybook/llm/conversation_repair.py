"""Cheapest repair of damaged conversations by divide and conquer over cost vectors of four states.

A repaired conversation reads ``(s?(ua)+)?`` in the initials of its roles.  Between two rows it is
in one of four states: nothing yet, after the system's turn, after a user, after an assistant.  The
cost of getting from each state to each other by a stretch of rows is a small table; such tables are
chained.  A conversation is halved: the forward costs from its start and the backward costs from its
end meet in the middle, a state of least cost is the crossing, and each half is repaired on its own.
Forward costs carry the order of their audits, so the crossing is that of the least audit.  Stretches
of rows are worked on by many tasks, and only their tables meet for one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrybook.plans.skew import join_groups
from quarrybook.plans.staging import Staging

#: Costs of the edits; an undeleted truncated row adds one.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of one stretch: a power of two, so that the number of a row gives its stretch.
STRETCH_BITS = 14
#: Initials by number; the last stands for any other.
INITIALS = "sua-"
SOUND, CUT_OFF, BLANK_ROW, SEEN = range(4)
#: The state that an initial leads to, by state: start, after system, after user, after assistant.
LEADS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What is inserted behind the last row to end well, by state.
ENDINGS = ("", "ua", "a", "")
FAR = 1 << 60

# one row -----------------------------------------------------------------------------------


def _moves(initial: str, fault: int) -> list[dict[int, tuple[int, str, str]]]:
    """By state before a row: state behind it -> cost, audit and roles of the cheapest edits, insertions before the row first."""
    extra = TRUNCATED if fault == CUT_OFF else 0
    found: list[dict[int, tuple[int, str, str]]] = [{} for _ in LEADS]
    for start in range(4):
        at, cost, audit, roles = start, 0, "", ""
        for _ in range(3):  # a third insertion would only come back to a state
            ways = [(at, cost + DELETE, audit + "D", roles + "-")]
            wanted = "a" if at == 2 else "u"
            if fault in (SOUND, CUT_OFF):
                ways.append((LEADS[at][wanted], cost + RENAME + extra, audit + "R", roles + wanted))
                if initial in LEADS[at]:
                    ways.append((LEADS[at][initial], cost + extra, audit + "K", roles + "="))
            for end, *way in ways:
                if end not in found[start] or tuple(way) < found[start][end]:
                    found[start][end] = tuple(way)
            at, cost, audit, roles = LEADS[at][wanted], cost + INSERT, audit + "I", roles + wanted
    return found


def _table(moves: list[dict]) -> tuple[tuple[tuple[int, int, int, int], ...], ...]:
    """By state before: (state behind, cost, place of its audit among those of the same state before)."""
    rows = []
    for start, ways in enumerate(moves):
        order = sorted(ways, key=lambda end: ways[end][1])
        rows.append(tuple((end, ways[end][0], order.index(end)) for end in sorted(ways)))
    return tuple(rows)


MOVES = {chr(65 + 4 * i + fault): _moves(initial, fault) for i, initial in enumerate(INITIALS) for fault in range(4)}
TABLES = {code: _table(moves) for code, moves in MOVES.items()}

# stretches of rows: any sequence of tables -----------------------------------------------------


def _forward(tables, lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Costs of the four states behind tables[lo:hi] from ``start``, and the order of their least audits.

    Audits of the same rows that end in different states are never prefixes of each
    other, so their order is that of their first parts, then of the last.
    """
    cost, place = [FAR] * 4, [0] * 4
    cost[start] = 0
    for k in range(lo, hi):
        best: list[tuple[int, int, int] | None] = [None] * 4
        for state, ways in enumerate(tables[k]):
            if cost[state] >= FAR:
                continue
            for end, more, order in ways:
                one = (cost[state] + more, place[state], order)
                if best[end] is None or one < best[end]:
                    best[end] = one
        ranked = sorted(b[1:] for b in best if b)
        cost = [b[0] if b else FAR for b in best]
        place = [ranked.index(b[1:]) if b else 0 for b in best]
    return cost, place


def _backward(tables, lo: int, hi: int, end: int) -> list[int]:
    cost = [FAR] * 4
    cost[end] = 0
    for k in range(hi - 1, lo - 1, -1):
        cost = [min((more + cost[to] for to, more, _ in ways), default=FAR) for ways in tables[k]]
    return cost


def _crossings(tables, start: int, end: int) -> list[tuple[int, int]]:
    """The states before and behind each table on the cheapest way from ``start`` to ``end`` that has the least audit."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(tables), start, end)]
    while todo:
        lo, hi, before, behind = todo.pop()
        if hi - lo == 1:
            out.append((before, behind))
        elif hi > lo:
            middle = (lo + hi) // 2
            cost, place = _forward(tables, lo, middle, before)
            rest = _backward(tables, middle, hi, behind)
            state = min(range(4), key=lambda s: (cost[s] + rest[s], place[s]))
            todo += [(middle, hi, state, behind), (lo, middle, before, state)]
    return out


def _end(tables) -> tuple[int, int]:
    """The state behind the last table and the whole cost, what must be inserted at the end included."""
    cost, place = _forward(tables, 0, len(tables), 0)
    total = [c + INSERT * len(tail) for c, tail in zip(cost, ENDINGS, strict=True)]
    state = min(range(4), key=lambda s: (total[s], place[s]))
    return state, total[state]


@lru_cache(maxsize=4096)
def _summary(codes: str) -> list[list[int]]:
    """The table of a stretch, flat: before, behind, cost, place."""
    tables, rows = [TABLES[c] for c in codes], []
    for start in range(4):
        cost, place = _forward(tables, 0, len(tables), start)
        rows += [[start, end, cost[end], place[end]] for end in range(4) if cost[end] < FAR]
    return rows


@lru_cache(maxsize=4096)
def _edits(codes: str, start: int, end: int) -> list[tuple[str, str]]:
    """Audit and roles of each row of a stretch."""
    return [MOVES[c][a][b][1:] for c, (a, b) in zip(codes, _crossings([TABLES[c] for c in codes], start, end), strict=True)]


def _unlawful(codes: str) -> int:
    initials = [INITIALS[(ord(c) - 65) // 4] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


# tasks ----------------------------------------------------------------------------------------

_SUMMARY = "conv string, gone boolean, stretch long, first string, last string, table array<array<long>>, blank long, duplicate long, truncated long, illegal long"
_PLAN = "conv string, gone boolean, stretch long, before int, behind int, final boolean, blank long, duplicate long, truncated long, illegal long, cost long"
_EDITS = "conv string, gone boolean, stretch long, final boolean, blank long, duplicate long, truncated long, illegal long, cost long, behind int, audits array<string>, roles array<string>"
_FAULTS = ["blank", "duplicate", "truncated", "illegal"]


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, gone, stretch, codes in frame.itertuples(index=False):
            faults = [(ord(c) - 65) % 4 for c in codes]
            rows.append((conv, gone, stretch, codes[0], codes[-1], _summary(codes), faults.count(BLANK_ROW), faults.count(SEEN), faults.count(CUT_OFF), _unlawful(codes)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def _plans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states around each stretch of a conversation, and the conversation's sums."""
    for frame in frames:
        rows = []
        for conv, gone, stretches in frame.itertuples(index=False):
            tables = []
            for one in stretches:
                ways: list[list[tuple[int, int, int]]] = [[], [], [], []]
                for before, behind, cost, place in one["table"]:
                    ways[before].append((int(behind), int(cost), int(place)))
                tables.append(ways)
            end, cost = _end(tables)
            sums = [sum(int(one[c]) for one in stretches) for c in _FAULTS]
            sums[3] += sum(_unlawful(a["last"] + b["first"]) for a, b in zip(stretches, stretches[1:], strict=False))
            for k, (one, (before, behind)) in enumerate(zip(stretches, _crossings(tables, 0, end), strict=True)):
                rows.append((conv, gone, one["stretch"], before, behind, k == len(stretches) - 1, *sums, cost))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PLAN.split(", ")])


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            edits = _edits(r.codes, r.before, r.behind)
            rows.append((r.conv, r.gone, r.stretch, r.final, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.behind, [e[0] for e in edits], [e[1] for e in edits]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _EDITS.split(", ")])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation: its stretches come in order and are hashed one after the other."""
    held, digest, audits, lines = None, None, [], False
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            if (r.conv, r.gone) != held:
                held, digest, audits, lines = (r.conv, r.gone), hashlib.sha256(), [], False
            if r.n_lines:
                digest.update((b"\n" if lines else b"") + r.piece.encode())
                lines = True
            audits.append(r.audit)
            if r.final:
                rows.append((r.conv, r.gone, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, "".join(audits), digest.hexdigest()))
        yield pd.DataFrame(rows, columns=["conv", "gone", *_FAULTS, "cost", "audit", "repaired_sha256"])


class Repair:
    """The cheapest repair of every conversation in ``rows`` (conv_id, turn, role, text).

    Null roles and texts are one space.  Rows go by turn (nulls first), then role, then the SHA-256 of the text;
    all rows of null conv_id are one conversation.  A row is blank without a character other than ASCII white
    space, a duplicate if its role and text came before in the conversation, truncated if its last such character is none of
    ``.!?``; the first of these counts.  Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (a must for blank rows and
    duplicates), Insert an empty text of user or assistant 2; a truncated row that stays adds 1.  Of the cheapest repairs
    that of the ASCII-least audit is taken.

    Empty tables give empty results; repeated rows are duplicates; very long texts are only hashed and
    looked at in Spark; further columns are left out.  A conversation is worked on in stretches of up to 16,384 rows, and
    what meets for one conversation is a small table of each stretch, its audit, and its text stretch by stretch.
    """

    def __init__(self, rows: DataFrame):
        staging = self.staging = Staging(rows.sparkSession, "repair")
        null = F.lit(" ")
        read = rows.select("conv_id", "turn", F.coalesce("role", null).alias("role"), F.coalesce("text", null).alias("text"))
        read = read.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "gone": F.col("conv_id").isNull(), "text_sha": F.sha2("text", 256), "tie": F.monotonically_increasing_id()})
        order = ["conv", "gone", F.col("turn").asc_nulls_first(), "role", "text_sha", "tie"]
        dealt = read.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
        # the number of a row tells its partition and its place there, so numbers are in order and stretches are whole numbers of them
        self.placed = staging.table(dealt.withColumn("row", F.monotonically_increasing_id()), "placed")
        coded = staging.table(self._codes(), "codes")
        self.plans = staging.table(self._planned(coded), "plans")
        self.edits = staging.table(coded.join(self.plans, ["conv", "gone", "stretch"]).mapInPandas(_edited, _EDITS), "edits")

    def _codes(self) -> DataFrame:
        """(conv, gone, stretch, codes): initials and faults of the rows of each stretch, a character each."""
        same = F.sha2(F.concat_ws("|", "conv", F.col("gone").cast("string"), F.length("role").cast("string"), "role", "text_sha"), 256)
        trimmed = F.rtrim("text", F.lit(" \t\n\x0b\f\r"))
        fault = F.when(trimmed == "", BLANK_ROW).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(SOUND)
        initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS[:3])], F.lit(3))
        seen = self.staging.table(self.placed.select("conv", "gone", "row", same.alias("same"), fault.alias("fault"), initial.alias("initial")), "faults")
        often = self.staging.table(seen.groupBy("same").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"), "often")
        judged = join_groups(seen, often, ["same"], "n")
        final = F.when((F.col("fault") != BLANK_ROW) & (F.col("row") > F.col("first")), SEEN).otherwise(F.col("fault"))
        code = F.char(F.lit(65) + 4 * F.col("initial") + final)
        in_order = F.array_sort(F.collect_list(F.struct("row", code.alias("code"))))
        stretches = judged.groupBy("conv", "gone", _stretch("row").alias("stretch")).agg(in_order.alias("rows"))
        return stretches.select("conv", "gone", "stretch", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"))

    def _planned(self, coded: DataFrame) -> DataFrame:
        summed = coded.mapInPandas(_summaries, _SUMMARY)
        one = F.struct("stretch", "first", "last", "table", *_FAULTS)
        return summed.groupBy("conv", "gone").agg(F.array_sort(F.collect_list(one)).alias("stretches")).mapInPandas(_plans, _PLAN)

    def _stretches(self) -> DataFrame:
        """Edits and rows of each stretch, in order."""
        one = F.struct("row", "conv_id", "turn", "role", "text")
        rows = self.placed.groupBy("conv", "gone", _stretch("row").alias("stretch")).agg(F.array_sort(F.collect_list(one)).alias("rows"))
        return rows.join(self.edits, ["conv", "gone", "stretch"])

    def rows(self) -> DataFrame:
        """(conv_id, place, edit, turn, role, text): the repaired rows in order, ``edit`` K, R or I; inserted ones have no turn.

        ``place`` orders the rows of a conversation, with gaps."""
        lines = F.flatten(F.zip_with("rows", "roles", _new_rows))
        out = self._stretches().select(F.posexplode(F.concat(lines, _tail(F.element_at("rows", -1)))).alias("k", "r"), "stretch")
        return out.select("r.conv_id", (F.shiftleft("stretch", STRETCH_BITS + 2) + F.col("k")).alias("place"), "r.edit", "r.turn", "r.role", "r.text")

    def report(self) -> DataFrame:
        """(conv_id, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with rows."""
        line = lambda r: F.concat(r["role"], F.lit(":"), r["text"])
        lines = F.transform(F.concat(F.flatten(F.zip_with("rows", "roles", _new_rows)), _tail(F.element_at("rows", -1))), line)
        audit = F.concat(F.array_join("audits", ""), F.translate(_ending(), "ua", "II"))
        pieces = self._stretches().select("conv", "gone", "stretch", "final", *_FAULTS, "cost", lines.alias("lines"), audit.alias("audit"))
        pieces = pieces.withColumn("n_lines", F.size("lines")).withColumn("piece", F.array_join("lines", "\n")).drop("lines")
        schema = "conv string, gone boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
        found = pieces.repartition("conv", "gone").sortWithinPartitions("conv", "gone", "stretch").mapInPandas(_digests, schema)
        kind = self.placed.schema["conv_id"].dataType
        return found.select(F.when(~F.col("gone"), F.col("conv").cast(kind)).alias("conv_id"), *_FAULTS, "cost", "audit", "repaired_sha256")


def _stretch(row: str) -> Column:
    return F.shiftright(row, STRETCH_BITS)


def _made(initial: Column, like: Column) -> Column:
    role = F.when(initial == "u", "user").otherwise("assistant")
    return F.struct(like["conv_id"].alias("conv_id"), F.nullif(like["turn"], like["turn"]).alias("turn"), role.alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"))


def _new_rows(row: Column, roles: Column) -> Column:
    """What a row becomes: the rows inserted before it, then itself if it stays; ``roles`` has an initial for each, ``=`` for its own, ``-`` for none."""
    last, before = F.substring(roles, -1, 1), F.substring(roles, F.lit(1), F.length(roles) - 1)
    kept = F.struct(
        row["conv_id"].alias("conv_id"), row["turn"].alias("turn"), F.when(last == "=", row["role"]).when(last == "u", "user").otherwise("assistant").alias("role"), row["text"].alias("text"), F.when(last == "=", "K").otherwise("R").alias("edit")
    )
    inserted = F.transform(F.filter(F.split(before, ""), lambda c: c != ""), lambda c: _made(c, row))
    return F.when(last == "-", inserted).otherwise(F.concat(inserted, F.array(kept)))


def _ending() -> Column:
    """Initials of what is inserted behind a stretch: only behind the last one."""
    return F.when(F.col("final"), F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), F.col("behind") + 1)).otherwise("")


def _tail(like: Column) -> Column:
    """The rows inserted behind the last one."""
    return F.transform(F.filter(F.split(_ending(), ""), lambda c: c != ""), lambda c: _made(c, like))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; nulls one space) with known defects, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it a user's; others stay.
    """
    null = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), null), F.lit(":"), F.coalesce(F.col("turn").cast("string"), null))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", null), F.coalesce("text", null)
    hit = rows.select("conv_id", "turn", kind.alias("kind"), role.alias("role"), text.alias("text")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    hit = hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(times).alias("copy"))
    return hit.drop("copy")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns missing between the first and the last one of each conversation; nulls are left out."""
    counted = rows.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.count_distinct("turn").alias("n"))
    return counted.select("conv_id", F.coalesce(F.col("b") - F.col("a") + 1 - F.col("n"), F.lit(0)).cast("long").alias("gaps"))


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Each conv_id of ``rows`` with what :func:`damage` did to it and the cheapest repair; zeros and empty texts where no row is left."""
    damaged = damage(rows)
    report = Repair(damaged).report()
    every = rows.select("conv_id").distinct()
    same = lambda df, name: df.withColumnRenamed("conv_id", name)
    joined = every.join(same(gaps(damaged), "g"), F.col("conv_id").eqNullSafe(F.col("g")), "left").join(same(report, "r"), F.col("conv_id").eqNullSafe(F.col("r")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_FAULTS, "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
