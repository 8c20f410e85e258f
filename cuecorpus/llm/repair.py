"""Repair of damaged conversations by a lightest derivation.

A repaired conversation is derived from the rows: an item says that the rows up to a place have been edited and leave the
conversation in a state (empty, after a system, a user or an assistant turn). A deduction joins an item with an edit of the
next row, or with an inserted row, to a new item. The weight of an item is (cost, audit), compared in that order; both edits
and insertions only ever lengthen an audit and never lower a cost, and of two derivations of one item with equal costs
neither audit begins with the other, as both hold a letter for each row and an insertion costs something. So the weights are
monotone and superior, and an agenda that pops the lightest item first finalises each item at its least weight.

Conversations are cut into pieces of at most PIECE rows, whatever their length. A piece yields, for each state before it, the
lightest edits to each state after it; adjoining pieces are again antecedents of deductions, with the same agenda, and groups of
FAN pieces are joined until a conversation is one. A piece that holds a whole conversation stops at its goal.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuecorpus.llm.spread import join_spread
from cuecorpus.llm.workspace import staged

#: Rows of a piece, as a power of two, and pieces joined at once.
PIECE_BITS, FAN = 8, 64
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in the first or last.
STATES, GOALS = (0, 1, 2, 3), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {2: "user", 3: "assistant"}
#: Inserted rows by the state before: the state after, the cost and the letter.
INSERTS = {p: [(q, INSERT, "I") for (a, c), q in STEP.items() if a == p and c != "s"] for p in STATES}
NO_INSERTS: dict = {p: [] for p in STATES}

ITEMS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
RUNS = "array<struct<first:long,n:long>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
PIECE = f"conv_id long, place long, items {ITEMS}, runs {RUNS}, {', '.join(f'{c} long' for c in COUNTS)}, first_initial string, last_initial string, first_turn long, last_turn long"


class Repaired(NamedTuple):
    #: One row a conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``.
    verdicts: DataFrame
    #: The repaired rows: ``conv_id``, ``at`` and ``sub`` (their order), ``edit``, ``turn`` (null if inserted), ``role``, ``text``.
    rows: DataFrame


def lightest(units: list[dict], inserts: dict, entry: int, exits: tuple, every: bool) -> dict[int, tuple[int, str]]:
    """The lightest derivations from ``entry`` over all units to ``exits``: to each of them, or to the lightest only.

    ``units[i][p]`` lists (state after, cost, letters) of unit i where the state before is p.
    """
    agenda, final, found = [(0, "", 0, entry)], set(), {}
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == len(units) and state in exits:
            found[state] = (cost, audit)
            if not every or len(found) == len(exits):
                break
        steps = units[i].get(state, ()) if i < len(units) else ()
        for ahead, edits in ((1, steps), (0, inserts[state])):
            for after, more, letters in edits:
                if (i + ahead, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letters, i + ahead, after))
    return found


def _unit(initial: str, unusable: bool, truncated: bool) -> dict:
    """The edits of one row by the state before it."""
    more = TRUNCATED if truncated else 0
    out: dict = {p: [(p, DELETE, "D")] for p in STATES}
    if not unusable:
        for (p, c), q in STEP.items():
            if c == initial:
                out[p].append((q, KEEP + more, "K"))
            if c != "s":
                out[p].append((q, REROLE + more, "R"))
    return out


def _table(units: list[dict], inserts: dict, whole: bool) -> list[dict]:
    """The lightest items over ``units``: of every pair of states, or of the goal where the units are a whole conversation."""
    if whole:
        return [{"entry": 0, "exit": q, "cost": c, "audit": a} for q, (c, a) in lightest(units, inserts, 0, GOALS, False).items()]
    return [{"entry": p, "exit": q, "cost": c, "audit": a} for p in STATES for q, (c, a) in lightest(units, inserts, p, STATES, True).items()]


def _legal(left: str, right: str) -> bool:
    return left + right in ("su", "ua", "au")


def _pieces(group: pa.Table) -> pa.Table:
    """One piece for each conversation among the rows of one range of places."""
    rows = sorted(group.to_pylist(), key=lambda r: r["at"])
    out, start = [], 0
    for end in range(1, len(rows) + 1):
        if end < len(rows) and rows[end]["conv_id"] == rows[start]["conv_id"]:
            continue
        own = rows[start:end]
        units, piece = [], dict.fromkeys(COUNTS, 0)
        turn = None
        for k, r in enumerate(own):
            blank = r["blank"]
            copy = not blank and r["at"] > r["first"]
            cut = not blank and not copy and r["cut"]
            units.append(_unit(r["initial"], blank or copy, cut))
            for name, on in (("blank", blank), ("duplicate", copy), ("truncated", cut), ("illegal", k and not _legal(own[k - 1]["initial"], r["initial"])), ("turns", r["turn"] is not None and r["turn"] != turn)):
                piece[name] += bool(on)
            turn = r["turn"] if r["turn"] is not None else turn
        turns = [r["turn"] for r in own if r["turn"] is not None]
        out.append(
            piece
            | {"conv_id": own[0]["conv_id"], "place": own[0]["at"], "items": _table(units, INSERTS, 0 < start and end < len(rows)), "runs": [{"first": own[0]["at"], "n": len(own)}]}
            | {"first_initial": own[0]["initial"], "last_initial": own[-1]["initial"], "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}
        )
        start = end
    return _as_table(out)


def _joined(group: pa.Table) -> pa.Table:
    """Adjoining pieces of one conversation as one."""
    pieces = sorted(group.to_pylist(), key=lambda r: r["place"])
    if len(pieces) == 1:
        return _as_table([pieces[0] | {"place": pieces[0]["group"]}])
    units = []
    for p in pieces:
        unit: dict = {}
        for x in p["items"]:
            unit.setdefault(x["entry"], []).append((x["exit"], x["cost"], x["audit"]))
        units.append(unit)
    out = {c: sum(p[c] for p in pieces) for c in COUNTS}
    turn = None
    for left, right in zip(pieces, pieces[1:], strict=False):
        out["illegal"] += not _legal(left["last_initial"], right["first_initial"])
        turn = left["last_turn"] if left["last_turn"] is not None else turn
        # A turn that a cut parts is counted on both sides.
        out["turns"] -= turn is not None and turn == right["first_turn"]
    out |= {"conv_id": pieces[0]["conv_id"], "place": pieces[0]["group"], "items": _table(units, NO_INSERTS, False), "runs": [r for p in pieces for r in p["runs"]]}
    turns = [p[c] for p in pieces for c in ("first_turn", "last_turn") if p[c] is not None]
    return _as_table([out | {"first_initial": pieces[0]["first_initial"], "last_initial": pieces[-1]["last_initial"], "first_turn": min(turns, default=None), "last_turn": max(turns, default=None)}])


def _as_table(rows: list[dict]) -> pa.Table:
    text, number = pa.string(), pa.int64()
    item = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", number), ("audit", text)])
    kinds = {"conv_id": number, "place": number, "items": pa.list_(item), "runs": pa.list_(pa.struct([("first", number), ("n", number)])), **dict.fromkeys(COUNTS, number)}
    kinds |= {"first_initial": text, "last_initial": text, "first_turn": number, "last_turn": number}
    return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn that stays: the place of the row it comes from, or of the row it is inserted after."""
    names, kinds = ["conv_id", "at", "sub", "edit", "new_role"], [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def flush(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in enumerate(kinds)], names=names)

    for batch in batches:
        out: list = []
        for conv, audit, runs in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            places = (x for r in runs for x in range(r["first"], r["first"] + r["n"]))
            # Inserted rows before the first one stand at its place, with numbers below 0.
            at, sub = runs[0]["first"], len(audit.lstrip("I")) - len(audit) - 1
            # Turns that stay alternate and end with the assistant's, so an odd number of them starts with a system turn.
            user = (len(audit) - audit.count("D")) % 2 == 0
            for letter in audit:
                if letter == "I":
                    sub += 1
                else:
                    at, sub = next(places), 0
                    if letter == "D":
                        continue
                out.append((conv, at, sub, letter, None if letter == "K" else "user" if user else "assistant"))
                user = not user
                if len(out) >= 100_000:
                    yield flush(out)
                    out = []
        yield flush(out)


def repair_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    """The cheapest edits that make each conversation's roles an optional system turn and one or more pairs of user and assistant,
    or nothing at all; of equally cheap ones those whose letters come first as ASCII text.

    Rows stand by turn, nulls first; rows of one turn by a digest of role and text. A row's first fault counts: blank (no
    character but space and tab to carriage return), duplicate (role and text stood earlier in the conversation), truncated
    (its last other character is none of ``.!?``). Keeping a row costs nothing, a new role 1, a deletion 2, an inserted row
    without text 5; truncated rows that stay cost 5 more; blank and duplicate rows must go. ``gaps`` counts the turns missing
    between the least and the greatest one, ``illegal`` the neighbours whose first letters of roles aren't su, ua or au.

    A null role or text is one space. Rows with a null conversation id are one conversation. Repeated rows are duplicates.
    Texts may be empty or of any length; they never pass through the search, which sees flags only. Conversations of any
    length are cut into pieces, so none is one task's. Without rows both tables are empty. Extra columns are ignored.
    """
    own = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    given = rows.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), own(role).alias("role"), own(text).alias("text"))
    marked = given.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text")), 256))
    # The last key only parts rows that are alike, so that copies don't meet in one range.
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "digest")]
    dealt = marked.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*order, "_copy").sortWithinPartitions(*order).drop("_copy")
    placed = staged(dealt.withColumn("at", F.monotonically_increasing_id()), "repair-rows")

    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    who = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "digest"), 256)
    flags = staged(placed.select("conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), who.alias("who")), "repair-flags")
    first = flags.groupBy("who").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    known = join_spread(flags, first.select("who", "first"), "who", "at", counts=first.select("who", "n")).drop("who")
    piece = F.shiftright("at", PIECE_BITS)
    pieces = staged(known.groupBy(piece).applyInArrow(_pieces, PIECE), "repair-pieces")

    own = W.partitionBy("conv_id")
    numbered = staged(pieces.withColumns({"place": F.row_number().over(own.orderBy("place")).cast("long") - 1, "_pieces": F.count(F.lit(1)).over(own)}), "repair-numbered")
    # Nearly all conversations are one piece, and have nothing to join.
    done, numbered = numbered.where("_pieces = 1").drop("_pieces"), numbered.where("_pieces > 1").drop("_pieces")
    last = numbered.agg(F.max("place")).first()[0] or 0
    while last:
        last //= FAN
        grouped = numbered.withColumn("group", F.floor(F.col("place") / FAN))
        numbered = staged(grouped.groupBy("conv_id", "group").applyInArrow(_joined, PIECE), "repair-joined")
    numbered = numbered.unionByName(done)
    ways = F.filter("items", lambda x: (x["entry"] == 0) & x["exit"].isin(*GOALS))
    best = F.array_min(F.transform(ways, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0).cast("long"))
    verdicts = staged(numbered.withColumn("best", best).select("conv_id", gaps.alias("gaps"), *COUNTS[:-1], "best.cost", "best.audit", "runs"), "repair-verdicts")
    return Repaired(verdicts.drop("runs"), _rows(verdicts, placed))


def _rows(verdicts: DataFrame, placed: DataFrame) -> DataFrame:
    edits = verdicts.select("conv_id", "audit", "runs").mapInArrow(_edits, "conv_id long, at long, sub int, edit string, new_role string")
    source = placed.select(F.col("at").alias("_at"), "turn", "role", "text")
    joined = edits.join(source, (F.col("at") == F.col("_at")) & (F.col("edit") != "I"), "left")
    return joined.select("conv_id", "at", "sub", "edit", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose rows come in order; a running digest is all that is held."""
    conv, state, begun = None, None, False

    def row(values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values], pa.string())], names=["conv_id", "sha256"])

    for batch in batches:
        out = []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append((conv, state.hexdigest()))
                conv, state, begun = c, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(line.as_buffer())
        yield row(out)
    if begun:
        yield row([(conv, state.hexdigest())])


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``sha256``: of each conversation's repaired rows as ``role:text``, joined by newlines.

    A digest is made in order by its nature, so one task streams a conversation's rows; it holds no more than a batch.
    Conversations without rows have none.
    """
    line = F.concat("role", F.lit(":"), "text").cast("binary").alias("line")
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "sub").select("conv_id", line)
    return sorted_rows.mapInArrow(_hashed, "conv_id long, sha256 string")
