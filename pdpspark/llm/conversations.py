"""Repair of conversation structure at least cost, over an automaton that shares the ends of all conversations.

A conversation's signature has one letter a turn: role and fault. Signatures that end alike share these ends: read backwards and minimised,
all signatures of the table are one acyclic word graph, whose nodes are their different ends. Each node holds, for each state of the role
grammar (s?(ua)+)?, the least cost from there to the end and the first edit of the best way, ASCII-least among equals; the rest of the way
is the next node's. So a node is solved once, however many conversations end so. Spark deals different signatures by ranges of their
reversed form; in that order a task holds no more than one way through the graph, and only the way at a range's edge is solved twice.

The plans are cut into blocks of turns that meet the turns by an equi-join; no conversation is ever one array of turns. A signature is one
byte a turn, and a conversation's order is that of one sorted, spilling window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; a truncated turn that stays adds its own.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the grammar: nothing yet, after s, after u, after a. What a kept role leads to; what an inserted or changed one leads to.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
WANTED = (2, 2, 3, 2)
FINAL = (0, 3)
ROLE = {2: "u", 3: "a"}
#: Turns whose plan is one string.
BLOCK = 4096
NO_WAY = (1 << 60, "", 0)

Node = tuple[tuple[int, str, int], ...]


# -- the word graph --------------------------------------------------------------------------------------------------------------

def _with_inserts(best: list[tuple[int, str, int]]) -> Node:
    """For each state the least of its own way and of those that insert a turn first; two inserts in a row are all that can pay."""
    for _ in range(2):
        for state, to in enumerate(WANTED):
            best[state] = min(best[state], (best[to][0] + INSERT, "I", to), key=lambda way: way[:2])
    return tuple(best)


END: Node = _with_inserts([(0, "", 0) if state in FINAL else NO_WAY for state in range(4)])


def node(letter: str, rest: Node) -> Node:
    """(cost to the end, first edit, state after it) by state, for a turn of this letter before the end rest."""
    best = []
    for state in range(4):
        ways = [(rest[state][0] + DELETE, "D", state)]
        if letter != "x":
            extra = TRUNCATED if letter.isupper() else 0
            to = KEPT.get((letter.lower(), state))
            if to is not None:
                ways.append((rest[to][0] + extra, "K", to))
            ways.append((rest[WANTED[state]][0] + REROLE + extra, "R", WANTED[state]))
        best.append(min(ways))
    return _with_inserts(best)


def way(path: list[Node]) -> tuple[int, str, list[str], str]:
    """Cost, audit, for each turn its plan (two places for roles inserted before it, then K, D, or the new role's capital), roles at the end."""
    cost, state, audit, steps, waiting = path[-1][0][0], 0, [], [], ""
    for at in reversed(path):
        while True:
            _, edit, to = at[state]
            audit.append(edit)
            if edit != "I":
                break
            waiting, state = waiting + ROLE[to], to
        if edit:
            steps.append(waiting.ljust(2, "-") + (ROLE[to].upper() if edit == "R" else edit))
            waiting, state = "", to
    return cost, "".join(audit), steps, waiting


def plans(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit, pieces (plans of BLOCK turns each), tail: for each row of signatures, which are different."""
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, before = [END], ""
        for pdf in batches:
            rows = []
            for signature in pdf["signature"]:
                ending = signature[::-1]
                shared = next((i for i, (a, b) in enumerate(zip(ending, before)) if a != b), min(len(ending), len(before)))
                del path[shared + 1 :]
                for letter in ending[shared:]:
                    path.append(node(letter, path[-1]))
                before = ending
                cost, audit, steps, tail = way(path)
                rows.append((signature, cost, audit, ["".join(steps[i : i + BLOCK]) for i in range(0, len(steps), BLOCK)], tail))
            yield pd.DataFrame(rows, columns=["signature", "cost", "audit", "pieces", "tail"])

    ordered = signatures.select("signature", F.reverse("signature").alias("ending")).repartitionByRange("ending").sortWithinPartitions("ending")
    return ordered.select("signature").mapInPandas(solve, "signature string, cost long, audit string, pieces array<string>, tail string")


# -- turns -----------------------------------------------------------------------------------------------------------------------

def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, initial, pos, fault, letter, illegal, fresh (a turn number not seen before in the conversation)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    base = rows.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("initial", F.substring("role", 1, 1))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.lag("initial").over(order)
    placed = base.select(
        "*", F.row_number().over(order).alias("pos"),
        F.coalesce(before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(order))).alias("fresh"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("pos")) > 1
    body = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", "")
    last = F.substring(body, -1, 1)
    fault = F.when(body == "", "blank").when(F.col("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return placed.withColumn("again", again).withColumn("fault", fault).withColumn("letter", letter).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("int"))


def _spelled(at: str, value: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value]), "")


def _reports(turns: DataFrame) -> DataFrame:
    """One row a conversation: counts and signature. Blocks first, so that no array is longer than a block or the number of blocks."""
    count = lambda when: F.count_if(when)
    faults = ("blank", "duplicate", "truncated")
    blocks = turns.groupBy("conv_id", "block").agg(
        _spelled("pos", "letter").alias("part"), F.min("turn").alias("low"), F.max("turn").alias("high"), count(F.col("fresh")).alias("distinct"),
        *[count(F.col("fault") == f).alias(f) for f in faults], count(F.col("illegal")).alias("illegal"))
    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("distinct"), F.lit(0)).cast("long")
    return blocks.groupBy("conv_id").agg(_spelled("block", "part").alias("signature"), gaps.alias("gaps"), *[F.sum(f).alias(f) for f in (*faults, "illegal")])


def _full_role(letter: Column) -> Column:
    return F.when(F.lower(letter) == "u", "user").when(F.lower(letter) == "a", "assistant")


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reports and repaired turns of conversations (rows: conv_id, turn, role, text).

    Reports: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv_id, pos and sub (their order),
    edit (K, R or I), role, text. A conversation's rows are ordered by turn, nulls first, then by role and text; rows alike in all of these
    can change places without any difference. Null role or text is one space, a null conv_id a conversation of its own. A turn's first fault
    counts: blank (no character but white space), duplicate (role and text of an earlier turn), truncated (last one that is no white space is
    not . ! or ?). Keeping costs 0, a new role 1, deleting 2, inserting 5; a truncated turn that stays 5 more; blank and duplicate turns have to
    go. gaps: numbers missing between the smallest and largest turn; illegal: neighbours whose initials are not su, ua or au. An empty table
    gives no rows; other columns are not read.
    """
    turns = _turns(rows)
    reports = _reports(turns)
    solved = reports.join(plans(reports.select("signature").distinct()), "signature")
    pieces = solved.select(F.col("conv_id").alias("of"), F.posexplode("pieces").alias("at", "piece"))
    own = turns.join(pieces, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    plan = F.substring("piece", 3 * F.pmod(F.col("pos") - 1, F.lit(BLOCK)) + 1, 3)
    own = own.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "text", plan.alias("plan"))
    place = lambda i: F.substring("plan", i, 1)
    line = lambda sub, edit, role, text: F.struct(F.lit(sub).alias("sub"), edit.alias("edit"), role.alias("role"), text.alias("text"))
    inserted = lambda sub, letter: line(sub, F.lit("I"), _full_role(letter), F.lit(""))
    stays = line(2, F.when(place(3) == "K", "K").otherwise("R"), F.when(place(3) == "K", F.col("role")).otherwise(_full_role(place(3))), F.col("text"))
    lines = F.filter(F.array(inserted(0, place(1)), inserted(1, place(2)), stays), lambda x: x["role"].isNotNull())
    ends = F.filter(F.array(inserted(3, F.substring("tail", 1, 1)), inserted(4, F.substring("tail", 2, 1))), lambda x: x["role"].isNotNull())
    after = solved.where("tail <> ''").select("conv_id", F.length("signature").cast("long").alias("pos"), F.explode(ends).alias("x"))
    fixed = own.select("conv_id", "pos", F.explode(lines).alias("x")).unionByName(after).select("conv_id", "pos", "x.*")
    return solved.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), fixed


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the lines role:text in order, joined by line feeds; turns stream by, none is kept."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, begun = None, None, False
        for batch in batches:
            ids, out = batch.column("conv_id"), []
            for conv, line in zip(ids.to_pylist(), batch.column("line").to_pylist(), strict=True):
                if not begun or conv != current:
                    if begun:
                        out.append((current, state.hexdigest()))
                    state, current, begun = hashlib.sha256(line.encode("utf-8")), conv, True
                else:
                    state.update(b"\n" + line.encode("utf-8"))
            kind_of = ids.type
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind_of), pa.array([h for _, h in out], pa.string())], ["conv_id", "sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind_of), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    lines = turns.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub").select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, sha256 string")
