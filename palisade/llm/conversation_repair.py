"""Repair of conversation structure by secondary-sorted streaming.

Rows are dealt by conversation once.  In each partition Spark sorts them three times, which spills and needs no further
shuffle: by role and text, to number repeated turns; by turn backwards; by turn forwards.

* **Backwards** a dynamic programme over four states (nothing yet, after a system turn, after a user turn, after an
  assistant turn) is carried from Arrow batch to Arrow batch.  Per row and state it keeps the edit to take there: four
  times two bits, one byte per row.  These backpointers stay with their rows, so that Spark's sort spills them; a task
  holds four numbers, however long a conversation is.
* **Forwards** the edits are read off the backpointers, again carried over batches.

Edits: K keeps a turn (0), R changes its role to user or assistant (2), D deletes it (3), I inserts an empty turn (2).
Blank and repeated turns must go; a truncated one that stays costs 1 more.  What is left has the role initials ``(s?(ua)+)?``.  The
cheapest edits are taken, and of those the ones whose letters come first.  A state and a letter lead to one next state, and
equally cheap edits of one stretch are never the beginning of one another, so choosing the least letter step by step is exact.
"""

from __future__ import annotations

import hashlib
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm import base

LETTERS = "DIKR"
COSTS = {"D": 3, "I": 2, "K": 0, "R": 2}
#: States: nothing yet, after system, user, assistant.  A turn of the writer's choice leads to:
CHOSEN = (2, 2, 3, 2)
#: What a kept turn leads to, by the initial of its role; other pairs are not allowed.
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Cost of the turns to be inserted behind the last row.
CLOSING = (0, 4, 2, 0)
NAMES = {2: "user", 3: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
EDITS = "conv string, turn string, role string, text string, fault string, edit string, new_role string"
SUMMARY = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def fault() -> Column:
    """The first fault of a row: blank, duplicate (an earlier turn has the same role and text), truncated, or none.

    ``nth`` counts the conversation's rows with this role and text.
    """
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    return (F.when(end == "", "blank").when(F.col("nth") > 1, "duplicate")
            .when(~end.isin(".", "!", "?"), "truncated").otherwise(""))


def step(initial: str, what: str, cost: tuple) -> tuple[tuple, int]:
    """Costs to the end from before a row, given those from behind it, and the best edit by state (two bits each)."""
    extra, may_stay = int(what == "truncated"), what in ("", "truncated")
    options = []
    for s in range(4):
        own = {"D": COSTS["D"] + cost[s]}
        if may_stay:
            own["R"] = COSTS["R"] + extra + cost[CHOSEN[s]]
            if (initial, s) in KEPT:
                own["K"] = extra + cost[KEPT[initial, s]]
        options.append(own)
    total = [min(own.values()) for own in options]
    for _ in range(3):  # no more insertions in a row can lead to another state
        total = [min(total[s], COSTS["I"] + total[CHOSEN[s]]) for s in range(4)]
    best = 0
    for s in range(4):
        options[s]["I"] = COSTS["I"] + total[CHOSEN[s]]
        best |= next(k for k, x in enumerate(LETTERS) if options[s].get(x) == total[s]) << 2 * s
    least = min(total)
    return tuple(t - least for t in total), best


def _backwards(frames):
    """Adds the backpointers; rows come from the last turn to the first."""
    conv, cost, known = object(), CLOSING, {}
    for frame in frames:
        best = []
        for key, role, what in zip(frame["conv"], frame["role"], frame["fault"]):
            if key != conv:
                conv, cost = key, CLOSING
            state = (role[:1] if role[:1] in ("s", "u", "a") else "", what, cost)
            if state not in known:  # costs are relative to the least, so there are few of them
                known[state] = step(*state)
            cost, letters = known[state]
            best.append(letters)
        yield frame.assign(best=best)


def _forwards(frames):
    """The edits in their order; rows come from the first turn to the last."""
    conv, s = object(), 0

    def inserted(out):
        nonlocal s
        s = CHOSEN[s]
        out.append((conv, None, None, "", "", "I", NAMES[s]))

    def closed(out):
        while CLOSING[s]:
            inserted(out)

    names = [c.split()[0] for c in EDITS.split(", ")]
    for frame in frames:
        out = []
        for key, turn, role, text, what, best in frame[["conv", "turn", "role", "text", "fault", "best"]].itertuples(index=False, name=None):
            if key != conv:
                closed(out)
                conv, s = key, 0
            while (letter := LETTERS[best >> 2 * s & 3]) == "I":
                inserted(out)
            new = None
            if letter == "R":
                s = CHOSEN[s]
                new = NAMES[s]
            elif letter == "K":
                s, new = KEPT[role[:1], s], role
            out.append((key, turn, role, text, what, letter, new))
        yield pd.DataFrame(out, columns=names)
    out = []
    closed(out)
    if out:
        yield pd.DataFrame(out, columns=names)


class _Tally:
    """What is known of one conversation so far."""

    def __init__(self, conv):
        self.conv, self.faults, self.illegal, self.cost = conv, {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}, 0, 0
        self.first = self.last = self.before = None
        self.distinct, self.audit, self.digest, self.any = 0, bytearray(), hashlib.sha256(), False

    def add(self, turn, role, text, what, letter, new):
        self.audit += letter.encode()
        self.cost += COSTS[letter] + (what == "truncated" and letter != "D")
        if letter != "I":
            self.faults[what] += 1
            initial = role[:1]
            self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
            self.before = initial
            if turn is not None:
                turn = int(turn)
                self.first = turn if self.first is None else self.first
                self.distinct += turn != self.last
                self.last = turn
        if new is not None:
            self.digest.update((("\n" if self.any else "") + new + ":" + text).encode())
            self.any = True

    def row(self):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv, gaps, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal, self.cost,
                self.audit.decode(), self.digest.hexdigest())


def _tallies(frames):
    now, names = None, [c.split()[0] for c in SUMMARY.split(", ")]
    for frame in frames:
        done = []
        for key, *row in frame.itertuples(index=False, name=None):
            if now is None or key != now.conv:
                done += [now.row()] if now else []
                now = _Tally(key)
            now.add(*row)
        yield pd.DataFrame(done, columns=names)
    if now:
        yield pd.DataFrame([now.row()], columns=names)


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _id(conversations: DataFrame) -> Column:
    return F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(conversations.schema["conv_id"].dataType).alias("conv_id")


def _edits(conversations: DataFrame) -> DataFrame:
    turn = F.col("turn").cast("long")
    rows = base.only(conversations, "conv_id", "turn", "role", "text").select(
        _key().alias("conv"), turn.alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv")
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(turn.asc_nulls_first()))
    rows = rows.withColumn("nth", nth).withColumn("fault", fault()).withColumn("turn", F.col("turn").cast("string"))
    schema = "conv string, turn string, role string, text string, nth int, fault string"
    by_turn = [turn.asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), F.col("nth").asc()]
    backwards = [turn.desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("nth").desc()]
    pointed = rows.sortWithinPartitions("conv", *backwards).mapInPandas(_backwards, f"{schema}, best int")
    return pointed.sortWithinPartitions("conv", *by_turn).mapInPandas(_forwards, EDITS)


def edits(conversations: DataFrame) -> DataFrame:
    """One row per edit: conv_id, turn, role, text, fault, edit, new_role; a conversation's edits stand in order in one partition.

    ``new_role`` is null where the turn goes; an inserted turn has no turn number and no role of its own, and an empty text.
    Rows of one turn go by role, text; a null turn comes first; a null role or text counts as one space; rows without a
    ``conv_id`` (any type) form one conversation.  Equal rows are repeated turns.  Other
    columns, whatever their names, are not read; an empty table gives an empty one.  A long text is one value of its row.
    """
    return _edits(conversations).select(_id(conversations), F.col("turn").cast("long").alias("turn"), "role", "text", "fault", "edit",
                                        "new_role")


def repaired(conversations: DataFrame) -> DataFrame:
    """The turns that stay, renumbered from 0: conv_id, turn, role, text."""
    kept = edits(conversations).where("new_role IS NOT NULL").withColumn("_at", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("_at")) - 1
    return kept.select("conv_id", number.cast("long").alias("turn"), F.col("new_role").alias("role"), "text")


def summary(conversations: DataFrame) -> DataFrame:
    """One row per conversation: gaps in its turn numbers, rows by first fault, illegal neighbours (role initials not su, ua or
    au), cost and letters of the edits, and the SHA-256 of the repaired ``role:text`` lines.  Nulls and ties: see ``edits``."""
    rows = _edits(conversations).mapInPandas(_tallies, SUMMARY)
    return rows.select(_id(conversations), *[c.split()[0] for c in SUMMARY.split(", ")[1:]])


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by crc32(``conv_id:turn``) modulo 20, nulls as one space: 0 drops the row, 1 empties its text, 2
    takes its ``.!?`` away, 3 repeats it, 4 makes it the user's."""
    rows = base.only(conversations, "conv_id", "turn", "role", "text")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("_how", F.crc32(F.concat_ws(":", *text).cast("binary")) % 20).where("_how <> 0")
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("_how") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    copies = F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op12(spark, sf_dir):
    rows = base.table(spark, sf_dir, "conversations")
    found = summary(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
