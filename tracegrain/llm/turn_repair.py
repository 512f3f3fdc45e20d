"""Repair of conversations whose turns were damaged: the cheapest edits that give `(system? (user assistant)+)?`.

Rows are numbered in their conversation without a task that holds it (operators/ordered.py) and cut into blocks of BLOCK rows. Blocks are dealt by
hash, and a batch of whole blocks goes to one recursive DuckDB query: each step of the recursion advances one turn in all of them, and keeps for each state of the
grammar in which a block may begin and end the least cost with its audit. Blocks of one conversation are joined in the same way, FAN at a time, until one
row of states is left; so a conversation of any length is worked on in many tasks. Every edit of a row adds a letter of its own, so of two audits of equal cost neither
begins the other, and the ASCII-least one of a block is part of the ASCII-least one of the whole.

The audit then meets the rows again, in one pass that shuffles texts once; the SHA-256 of a repaired conversation runs along its rows in one task, row by row.

Cases: null ids, turns, roles and texts read as one space; rows without a conversation's id are one conversation, whose id is null. Rows are ordered by turn,
null first, and by the digest of role and text where turns are equal. Rows that repeat are duplicates. A conversation without rows after damage has zeros,
an empty audit and the hash of the empty string. Columns other than these four play no part, whatever their names. An empty table has no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrain.operators.ordered import running, runs

from .shared import cut

#: Rows of a block, blocks that one step joins, rows that one query of DuckDB takes at least.
BLOCK, FAN, BATCH = 256, 256, 1 << 14
WHITE = " \t\n\x0b\f\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Of each: the states that a role's initial leads to.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Inserts that bring a state to an end.
TO_END = {0: 0, 1: 2, 2: 1, 3: 0}


def inserted(state: int) -> tuple[str, int]:
    """The role that can be inserted in a state, and the state after it."""
    role = "a" if state == 2 else "u"
    return role, NEXT[state][role]


def moves() -> list[tuple]:
    """(state, letters, cost, whether the row stays, the initial that it needs, state after) of all ways to deal with one row.

    Two inserts lead from any state to any other, and what is inserted before a deleted row can as well follow it.
    """
    out = []
    for state in NEXT:
        out.append((state, "D", DELETE, False, None, state))
        now = state
        for n in range(3):
            for initial, to in NEXT[now].items():
                out.append((state, "I" * n + "K", INSERT * n + KEEP, True, initial, to))
                if initial != "s":
                    out.append((state, "I" * n + "R", INSERT * n + REROLE, True, None, to))
            now = inserted(now)[1]
    return out


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """key (the id as text), turn, role, text: without the rows of fault 0, texts emptied (1) or without their ends of sentences (2), rows twice (3), roles set (4)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(spaced(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), F.pmod(F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")), F.lit(20)).alias("fault"))
    rows = rows.where("fault != 0").select(
        "key", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), "fault",
    )
    return rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def _told(rows: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    sixty = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return rows.withColumns({"r1": sixty(1), "r2": sixty(16)})


_ORDER = ("r1", "r2")


def faults(rows: DataFrame) -> DataFrame:
    """key, turn, n, initial, prev_initial, blank, duplicate, truncated: each row's first fault alone is true."""
    text = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = _told(rows).select("key", "turn", "r1", "r2", F.substring("role", 1, 1).alias("initial"), (text == "").alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("open"))
    numbered = running(narrow, ["key"], [F.col("turn").asc_nulls_first(), *map(F.col, _ORDER)], previous=["initial"])
    first = numbered.groupBy("key", "r1", "r2").agg(F.min("n").alias("first"))
    out = numbered.join(first, ["key", "r1", "r2"]).withColumn("duplicate", ~F.col("blank") & (F.col("n") > F.col("first")))
    return out.select("key", "turn", "n", "initial", "prev_initial", "blank", "duplicate", (~F.col("blank") & ~F.col("duplicate") & F.col("open")).alias("truncated"))


_STEP = """
    WITH RECURSIVE way AS (
        SELECT u, 0 AS i, state AS entry, state, 0::BIGINT AS cost, '' AS audit
        FROM (SELECT u, any_value(block) AS block FROM rows GROUP BY u), (SELECT unnest([0, 1, 2, 3]) AS state) WHERE block > 0 OR state = 0
        UNION ALL
        SELECT u, i, entry, state, best.cost, best.audit
        FROM (SELECT w.u, r.i, w.entry, {to} AS state, min({{'cost': w.cost + {cost}, 'audit': w.audit || {letters}}}) AS best FROM way w JOIN rows r ON r.u = w.u AND r.i = w.i + 1 {join} GROUP BY ALL)
    )
    SELECT u, entry, state, cost, audit FROM way JOIN (SELECT u, max(i) AS i FROM rows GROUP BY u) USING (u, i)
"""
_TURNS = _STEP.format(to="m.next", cost=f"m.cost + CASE WHEN m.stays AND r.truncated THEN {TRUNCATED} ELSE 0 END", letters="m.letters", join="JOIN moves m ON m.state = w.state AND NOT (m.stays AND r.goes) AND (m.needs IS NULL OR m.needs = r.initial)")
_BLOCKS = _STEP.format(to="r.state", cost="r.cost", letters="r.audit", join="AND r.entry = w.state")
_WAY = "key string, block long, entry int, state int, cost long, audit string"


def _solved(sql: str):
    """Batches sorted by (key, block, i) to the states of each block: units stay whole, and some thousands of rows are one query."""

    def solve(con, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        (batch,) = rows.to_batches()
        _, starts, _ = next(runs(iter([batch]), ["key", "block"]))
        size = np.diff(np.append(starts, len(rows)))
        rows = rows.append_column("u", pa.array(np.repeat(np.arange(len(starts)), size)))
        con.register("rows", rows)
        out = con.sql(sql).to_arrow_table()
        con.unregister("rows")
        unit = pa.array(starts[out["u"].to_numpy()])
        arrays = [batch.column(batch.schema.get_field_index(c)).take(unit) for c in ("key", "block")]
        out = out.combine_chunks()
        return pa.RecordBatch.from_arrays([*arrays, *(out[c].combine_chunks().cast(t) for c, t in (("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())))], [x.split()[0] for x in _WAY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        con.execute("CREATE TABLE moves (state INTEGER, letters VARCHAR, cost BIGINT, stays BOOLEAN, needs VARCHAR, next INTEGER)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
        held, n = [], 0
        for batch, starts, goes_on in runs(batches, ["key", "block"]):
            whole = int(starts[-1])  # rows before the last unit, which may go on
            if n + whole >= BATCH and (whole or not goes_on):
                yield solve(con, [*held, batch.slice(0, whole)] if whole else held)
                held, n, batch = [], 0, batch.slice(whole)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield solve(con, held)
        con.close()

    return run


def edits(told: DataFrame) -> DataFrame:
    """key, cost, audit of the cheapest edits of faults()."""
    place = F.col("n") - 1
    rows = told.select("key", F.floor(place / BLOCK).cast("long").alias("block"), (place % BLOCK + 1).cast("long").alias("i"), "initial", (F.col("blank") | F.col("duplicate")).alias("goes"), "truncated")
    blocks = told.agg(F.max("n")).first()[0] or 0
    blocks = -(-blocks // BLOCK)
    ways = rows.repartition("key", "block").sortWithinPartitions("key", "block", "i").mapInArrow(_solved(_TURNS), _WAY)
    while blocks > 1:
        blocks = -(-blocks // FAN)
        steps = cut(ways).select("key", F.floor(F.col("block") / FAN).cast("long").alias("block"), (F.col("block") % FAN + 1).alias("i"), "entry", "state", "cost", "audit")
        ways = steps.repartition("key", "block").sortWithinPartitions("key", "block", "i").mapInArrow(_solved(_BLOCKS), _WAY)
    more = F.create_map(*(F.lit(x) for pair in TO_END.items() for x in pair))[F.col("state")]
    best = F.min(F.struct((F.col("cost") + INSERT * more).alias("cost"), F.concat("audit", F.repeat(F.lit("I"), more)).alias("audit")))
    return ways.where("entry = 0").groupBy("key").agg(best.alias("best")).select("key", "best.cost", "best.audit")


class _Writer:
    """Lines of a repaired conversation, from its audit and its rows in order."""

    ROLES = {"u": "user", "a": "assistant"}

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.empty = audit, 0, 0, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        self.sha.update((("" if self.empty else "\n") + f"{role}:{text}").encode())
        self.empty = False

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role, self.state = inserted(self.state)
            self._line(self.ROLES[role], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = NEXT[self.state][role[0]]
            self._line(role, text)
        elif edit == "R":
            initial, self.state = inserted(self.state)
            self._line(self.ROLES[initial], text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, writer = None, None
    for batch in batches:
        done = []
        for k, role, text, audit in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "role", "text", "audit")), strict=True):
            if audit is not None:
                if writer:
                    done.append((key, writer.digest()))
                key, writer = k, _Writer(audit)
            else:
                writer.row(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], ["key", "repaired_sha256"])
    if writer:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, writer.digest())], ["key", "repaired_sha256"])


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations, conv_col, turn_col, role_col, text_col)
    told = cut(faults(rows))
    pair = F.concat("prev_initial", "initial")
    count = lambda c: F.count(F.when(c, 1))
    figures = told.groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"), count(F.col("blank")).alias("blank"), count(F.col("duplicate")).alias("duplicate"), count(F.col("truncated")).alias("truncated"),
        count((F.col("n") > 1) & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )
    best = cut(edits(told))
    none = lambda kind: F.lit(None).cast(kind)
    lines = _told(rows).select("key", F.lit(1).alias("kind"), "turn", "r1", "r2", "role", "text", none("string").alias("audit"))
    lines = lines.unionByName(best.select("key", F.lit(0).alias("kind"), none("long").alias("turn"), none("long").alias("r1"), none("long").alias("r2"), none("string").alias("role"), none("string").alias("text"), "audit"))
    digests = lines.repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), *_ORDER).mapInArrow(_written, "key string, repaired_sha256 string")
    ids = conversations.select(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")).alias("key"), F.col(conv_col).alias("__id")).groupBy("key").agg(F.max("__id").alias("__id"))
    out = ids.join(figures, "key", "left").join(best, "key", "left").join(digests, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("__id").alias(conv_col), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
