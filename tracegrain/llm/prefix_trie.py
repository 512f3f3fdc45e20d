"""The trie of conversations' turns, for training on shared beginnings once.

A node is a distinct sequence of first turns (role, text). It is named by its depth and two polynomials of the turns' SHA-256 over prime fields
(122 bits), whose values at every turn are sums along the conversation: tasks sum their own rows of a range of (conversation, turn), one row for each part
carries on. So a conversation of any length lies in many tasks, and its texts never leave the scan.

Partitions emit tables of nodes that they have combined locally. Merges keyed by node and a piece of the partition's number sum members, and join lists
of ends, again and again until one row is left for each node; a list holds ends of one range of 65,536 ids, so it stays bounded. Nodes whose smallest member is
the same conversation lie on one path, a chain. The roll-up goes from the bottom of the tree of chains up by doubling (each round adds what ends twice as far
below), then along every chain by sums over ranges of (conversation, depth).

The SHA-256 over a node's ends runs along one list, so one task reads a node's lists, row by row.

Cases: rows are ordered by turn, null first, and by the digest of role and text where turns are equal. Null roles and texts are empty. A row without a
conversation's id is left out. Rows that repeat are turns of their own. With all turns borrowed away a conversation is a member of the root alone. Columns
other than these four play no part, whatever their names. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracegrain.operators.ordered import running, runs, scan

from .shared import cut, discard

P = (1 << 61) - 1
#: Bases of the two polynomials, odd numbers below P.
BASES = (0x1A2B3C4D5E6F7081, 0x0F1E2D3C4B5A6979)
#: Nodes, and ends of conversations, that a task combines before it hands them on.
MOST_NODES, MOST_ENDS = 1 << 16, 1 << 18
#: Ids of one range of this many go to one list of ends.
SEGMENT_BITS = 16
#: Partial tables that one merge brings together.
FAN_BITS = 5
NODE = ["depth", "a1", "a2"]


def turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, r1 and r2 (60 bits each of the SHA-256 of role and text), words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    sixty = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), sixty(1).alias("r1"), sixty(16).alias("r2"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")
    )


_SUMMED = "conv long, words long, part int, n long, s1 long, s2 long, p1 long, p2 long"


def _sum(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted turns: n, and the polynomials with (s) and without (p) the turn, counted from the conversation's first row in this part."""
    n = s1 = s2 = 0
    b1 = b2 = 1
    for batch, starts, goes_on in runs(batches, ["conv"]):
        new, out = set(starts.tolist()), []
        for i, (r1, r2) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("r1", "r2")), strict=True)):
            if i in new and (i or not goes_on):
                n, s1, s2, b1, b2 = 0, 0, 0, 1, 1
            n, b1, b2, was = n + 1, b1 * BASES[0] % P, b2 * BASES[1] % P, (s1, s2)
            s1, s2 = (s1 + (r1 + 1) * b1) % P, (s2 + (r2 + 1) * b2) % P
            out.append((n, s1, s2, *was))
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("conv", "words")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([part] * len(out), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], [x.split()[0] for x in _SUMMED.split(", ")])


def _onward(n: int, s: tuple[int, int], m: int, t: tuple[int, int]) -> tuple[int, tuple[int, int]]:
    """m rows with sums t, counted from 1, behind n rows with sums s."""
    return n + m, tuple((a + b * pow(base, n, P)) % P for a, b, base in zip(s, t, BASES, strict=True))


def summed(rows: DataFrame) -> DataFrame:
    """turns() with n, s1, s2, p1, p2 counted from the conversation's first row."""
    table, ends = scan(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("r1"), F.col("r2")], _sum, StructType.fromDDL(_SUMMED), ["s1", "s2"])
    carried, n, s, ended = {}, 0, (0, 0), None
    for r in ends:
        if r.first != ended:
            n, s = 0, (0, 0)
        if n:
            carried[r.part] = (r.first[0], n, s)
        ended, here = r["last"].group, (r["last"].n, (r["last"].s1, r["last"].s2))
        n, s = _onward(n, s, *here) if r.first == ended else here
    if not carried:
        return table

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                conv, before, sums = carried.get(r["part"], (None, 0, (0, 0)))
                if before and conv == r["conv"]:
                    _, (r["p1"], r["p2"]) = _onward(before, sums, 0, (r["p1"], r["p2"]))
                    r["n"], (r["s1"], r["s2"]) = _onward(before, sums, r["n"], (r["s1"], r["s2"]))
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return table.mapInArrow(onward, _SUMMED)


def _heads(rows: DataFrame, most: int) -> DataFrame:
    """Of each conversation: its number of turns and its first `most` ones, as an array of (n, s1, s2, words) that starts with the root."""
    first = [F.max(F.when(F.col("n") == i, F.struct("n", "s1", "s2", "words"))) for i in range(1, most + 1)]
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("n", "s1", "s2", "words")))
    return rows.groupBy("conv").agg(F.max("n").alias("turns"), F.array_compact(F.array(zero, *first)).alias("head"))


def _rebuilt(rows: DataFrame, block: int, most: int) -> DataFrame:
    """A row for each conversation and node on its path: conv, last, words, depth, the node's own sums (a) and its parent's (p)."""
    own = cut(_heads(rows, most))
    leader = own.select(F.col("conv").alias("leader"), F.col("turns").alias("had"), F.col("head").alias("theirs"))
    own = own.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1))
    own = own.join(leader, F.col("conv") - F.col("conv") % block == F.col("leader"), "left")
    own = own.withColumn("k", F.least("h", F.coalesce("had", F.lit(0)))).withColumn("theirs", F.coalesce("theirs", F.slice("head", 1, 1)))
    own = cut(own.select("conv", "turns", "h", "k", "theirs", F.when(F.col("turns") > F.col("h"), F.element_at("head", (F.col("h") + 1).cast("int"))).alias("at_h")))

    def node(at: Column) -> Column:
        return F.element_at("theirs", (at + 1).cast("int"))

    borrowed = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k"))).alias("depth"))
    borrowed = borrowed.select(
        "conv", ((F.col("turns") <= F.col("h")) & (F.col("depth") == F.col("k"))).alias("last"), node(F.col("depth"))["words"].alias("words"), "depth",
        node(F.col("depth"))["s1"].alias("a1"), node(F.col("depth"))["s2"].alias("a2"), node(F.greatest("depth", F.lit(1)) - 1)["s1"].alias("p1"), node(F.greatest("depth", F.lit(1)) - 1)["s2"].alias("p2"),
    )
    left = own.where("turns > h").select("conv", "turns", "h", "k", node(F.col("k")).alias("to"), "at_h")
    rest = rows.join(left, "conv").where("n > h").select("conv", (F.col("n") == F.col("turns")).alias("last"), "words", "n", "s1", "s2", "p1", "p2", "h", "k", F.col("to.s1").alias("t1"), F.col("to.s2").alias("t2"), F.col("at_h.s1").alias("f1"), F.col("at_h.s2").alias("f2"))

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = [[pow(base, -i, P) for i in range(most + 1)] for base in BASES]
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.to_pydict()
            out = {x: c[x] for x in ("conv", "last", "words")}
            out["depth"] = [n - h + k for n, h, k in zip(c["n"], c["h"], c["k"], strict=True)]
            for i, (a, p, t, f) in enumerate((("s1", "p1", "t1", "f1"), ("s2", "p2", "t2", "f2"))):
                for name, sums in ((f"a{i + 1}", c[a]), (f"p{i + 1}", c[p])):
                    out[name] = [(to + (x - start) * inverse[i][h - k]) % P for x, to, start, h, k in zip(sums, c[t], c[f], c["h"], c["k"], strict=True)]
            yield pa.RecordBatch.from_pydict({x: out[x] for x in ("conv", "last", "words", "depth", "a1", "a2", "p1", "p2")})

    schema = "conv long, last boolean, words long, depth long, a1 long, a2 long, p1 long, p2 long"
    return borrowed.union(rest.mapInArrow(moved, schema))


_PARTIAL = "part int, depth long, a1 long, a2 long, p1 long, p2 long, words long, conv long, members long, segment long, ends array<long>"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's own trie as rows: nodes, and (with segment) the ends of nodes in a range of ids."""
    part = TaskContext.get().partitionId()
    nodes, ends, n_ends = {}, {}, 0
    schema = pa.schema([(c, {"int": pa.int32(), "array<long>": pa.list_(pa.int64())}.get(t, pa.int64())) for c, t in (x.split() for x in _PARTIAL.split(", "))])

    def rows() -> pa.RecordBatch:
        out = [(part, *key, *v, None, None) for key, v in nodes.items()] + [(part, *key, None, None, None, None, None, segment, sorted(ids)) for (*key, segment), ids in ends.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for conv, last, words, depth, a1, a2, p1, p2 in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "last", "words", "depth", "a1", "a2", "p1", "p2")), strict=True):
            v = nodes.get((depth, a1, a2))
            if v is None:
                nodes[depth, a1, a2] = [p1, p2, words, conv, 1]
            else:
                v[3], v[4] = min(v[3], conv), v[4] + 1
            if last:
                ends.setdefault((depth, a1, a2, conv >> SEGMENT_BITS), []).append(conv)
                n_ends += 1
            if len(nodes) >= MOST_NODES or n_ends >= MOST_ENDS:
                yield rows()
                nodes, ends, n_ends = {}, {}, 0
    if nodes:
        yield rows()


def _merged(partial: DataFrame) -> DataFrame:
    """One row for each node: depth, a1, a2, p1, p2, words, conv, members, ends_sha256."""
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    nodes, ends, bits = partial.where("segment is null").drop("segment", "ends"), partial.where("segment is not null").select("part", *NODE, "segment", "ends"), max(1, (parts - 1).bit_length())
    while bits > 0:
        bits -= FAN_BITS
        key = F.shiftright("part", FAN_BITS).alias("part")
        nodes = nodes.groupBy(*NODE, key).agg(*(F.first(c).alias(c) for c in ("p1", "p2", "words")), F.min("conv").alias("conv"), F.sum("members").alias("members"))
        ends = ends.groupBy(*NODE, "segment", key).agg(F.array_sort(F.flatten(F.collect_list("ends"))).alias("ends"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, last = None, None
        names = [*NODE, "ends_sha256"]
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NODE, "ends")), strict=True):
                if node != last:
                    if last:
                        done.append((*last, sha.hexdigest()))
                    sha, last = hashlib.sha256(), node
                else:
                    sha.update(b",")
                sha.update(",".join(map(str, ids)).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, sha.hexdigest())], names)

    digests = ends.repartition(*NODE).sortWithinPartitions(*NODE, "segment").mapInArrow(hashed, "depth long, a1 long, a2 long, ends_sha256 string")
    return nodes.drop("part").join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def _totals(chains: DataFrame) -> DataFrame:
    """chains (conv, up, saved, leaves) with the sums over all chains below and the chain itself, by doubling."""
    now = cut(chains)
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        over = now.select(F.col("conv").alias("up"), F.col("up").alias("over"))
        last, now = now, cut(now.join(below, "conv", "left").join(over, "up", "left").select("conv", F.col("over").alias("up"), (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")))
        discard(last)
    return now


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 20, most: int = 3) -> DataFrame:
    """Rows of nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c begins with the first crc32(c) % (most + 1) turns of conversation c - c % block and goes on with its own turns after as many of its own.
    """
    rows = summed(turns(conversations, conv_col, turn_col, role_col, text_col))
    nodes = cut(_merged(cut(_rebuilt(rows, block, most).mapInArrow(_combine, _PARTIAL))))
    saved = (F.col("members") - 1) * F.col("words")
    chains = nodes.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2")).alias("top"), F.max("depth").alias("bottom"), F.sum(saved).alias("saved"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a1").alias("p1"), F.col("a2").alias("p2"), F.col("conv").alias("up"))
    chains = chains.select("conv", "bottom", "saved", "top.*").withColumn("depth", F.when(F.col("depth") > 0, F.col("depth")).otherwise(-1)).join(parents, ["depth", "p1", "p2"], "left").select("conv", "up", F.greatest("depth", F.lit(0)).alias("top"), "bottom", "saved")
    chains = cut(chains)
    taken = chains.where("up is not null").select(F.col("up").alias("conv"), (F.col("top") - 1).alias("bottom")).distinct().withColumn("taken", F.lit(1))
    chains = cut(chains.join(taken, ["conv", "bottom"], "left").withColumn("leaves", 1 - F.coalesce("taken", F.lit(0)).cast("long")).drop("taken"))
    total = _totals(chains.select("conv", "up", "saved", "leaves")).select("conv", F.col("saved").alias("all_saved"), F.col("leaves").alias("all_leaves"))
    none = F.lit(None).cast("long")
    marks = chains.select("conv", F.col("top").alias("depth"), F.lit(0).cast("long").alias("kids"), F.lit(0).cast("long").alias("more"), F.lit(0).cast("long").alias("leaves"), "up", F.lit(1).alias("is_top"), F.lit(0).alias("is_bottom"))
    marks = marks.unionByName(chains.select("conv", F.col("bottom").alias("depth"), F.lit(0).cast("long").alias("kids"), F.lit(0).cast("long").alias("more"), "leaves", none.alias("up"), F.lit(0).alias("is_top"), F.lit(1).alias("is_bottom")))
    hung = chains.where("up is not null").join(total, "conv").groupBy(F.col("up").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("kids"), F.sum("all_saved").alias("more"), F.sum("all_leaves").alias("leaves"))
    marks = marks.unionByName(hung.select("conv", "depth", "kids", "more", "leaves", none.alias("up"), F.lit(0).alias("is_top"), F.lit(0).alias("is_bottom")))
    marks = marks.groupBy("conv", "depth").agg(F.sum("kids").alias("kids"), F.sum("more").alias("more"), F.sum("leaves").alias("leaves"), F.max("up").alias("up"), F.max("is_top").alias("is_top"), F.max("is_bottom").alias("is_bottom"))
    marked = nodes.join(marks, ["conv", "depth"], "left").select(
        "conv", "depth", "members", "ends_sha256", "up", F.coalesce("is_top", F.lit(0)).alias("is_top"), "leaves",
        (F.coalesce("kids", F.lit(0)) + 1 - F.coalesce("is_bottom", F.lit(0))).alias("children"), (saved + F.coalesce("more", F.lit(0))).alias("saved"),
    )
    out = running(marked, ["conv"], [F.col("depth").desc()], ["saved", "leaves"])
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("is_top") == 1, F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("children").cast("long").alias("n_children"),
        F.col("run_leaves").alias("n_leaves"), F.col("run_saved").alias("saved_tokens"), "ends_sha256",
    )
