"""A tree of hashes over rows, that tells whether two tables are the same and, where they aren't, which ranges of keys differ.

Keys are dealt by their SHA-256: a leaf holds the rows whose key's hash begins with the same hexadecimal digits, as many digits as keep leaves at about LEAF
rows, so leaves are small however keys are spread, and the same key is in the same leaf of any table. A leaf's digest is the SHA-256 over its rows' hashes in
the order of key and hash; a node's is that over its up to 16 children's. Every level is one aggregation of Spark's own functions, and no more than a leaf's
hashes meet in one row.

Cases: rows that repeat count each. A null key or value reads as the empty text, told apart by its length. An empty table has a root over nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import cut

LEAF = 1024
CHILDREN = 16


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a row's values, each with its length in front of it, -1 for null."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.concat(F.coalesce(F.length(text), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digits_for(n: int, leaf: int = LEAF) -> int:
    digits = 1
    while n > leaf * CHILDREN**digits:
        digits += 1
    return digits


def tree(rows: DataFrame, key: str, columns: list[str], digits: int | None = None, leaf: int = LEAF) -> DataFrame:
    """(node, digest, n_rows): the nodes of all levels; a node is named by the digits its keys' hashes begin with, the root by none.

    Trees that are compared need the same digits: take one's, len of its longest node, for the other.
    """
    digits = digits or digits_for(rows.count(), leaf)
    key_hash = F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256)
    hashed = rows.select(key_hash.alias("k"), row_hash(columns).alias("h")).withColumn("node", F.substring("k", 1, digits))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")
    level = cut(hashed.groupBy("node").agg(F.sha2(joined.cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n_rows")))
    out = level
    for d in range(digits - 1, -1, -1):
        below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), "")
        up = level.groupBy(F.substring("node", 1, d).alias("up")) if d else level.groupBy()
        level = up.agg(F.sha2(below.cast("binary"), 256).alias("digest"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        level = level.withColumnRenamed("up", "node") if d else level.withColumn("node", F.lit(""))
        out = out.unionByName(level)
    return out.select("node", "digest", "n_rows")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(node, n_a, n_b) of the leaves of two trees of equal digits that differ or that only one has; none if the roots are the same."""
    digits = a.agg(F.max(F.length("node"))).first()[0]
    leaves = lambda t, s: t.where(F.length("node") == digits).select("node", F.col("digest").alias(f"d_{s}"), F.col("n_rows").alias(f"n_{s}"))
    both = leaves(a, "a").join(leaves(b, "b"), "node", "full_outer")
    return both.where(~F.col("d_a").eqNullSafe(F.col("d_b"))).select("node", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def rows_of(rows: DataFrame, key: str, leaves: DataFrame) -> DataFrame:
    """The rows of a table in some leaves, as differing() names them."""
    digits = leaves.agg(F.max(F.length("node"))).first()[0] or 0
    node = F.substring(F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), 256), 1, digits)
    return rows.withColumn("__node", node).join(leaves.select(F.col("node").alias("__node")), "__node", "left_semi").drop("__node")
