"""Exact deduplication by two-pass Bloom filtering.

Pass one reads the texts' 64-bit hashes. Every task keeps two bit tables: bits that were set once and
bits that were set at least twice; Spark merges the tables word by word. Pass two looks each row up in
the merged table of bits set twice: a row with one of its bits missing there has no equal, and goes
straight through. Only the others shuffle, and a SHA-256 of the text settles them.

The table broadcast in pass two holds the words with a bit set twice: MOST_BITS / 64 rows at most, and no
more than there are repeated texts (and chance hits). Beyond what the filter can hold, more rows shuffle;
the result stays the same.

Cases: a null text counts as empty when null_as_empty, else it has no equal. Of equal texts the row with
the largest id stays (null ids last); of rows that also have the same id, one stays. An empty table gives an
empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bits_for, cut, word_and_mask

BITS_A_VALUE = 3
#: Groups of a larger share of the rows, and of so many rows at least, are broadcast: 1 / LARGE of them at most.
LARGE, LEAST_LARGE = 1e-4, 200


def _twice(words: int, merged: bool):
    """mapInArrow: rows (word, once[, twice]) into the task's words with a bit set, in tables of words longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            word = batch.column(0).to_numpy()
            mask = batch.column(1).to_numpy().view(np.uint64)
            if merged:
                np.bitwise_or.at(twice, word, batch.column(2).to_numpy().view(np.uint64))
            # equal rows of a batch first become one, else a text copied often takes a round for each copy
            order = np.lexsort((mask, word))
            word, mask = word[order], mask[order]
            new = np.ones(len(word), bool)
            new[1:] = (word[1:] != word[:-1]) | (mask[1:] != mask[:-1])
            again = ~new
            np.bitwise_or.at(twice, word[again], mask[again])
            word, mask = word[new], mask[new]
            while len(word):  # a round takes the first mask of every word
                first = np.ones(len(word), bool)
                first[1:] = word[1:] != word[:-1]
                at, bits = word[first], mask[first]
                twice[at] |= once[at] & bits
                once[at] |= bits
                word, mask = word[~first], mask[~first]
        at = np.flatnonzero(once | twice)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(once[part].view(np.int64)), pa.array(twice[part].view(np.int64))], ["word", "once", "twice"])

    return run


def maybe_repeated(df: DataFrame, hashed: Column, rows: int | None = None) -> DataFrame:
    """df with a boolean column __again: false only if no other row has the same hash (a long, not null)."""
    words = bits_for(df.count() if rows is None else rows) // 64
    word, mask = word_and_mask(hashed, words, BITS_A_VALUE)
    schema = "word long, once long, twice long"
    each = df.select(word.alias("word"), mask.alias("once")).mapInArrow(_twice(words, False), schema)
    table = cut(each.repartition("word").mapInArrow(_twice(words, True), schema).where("twice != 0").select(F.col("word").alias("__word"), F.col("twice").alias("__twice")))
    out = df.withColumns({"__word": word, "__mask": mask}).join(F.broadcast(table), "__word", "left")
    again = F.coalesce(F.col("__twice").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    return out.withColumn("__again", again).drop("__word", "__mask", "__twice")


def _prepared(df: DataFrame, text_col: str, null_as_empty: bool) -> tuple[DataFrame, Column]:
    """df with __again, false where the text is known to be the only one of its kind; and the text that counts."""
    text = F.coalesce(F.col(text_col), F.lit("")) if null_as_empty else F.col(text_col)
    seen = maybe_repeated(df, F.xxhash64(text))
    return (seen if null_as_empty else seen.withColumn("__again", F.col("__again") & text.isNotNull())), F.sha2(text.cast("binary"), 256)


def _met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with groups (one row for each __sha); rows of large groups don't shuffle.

    Groups of more than LARGE of all rows (LEAST_LARGE at least) are fewer than 1 / LARGE, so they are broadcast.
    """
    large = cut(groups.where(F.col("__size") > max(LEAST_LARGE, int(LARGE * rows.count()))).select("__sha", F.lit(True).alias("__large")))
    if large.isEmpty():
        return rows.join(groups, "__sha")
    marked = rows.join(F.broadcast(large), "__sha", "left")
    of_large = F.broadcast(groups.join(F.broadcast(large.select("__sha")), "__sha", "left_semi"))
    few = marked.where("__large is null").drop("__large").join(groups, "__sha")
    return few.unionByName(marked.where("__large").drop("__large").join(of_large, "__sha"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_as_empty: bool = True) -> DataFrame:
    """A row for each row of df: its id, keep_id, group_size, kept and text_sha256."""
    seen, sha = _prepared(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", null_as_empty)
    seen = cut(seen.select("__id", sha.alias("__sha"), "__again"))
    single = seen.where("not __again").select(F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("text_sha256"))
    many = seen.where("__again").drop("__again")
    met = _met(many, cut(many.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size"))))
    top = F.col("__id").eqNullSafe(F.col("__keep"))
    # rows that equal even in their id are counted, and one of them is kept
    same = met.where(top).groupBy("__sha", "__id", "__keep", "__size").agg(F.count(F.lit(1)).alias("__n"))
    same = same.select("__sha", "__id", "__keep", "__size", F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__i"))
    out = same.select("__id", "__sha", "__keep", "__size", (F.col("__i") == 1).alias("kept")).unionByName(met.where(~top).withColumn("kept", F.lit(False)))
    return single.unionByName(out.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), "kept", F.col("__sha").alias("text_sha256")))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_as_empty: bool = True) -> DataFrame:
    """df without the rows whose text another row with a larger id has; the columns stay as they are."""
    seen, sha = _prepared(df, text_col, null_as_empty)
    many = cut(seen.where("__again").withColumn("__sha", sha))
    groups = cut(many.groupBy("__sha").agg(F.max(id_col).alias("__keep"), F.count(F.lit(1)).alias("__size")))
    # one of the rows that equal even in their id; partial aggregation leaves one of them a task
    kept = _met(many, groups).where(F.col(id_col).eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    return seen.where("not __again").select(df.columns).unionByName(kept.select(df.columns))
