"""The fixed-size filters that let a task skip what can't matter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrain.operators.tables import cut, discard, shared_dir

__all__ = ["Bloom", "bits_for", "cut", "discard", "shared_dir", "without_ids", "word_and_mask"]

#: Bits of a Bloom filter at most: 16 MB, whatever the input's size.
MOST_BITS = 1 << 27


def bits_for(n: int, a_row: int = 16) -> int:
    return 1 << min(MOST_BITS, max(1 << 16, n * a_row)).bit_length() - 1


def word_and_mask(v: Column, n: int, k: int = 2) -> tuple[Column, Column]:
    """Of a long column: its word of a filter of n words, and its k bits in that word."""
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 32)).bitwiseXOR(F.shiftleft(v, 21))
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 13))
    word, mask = F.shiftrightunsigned(v, 20) % F.lit(n).cast("long"), F.lit(0).cast("long")
    for i in range(k):
        bit = F.shiftrightunsigned(v, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return word, mask


class Bloom:
    """A Bloom filter of longs, for use inside tasks; both bits of a value are in one word of 64 bits."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def build(df: DataFrame, column: str, a_row: int = 16) -> Bloom:
        """Of df's values of a long column, with so many bits for each. Spark or-s the words together; MOST_BITS / 64 of them
        reach the driver at most, whatever df's size; a filter that fills up lets more pass."""
        df = df.where(F.col(column).isNotNull())
        n = bits_for(df.count(), a_row) // 64
        word, mask = word_and_mask(F.col(column), n)
        out = np.zeros(n, np.int64)
        got = df.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask")).toArrow()
        out[got["word"].to_numpy()] = got["mask"].to_numpy()
        return Bloom(out)

    def has(self, values: np.ndarray) -> np.ndarray:
        u = values.view(np.uint64)
        u = u ^ (u >> np.uint64(32)) ^ (u << np.uint64(21))
        u = u ^ (u >> np.uint64(13))
        one, low = np.uint64(1), np.uint64(63)
        mask = (one << (u & low)) | (one << ((u >> np.uint64(6)) & low))
        word = (u >> np.uint64(20)) % np.uint64(len(self.words))
        return (self.words[word.astype(np.int64)].view(np.uint64) & mask) == mask


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df without the rows whose column (a long) is in ids; rows that can't be in ids don't shuffle. Null stays."""
    ids = cut(ids.select(column).distinct())
    bloom = df.sparkSession.sparkContext.broadcast(Bloom.build(ids, column))

    @F.pandas_udf("boolean")
    def maybe(v: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(v.fillna(0).to_numpy(np.int64)))

    seen = df.withColumn("__maybe", maybe(F.col(column).cast("long")))
    rest = seen.where("__maybe").drop("__maybe").join(ids, column, "left_anti")
    return seen.where("not __maybe").select(df.columns).unionByName(rest.select(df.columns))
