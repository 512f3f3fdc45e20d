"""Substring deduplication by De Bruijn compaction of repeated word windows.

Every window of k consecutive words is an edge of a De Bruijn graph, from its first k - 1 words to its last
k - 1. Edges are counted, and only those that start at two places or more matter; a join takes the counts back to
the edges' source coordinates. There, neighbouring edges of equal counts compact into a path, and coordinates
verify it: a path that starts at as many places as its edges has no branch in it, as each of its edges is followed
by the same one everywhere; one that fails is marked. Paths are the long repeated spans.

An edge is told by 128 bits: two hashes of its words by polynomials of their own. Both count and join, so among 10**13 windows fewer than one in 10**11
runs meets a false equal.

Before, anchors keep the rest out of the shuffle. A window's anchor is the least hashed `anchor`-gram of its
words, so equal windows have equal anchors, and neighbours mostly share one. Anchors are counted first; a
window whose anchor occurs once can't repeat. A Bloom filter of fixed size tells tasks which anchors repeat; the
windows that pass are counted exactly, so the filter affects speed only. Equal texts are one source with a weight.

Cases: null and empty texts, and texts of fewer than k words, have no window and keep all their words. A repeated
row repeats its windows. Ids play no part in it: a text's spans follow from its words, by whose hash
and number they are kept. Other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Bloom, cut
from .words import as_long, chunks, mix, shingle_hashes


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words, from hashes of shorter runs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = 7 if k % 7 == 0 else 1
    parts = shingle_hashes(words, step)
    return shingle_hashes(parts, k) if step == 1 else _strided(parts, k // step, step, n, 0xA0761D6478BD642F)


def second_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Another hash of every k consecutive words."""
    n, step = len(words) - k + 1, 5 if k % 5 == 0 else 1
    if n <= 0:
        return np.empty(0, np.uint64)
    again = mix(words ^ np.uint64(0x8EBC6AF09C88C6E3))
    parts = _strided(again, step, 1, len(words) - step + 1, 0xE7037ED1A0B428DB)
    return _strided(parts, k // step, step, n, 0xEB44ACCAB455D165)


def _strided(parts: np.ndarray, times: int, step: int, n: int, base: int) -> np.ndarray:
    out, power = np.zeros(n, np.uint64), 1
    for i in range(times):
        out += parts[i * step : i * step + n] * np.uint64(power)
        power = power * base % (1 << 64)
    return mix(out)


def anchors(words: np.ndarray, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the text's anchor-grams, and for each window the place of its anchor."""
    grams, width = shingle_hashes(words, anchor), k - anchor + 1
    n = len(grams) - width + 1
    if n <= 0:
        return grams, np.empty(0, np.int64)
    # the least of each width, by doubling: equal grams are the same anchor, so which of them is taken doesn't matter
    least, at, span = grams, np.arange(len(grams)), 1
    while span < width:
        by = min(span, width - span)
        m = len(least) - by
        right = least[by:] < least[:m]
        least, at = np.where(right, least[by:], least[:m]), np.where(right, at[by:], at[:m])
        span += by
    return grams, at[:n]


def _anchor_counts(k: int, anchor: int):
    """mapInArrow: (text) into (h, n): the anchors of all windows, each place once, summed over a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for chunk in chunks(batch.column(0)):
                for _, words in chunk:
                    if len(words) >= k:
                        grams, at = anchors(words, k, anchor)
                        got.append(grams[at[np.flatnonzero(np.diff(at, prepend=-1))]])
            h, n = np.unique(np.concatenate(got) if got else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(n)], ["h", "n"])

    return run


def _key(words: np.ndarray) -> int:
    """A hash of a text's words and their number."""
    return int(as_long(mix(np.array([np.bitwise_xor.reduce(mix(words + np.arange(len(words), dtype=np.uint64)), initial=np.uint64(len(words)))])))[0])


def _edges(k: int, anchor: int, maybe):
    """mapInArrow: (text) into (doc, first, edges, seconds): runs of windows whose anchors may repeat; doc is the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a window takes several times the bytes of its word, so a chunk's windows are handed on before the next chunk is read
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                out: list[list] = [[], [], [], []]
                for _, words in chunk:
                    if len(words) < k:
                        continue
                    grams, at = anchors(words, k, anchor)
                    change = np.flatnonzero(np.diff(at, prepend=-1))
                    passed = np.repeat(maybe.value.has(as_long(grams[at[change]])), np.diff(np.append(change, len(at))))
                    if not passed.any():
                        continue
                    edges, seconds, doc = as_long(window_hashes(words, k)), as_long(second_hashes(words, k)), _key(words)
                    borders = np.flatnonzero(np.diff(np.concatenate([[False], passed, [False]]).astype(np.int8)))
                    for a, b in zip(borders[::2], borders[1::2], strict=True):
                        for to, v in zip(out, (doc, a, edges[a:b], seconds[a:b]), strict=True):
                            to.append(v)
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64))) for x in out[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), *lists], ["doc", "first", "edges", "seconds"])

    return run


def _hashed(covered):
    """mapInArrow: (id, text) into (id, doc, n_words, kept_sha256, text); text only of those that may have repeated spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(1)):
                for row, words in chunk:
                    keys[row], n[row] = _key(words), len(words)
            maybe = covered.value.has(keys)
            texts = [t.as_py() or "" for t in batch.column(1)]
            sha = [None if m else hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for t, m in zip(texts, maybe, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(n), pa.array(sha, pa.string()), pa.array([t if m else None for t, m in zip(texts, maybe, strict=True)], pa.string())], ["id", "doc", "n_words", "kept_sha256", "text"])

    return run


def _without(spans, words: list[bytes]) -> list[bytes]:
    out, end = [], 0
    for s in [] if spans is None else spans:
        out += words[end : s["start"]]
        end = s["end"]
    return out + words[end:]


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (id, n_words, text, spans) into (id, n_words, n_removed, kept_sha256)."""
    for batch in batches:
        removed, sha = [], []
        for n, text, spans in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            kept = _without(spans.as_py(), text.as_py().encode().split())
            removed.append(n.as_py() - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


class RepeatedSpans:
    """The repeated windows of k words of docs, compacted into paths with their source coordinates."""

    def __init__(self, docs: DataFrame, text_col: str = "text", k: int = 35, anchor: int = 16):
        self.k, self.text_col, self.docs = k, text_col, docs
        texts, spark = docs.select(F.col(text_col).alias("text")), docs.sparkSession
        counts = texts.mapInArrow(_anchor_counts(k, anchor), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        maybe = spark.sparkContext.broadcast(Bloom.build(cut(counts.where("n > 1").select("h")), "h"))
        runs = texts.mapInArrow(_edges(k, anchor, maybe), "doc long, first long, edges array<long>, seconds array<long>")
        self.runs = cut(runs.groupBy("doc", "first").agg(F.any_value("edges").alias("edges"), F.any_value("seconds").alias("seconds"), F.count(F.lit(1)).alias("copies")))
        self._edges = self._covered = None

    def edges(self) -> DataFrame:
        """(e, f, n): the edges (their two hashes) that start at n places, two or more; a table, so that places of one edge can be dealt over tasks when they meet it."""
        if self._edges is None:
            counts = self.runs.select(F.inline(F.arrays_zip(F.col("edges").alias("e"), F.col("seconds").alias("f"))), "copies").groupBy("e", "f").agg(F.sum("copies").alias("n"))
            self._edges = cut(counts.where("n > 1"))
        return self._edges

    def candidates(self) -> DataFrame:
        """(doc, start, windows, path, content, n, copies): runs of neighbouring repeated edges of equal counts, in each source."""
        both = F.arrays_zip(F.col("edges").alias("e"), F.col("seconds").alias("f"))
        placed = self.runs.select("doc", "first", "copies", F.posexplode(both).alias("i", "x")).select("doc", (F.col("first") + F.col("i")).cast("int").alias("at"), "x.e", "x.f", "copies")
        found = placed.join(self.edges(), ["e", "f"])
        by_place = Window.partitionBy("doc").orderBy("at")
        new = F.coalesce((F.lag("at").over(by_place) == F.col("at") - 1) & (F.lag("n").over(by_place) == F.col("n")), F.lit(False))
        marked = found.withColumn("new", F.when(new, 0).otherwise(1)).withColumn("no", F.sum("new").over(by_place))
        content = F.bit_xor(F.xxhash64("e"))  # edges overlap in all but a word, so which they are tells their order
        return marked.groupBy("doc", "no").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("windows"), F.min_by("e", "at").alias("path"), content.alias("content"), F.max("n").alias("n"), F.max("copies").alias("copies")).drop("no")

    def paths(self) -> DataFrame:
        """(path, windows, n, verified): the distinct compacted paths; a path is named by its first edge.

        Verified: it occurs at n places, as each of its edges does, so no branch is inside it.
        """
        return self.candidates().groupBy("path", "windows", "content", "n").agg(F.sum("copies").alias("places")).select("path", "windows", "n", (F.col("places") == F.col("n")).alias("verified"))

    def covered(self) -> DataFrame:
        """(doc, spans): of each text with repeated windows, the [start, end) of words that they cover, merged."""
        if self._covered is None:
            by_start = Window.partitionBy("doc").orderBy("start")
            ends = self.candidates().select("doc", "start", (F.col("start") + F.col("windows") + self.k - 1).cast("int").alias("end"))
            before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
            groups = ends.withColumn("no", F.sum(F.when(F.col("start") <= before, 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
            merged = groups.groupBy("doc", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            self._covered = cut(merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans")))
        return self._covered

    def removals(self, id_col: str = "doc_id") -> DataFrame:
        """A row for each row of docs: its id, n_words, n_removed and kept_sha256 of the words that stay, joined by spaces."""
        bloom = self.docs.sparkSession.sparkContext.broadcast(Bloom.build(self.covered(), "doc"))
        rows = self.docs.select(F.col(id_col).alias("id"), F.col(self.text_col).alias("text"))
        id_type = rows.schema["id"].dataType.simpleString()
        rows = cut(rows.mapInArrow(_hashed(bloom), f"id {id_type}, doc long, n_words long, kept_sha256 string, text string"))
        whole = rows.where("text is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
        parts = rows.where("text is not null").join(self.covered(), "doc", "left").select("id", "n_words", "text", "spans")
        parts = parts.mapInArrow(_cut_out, f"id {id_type}, n_words long, n_removed long, kept_sha256 string")
        return whole.unionByName(parts).withColumnRenamed("id", id_col)

    def deduplicated(self) -> DataFrame:
        """docs with the repeated words cut out of the text; what is kept is joined by spaces where words went, null stays null."""
        columns, bloom = self.docs.columns, self.docs.sparkSession.sparkContext.broadcast(Bloom.build(self.covered(), "doc"))

        @F.pandas_udf("long")
        def key(text: pd.Series) -> pd.Series:
            out = np.zeros(len(text), np.int64)
            for chunk in chunks(pa.array(text, pa.large_string(), from_pandas=True)):
                for row, words in chunk:
                    out[row] = _key(words)
            return pd.Series(out)

        @F.pandas_udf("boolean")
        def maybe(doc: pd.Series) -> pd.Series:
            return pd.Series(bloom.value.has(doc.to_numpy(np.int64)))

        @F.pandas_udf("string")
        def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
            return pd.Series([t if s is None or t is None else b" ".join(_without(s, t.encode().split())).decode() for t, s in zip(text, spans, strict=True)], dtype=object)

        keyed = self.docs.withColumn("__doc", key(self.text_col)).withColumn("__maybe", maybe("__doc"))
        plain = keyed.where("not __maybe").select(columns)
        met = keyed.where("__maybe").join(self.covered().toDF("__doc", "__spans"), "__doc", "left").withColumn(self.text_col, kept(self.text_col, "__spans"))
        return plain.unionByName(met.select(columns))
