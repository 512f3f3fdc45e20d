"""Masked pseudo-likelihood: each token's log-probability given the tokens on both sides, summed.

A small network predicts a token from `window` tokens to its left and right: the sum of embeddings by place, a
tanh layer, and a two-level softmax over token classes (16 groups of 16). The classes are the corpus's most frequent words
and, for all others, buckets of their hash. A word's share of its class, P(word | class) = n(word) / (n(class) + 1), comes from exact
counts over every document; the counts of the whole vocabulary are a table, which grows with the corpus and meets the
words of the texts in a join. A word that occurs once in the corpus and one that doesn't occur have the share 1 / (n(class) + 1),
so the table keeps words that occur twice or more. The most frequent `near` at most are also told to the tasks, so no key of the join is large.

Training is numpy inside tasks: in each round every task starts from the same parameters, masks every document's
tokens, an eighth at a time, and takes gradient steps; Spark averages the tasks' parameters, weighted by
their tokens, as rows. The eighths are dealt over the rounds, so that every token of every document is a target at least once,
whatever the number of rounds; the driver holds one set of parameters.

Cases: a null text is empty; without tokens the sum is 0 and the mean null. Repeated rows are scored each. On
an empty table nothing is learned. Scores depend a little on how the input is split, as averaging does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Bloom, cut
from .words import as_long, chunks

GROUPS = 16
CLASSES = GROUPS * GROUPS
#: Classes of their own for frequent words; the rest, and places beyond a text's ends (the last one), are buckets.
FREQUENT, EDGE = 191, CLASSES - 1
DIM, WINDOW, MASK = 16, 2, 8


class Network:
    """Parameters as one vector, and its parts."""

    def __init__(self, vector: np.ndarray):
        self.vector, at = vector, 0
        for name, shape in self.shapes().items():
            size = int(np.prod(shape))
            setattr(self, name, vector[at : at + size].reshape(shape))
            at += size

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        return {"embed": (2 * WINDOW, CLASSES, DIM), "bias": (DIM,), "group": (DIM + 1, GROUPS), "member": (GROUPS, DIM + 1, GROUPS)}

    @classmethod
    def start(cls, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return cls(np.concatenate([rng.normal(0, 0.1, int(np.prod(s))) for s in cls.shapes().values()]).astype(np.float32))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.bias + sum(self.embed[i][context[:, i]] for i in range(2 * WINDOW))
        return np.concatenate([np.tanh(total), np.ones((len(total), 1), np.float32)], axis=1)

    def log_prob(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h, rows = self.hidden(context), np.arange(len(target))
        group, member = target >> 4, target & 15
        return _log_softmax(h @ self.group)[rows, group] + _log_softmax(self._members(h, group))[rows, member]

    def _members(self, h: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of each row the scores of its group's members; one product for all groups is faster than a gathered one."""
        every = h @ self.member.transpose(1, 0, 2).reshape(DIM + 1, CLASSES)
        return every.reshape(-1, GROUPS, GROUPS)[np.arange(len(h)), group]

    def step(self, context: np.ndarray, target: np.ndarray, rate: float, memory: np.ndarray) -> None:
        """One adaptive gradient step on the mean of a batch; memory: the squares' sums."""
        h, rows = self.hidden(context), np.arange(len(target))
        group, member = target >> 4, target & 15
        grad = Network(np.zeros_like(self.vector))
        d_group = np.exp(_log_softmax(h @ self.group))
        d_group[rows, group] -= 1
        d_member = np.exp(_log_softmax(self._members(h, group)))
        d_member[rows, member] -= 1
        grad.group += h.T @ d_group
        d_class = np.zeros((len(h), GROUPS, GROUPS), np.float32)
        d_class[rows, group] = d_member
        d_class = d_class.reshape(-1, CLASSES)
        grad.member += (h.T @ d_class).reshape(DIM + 1, GROUPS, GROUPS).transpose(1, 0, 2)
        back = self.member.transpose(0, 2, 1).reshape(CLASSES, DIM + 1)
        d_h = (d_group @ self.group.T + d_class @ back)[:, :DIM] * (1 - h[:, :DIM] ** 2)
        grad.bias += d_h.sum(axis=0)
        for i in range(2 * WINDOW):
            at = (context[:, i, None] * DIM + np.arange(DIM)).ravel()
            grad.embed[i] += np.bincount(at, d_h.ravel(), CLASSES * DIM).reshape(CLASSES, DIM)
        g = grad.vector / len(target)
        memory += g * g
        self.vector -= rate * g / np.sqrt(memory)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def classes_of(h: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of word hashes: the class; frequent is sorted, place its classes."""
    out = (FREQUENT + (h >> np.uint64(32)) % np.uint64(EDGE - FREQUENT)).astype(np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        known = frequent[at] == h
        out[known] = place[at[known]]
    return out


def contexts(tokens: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The window of each token of texts that lie one after another; EDGE beyond a text's ends."""
    n = len(tokens)
    first, last = np.repeat(bound[:-1], np.diff(bound)), np.repeat(bound[1:], np.diff(bound))
    out = np.full((n, 2 * WINDOW), EDGE, np.int64)
    for i, by in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        at = np.arange(n) + by
        inside = (at >= first) & (at < last)
        out[inside, i] = tokens[at[inside]]
    return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n) of every word of the texts: its hash, and how often it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                h, n = np.unique(chunk.hash, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(n)], ["h", "n"])

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the most frequent words, sorted, and each one's rank."""
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()["h"].to_numpy().view(np.uint64)
    order = np.argsort(top)
    return top[order], order


class Shares:
    """P(word | class): totals of all classes, counts of at most `near` frequent words, and the table of all others' counts."""

    def __init__(self, counts: DataFrame, frequent: np.ndarray, place: np.ndarray, near: int):
        bucket = F.lit(FREQUENT) + F.shiftrightunsigned("h", 32) % F.lit(EDGE - FREQUENT)
        known = F.col("h").isin([int(x) for x in as_long(frequent)])
        self.total = np.zeros(CLASSES)
        for r in counts.where(~known).groupBy(bucket.alias("c")).agg(F.sum("n").alias("n")).collect():
            self.total[r["c"]] = r["n"]
        # words by their counts' bits: where the count of more frequent ones would pass `near`, the table begins
        counts = counts.where(~known & (F.col("n") >= 2))
        by_bits = sorted(((r["b"], r["n"]) for r in counts.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        least, seen = 1 << 62, 0
        for b, n in by_bits:
            seen += n
            if seen > near:
                break
            least = 1 << b - 1
        got = counts.where(F.col("n") >= least).toArrow().sort_by("h")
        self.near, self.log_n = got["h"].to_numpy(), np.log(got["n"].to_numpy().astype(float))
        self.table = counts.where(F.col("n") < least)
        self.bloom = Bloom.build(self.table, "h")


def eighth(h: np.ndarray) -> np.ndarray:
    """Of the tokens of a chunk: which of the MASK parts masks each."""
    return (np.arange(len(h)) * 5 + h.astype(np.int64) % 97) % MASK


def parts_of(round_: int, rounds: int) -> list[int]:
    """The parts that a round masks; together the rounds mask all."""
    return [p for p in range(MASK) if p % rounds == round_] or [round_ % MASK]


def _trained(state, parts: list[int], rate: float, batch_size: int):
    """mapInArrow: (text) into (i, v, w): the task's parameters times its tokens, and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, frequent, place = state.value
        net, memory, seen = Network(vector.copy()), np.full(len(vector), 1e-6, np.float32), 0
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True):
                tokens = classes_of(chunk.hash, frequent, place)
                around, part = contexts(tokens, chunk.bound), eighth(chunk.hash)
                for p in parts:
                    masked = np.flatnonzero(part == p)
                    context, target = around[masked], tokens[masked]
                    for at in range(0, len(masked), batch_size):
                        net.step(context[at : at + batch_size], target[at : at + batch_size], rate, memory)
                    seen += len(masked)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vector))), pa.array(net.vector.astype(float) * seen), pa.array(np.full(len(vector), float(seen)))], ["i", "v", "w"])

    return run


class MaskedLm:
    """Trained on docs; the network's size is fixed, the words' counts are a table."""

    def __init__(self, docs: DataFrame, text_col: str = "text", rounds: int = 2, rate: float = 0.05, batch_size: int = 512, seed: int = 0, near: int = 1 << 14):
        texts, spark = docs.select(F.col(text_col).alias("text")), docs.sparkSession
        counts = cut(word_counts(texts))
        self.frequent, self.place = frequent_words(counts)
        self.shares = Shares(counts, self.frequent, self.place, near)
        self.network = Network.start(seed)
        for r in range(rounds):
            state = spark.sparkContext.broadcast((self.network.vector, self.frequent, self.place))
            each = texts.mapInArrow(_trained(state, parts_of(r, rounds), rate, batch_size), "i long, v double, w double")
            mean = cut(each.groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))).toArrow().sort_by("i")
            if mean.num_rows:
                self.network = Network(mean["v"].to_numpy().astype(np.float32))

    def _scored(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, row, n, classes, words, rest) of every row: the network's sum over classes, the sum of the shares' logarithms without
        those of the counts in the table, and the hashes that the table may have."""
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
        shares = self.shares
        state = docs.sparkSession.sparkContext.broadcast((self.network.vector, self.frequent, self.place, np.log(shares.total + 1), shares.near.view(np.uint64), shares.log_n, shares.bloom))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vector, frequent, place, log_total, near, log_n, bloom = state.value
            order = np.argsort(near)
            near, log_n = near[order], log_n[order]
            net = Network(vector)
            for batch in batches:
                total, share, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                rest, ends = [np.empty(0, np.int64)], np.zeros(batch.num_rows + 1, np.int64)
                for chunk in chunks(batch.column(1), lower=True):
                    tokens = classes_of(chunk.hash, frequent, place)
                    context, scores = contexts(tokens, chunk.bound), np.empty(len(tokens))
                    for at in range(0, len(tokens), 8192):
                        scores[at : at + 8192] = net.log_prob(context[at : at + 8192], tokens[at : at + 8192])
                    factor, other = -log_total[tokens], tokens >= FREQUENT
                    if len(near):
                        i = np.minimum(np.searchsorted(near, chunk.hash), len(near) - 1)
                        found = near[i] == chunk.hash
                        factor[found] += log_n[i[found]]
                        other &= ~found
                    at = np.flatnonzero(other)
                    at = at[bloom.has(as_long(chunk.hash[at]))]
                    rest.append(as_long(chunk.hash[at]))
                    here = slice(chunk.row, chunk.row + chunk.n)
                    ends[chunk.row + 1 : chunk.row + chunk.n + 1] = np.diff(np.searchsorted(at, chunk.bound))
                    n[here] = np.diff(chunk.bound)
                    for out, values in ((total, scores), (share, factor)):
                        out[here] = np.diff(np.concatenate([[0.0], np.cumsum(values)])[chunk.bound])
                rest = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(np.concatenate(rest)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(total), pa.array(share), rest], ["id", "row", "n", "classes", "words", "rest"])

        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row long, n long, classes double, words double, rest array<long>")

    @staticmethod
    def _named(scored: DataFrame, total, id_col: str) -> DataFrame:
        mean = F.when(F.col("n") > 0, F.round(total / F.col("n"), 6))
        return scored.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.round(total, 4).alias("log_likelihood"), mean.alias("mean_log_prob"))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, log_likelihood, mean_log_prob) of every row, of the network's classes instead of words."""
        return self._named(self._scored(docs, id_col, text_col), F.col("classes"), id_col)

    def score_words(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, n_tokens, log_likelihood, mean_log_prob) of every row: each word's class by the network times its share of the class."""
        # row numbers are those of the table that is written, whatever ran twice
        scored = cut(self._scored(docs, id_col, text_col))
        words = scored.select("row", F.explode("rest").alias("h")).join(self.shares.table, "h")
        more = words.groupBy("row").agg(F.sum(F.log("n")).alias("more"))
        both = scored.drop("rest").join(more, "row", "left")
        return self._named(both, F.col("classes") + F.col("words") + F.coalesce("more", F.lit(0.0)), id_col)
