"""Quality classifier: cumulative-link regression on graded ratings.

Grades 0 to K share one weight for each feature; ordered thresholds t_1 < ... < t_K give
P(grade >= k) = sigmoid(score - t_k). The sum of these is the expected grade, the last one that is asked for the tail
probability for selection. Features are the hashed words of the whole text (each once), and the shares of words by
their last byte. Of the words those get a weight whose presence depends on the grade, by a chi-squared test on the
sample: the many words that a few rated texts have explain those texts only. Weights are fitted in numpy on a bounded sample of the ratings, `max_labelled`, of the lowest hashes of
the id; all rows are scored where they lie, in one scan without a shuffle.

Cases: a null text is empty; an empty text is scored by the thresholds alone. Ratings that are null, or whose id has no
document, don't count; an id rated twice takes its lower grade. With fewer than two grades among the ratings every text gets
the one grade (0 if there is none). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import chunks

BITS = 18
LAST = 1 << BITS  # the shares' features follow
SHARE = 8.0
#: Chi-squared from which a word's presence counts as dependent on the grade.
DEPENDENT = 25.0


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each entry from 0, feature, value) of some rows at a time."""
    for chunk in chunks(column, lower=True):
        lengths = np.diff(chunk.bound)
        row = np.repeat(np.arange(chunk.n), lengths)
        pair = np.unique((row << BITS) | (chunk.hash >> np.uint64(64 - BITS)).astype(np.int64))
        last, count = np.unique(row << 8 | chunk.data[chunk.end - 1], return_counts=True)
        yield chunk.row, chunk.n, np.concatenate([pair >> BITS, last >> 8]), np.concatenate([pair & (LAST - 1), LAST + (last & 255)]), np.concatenate([np.ones(len(pair)), SHARE * count / lengths[last >> 8]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def dependent_words(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, least: float = DEPENDENT) -> np.ndarray:
    """Which features count: the words whose presence depends on the grade, and all shares."""
    size = np.bincount([g for _, _, g in rows], minlength=grades).astype(float)
    seen = np.array([np.bincount(np.concatenate([f for f, _, g in rows if g == k] or [np.empty(0, np.int64)]), minlength=LAST + 256) for k in range(grades)], float)
    share = seen.sum(axis=0) / size.sum()
    due = size[:, None] * share
    chi2 = ((seen - due) ** 2 / np.maximum(due * (1 - share), 1e-9)).sum(axis=0)
    chi2[LAST:] = np.inf
    return chi2 >= least


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, epochs: int = 20, rate: float = 0.1, decay: float = 1e-4, batch: int = 64, seed: int = 0) -> Ordinal:
    """Of (features, values, grade): by adaptive gradient steps on the likelihood; thresholds are kept in order by their gaps' logarithms."""
    rng, counts = np.random.default_rng(seed), dependent_words(rows, grades)
    rows = [(f[counts[f]], v[counts[f]], g) for f, v, g in rows]
    w, g2 = np.zeros(LAST + 256), np.full(LAST + 256, 1e-6)
    base, gaps = np.zeros(1), np.zeros(max(0, grades - 2))
    b2 = np.full(grades - 1, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[i] for i in order[at : at + batch]]
            f, v = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            doc = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            y = np.array([r[2] for r in part])
            t = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
            score = np.bincount(doc, w[f] * v, minlength=len(part))
            tail = _sigmoid(score[:, None] - t)  # P(y >= k), k from 1
            full = np.concatenate([np.ones((len(part), 1)), tail, np.zeros((len(part), 1))], axis=1)
            rows_ = np.arange(len(part))
            p = np.maximum(full[rows_, y] - full[rows_, y + 1], 1e-9)
            slope = np.concatenate([np.zeros((len(part), 1)), tail * (1 - tail), np.zeros((len(part), 1))], axis=1)
            d_score = -(slope[rows_, y] - slope[rows_, y + 1]) / p / len(part)
            d_t = np.zeros(grades - 1)
            np.add.at(d_t, y[y > 0] - 1, (slope[rows_, y] / p)[y > 0] / len(part))
            np.add.at(d_t, y[y < grades - 1], -(slope[rows_, y + 1] / p)[y < grades - 1] / len(part))
            seen, inverse = np.unique(f, return_inverse=True)
            grad = np.bincount(inverse, d_score[doc] * v) + decay * w[seen]
            g2[seen] += grad**2
            w[seen] -= rate * grad / np.sqrt(g2[seen])
            d_base = np.array([d_t.sum(), *(np.exp(gaps) * np.cumsum(d_t[::-1])[::-1][1:])])
            b2 += d_base**2
            step = rate * d_base / np.sqrt(b2)
            base, gaps = base - step[:1], gaps - step[1:]
    return Ordinal(w, np.concatenate([base, base + np.cumsum(np.exp(gaps))]))


def labelled_sample(docs: DataFrame, ratings: DataFrame, id_col: str, text_col: str, grade_col: str, max_labelled: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of at most max_labelled rated documents, those of the lowest hashes of their ids."""
    chosen = ratings.where(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(grade_col).cast("int").alias("__grade"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled)
    met = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select(F.col(id_col).alias("id"), "__grade")), "id")
    # of rows that share an id the one of the least text, so the sample is the same in each run
    found = met.groupBy("id").agg(F.min(F.struct(F.sha2(F.col("text").cast("binary"), 256).alias("s"), "text", "__grade")).alias("x")).select(F.xxhash64("id").alias("o"), "x.text", F.col("x.__grade").alias("grade"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature, value = [[]] * batch.num_rows, [[]] * batch.num_rows
            for first, n, row, f, v in _features(batch.column(1)):
                order = np.argsort(row, kind="stable")
                ends = np.searchsorted(row[order], np.arange(n + 1))
                for i in range(n):
                    part = order[ends[i] : ends[i + 1]]
                    feature[first + i], value[first + i] = f[part].astype(np.int32), v[part].astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feature, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["o", "grade", "feature", "value"])

    got = found.mapInArrow(run, "o long, grade int, feature array<int>, value array<float>").toArrow().sort_by("o")
    return [(f.values.to_numpy(), v.values.to_numpy().astype(float), g.as_py()) for f, v, g in zip(got["feature"], got["value"], got["grade"], strict=True)]


def rate(docs: DataFrame, ratings: DataFrame, grade: Column | str, id_col: str = "doc_id", text_col: str = "text", least: int | None = None, max_labelled: int = 20000) -> DataFrame:
    """docs with expected_grade and tail_prob, the probability of grade `least` (the highest if None) or more.

    grade: a column of ratings, whole numbers from 0.
    """
    rows = labelled_sample(docs, ratings.withColumn("__g", F.col(grade) if isinstance(grade, str) else grade), id_col, text_col, "__g", max_labelled)
    grades = max((g for _, _, g in rows), default=0) + 1
    one = len({g for _, _, g in rows}) < 2
    model = docs.sparkSession.sparkContext.broadcast(None if one else fit(rows, grades))
    k = (grades - 1 if least is None else least) - 1

    @F.pandas_udf("struct<expected_grade: double, tail_prob: double>")
    def score(text):
        import pandas as pd

        if model.value is None:
            return pd.DataFrame({"expected_grade": np.full(len(text), float(grades - 1)), "tail_prob": np.full(len(text), float(k < grades - 1))})
        out = np.zeros(len(text))
        for first, n, row, f, v in _features(pa.array(text, pa.large_string(), from_pandas=True)):
            out[first : first + n] = np.bincount(row, model.value.weights[f] * v, minlength=n)
        tails = model.value.tails(out)
        tail = tails[:, k] if 0 <= k < tails.shape[1] else np.full(len(text), float(k < 0))
        return pd.DataFrame({"expected_grade": np.round(tails.sum(axis=1), 6), "tail_prob": np.round(tail, 6)})

    return docs.withColumn("__s", score(text_col)).withColumns({"expected_grade": F.col("__s.expected_grade"), "tail_prob": F.col("__s.tail_prob")}).drop("__s")
