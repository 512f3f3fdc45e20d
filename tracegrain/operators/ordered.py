"""Places and running sums in the order of a group's rows, for groups of any size.

Rows are dealt by ranges of (group, order), so a large group lies in many tasks. Each task counts and sums its own rows; only a part's first
group can go on from the part before, so one row for each part is enough to carry what came before. The driver adds up these rows: as many as there are
shuffle partitions, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .tables import cut


def changes(columns: list[pa.Array]) -> np.ndarray:
    """For all rows but the first: whether any column's value differs from the row before; null equals null."""
    out = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def runs(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, bool]]:
    """Of sorted batches: each with the places where a group's rows begin in it (from 0), and whether its first row goes on with the last one's group."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(g)) for g in group]
        starts = np.append(0, np.flatnonzero(changes(columns)) + 1)
        yield batch, starts, last == [c[0].as_py() for c in columns]
        last = [c[-1].as_py() for c in columns]


def scan(df: DataFrame, group: list[str], order: list[Column], step: Callable, schema: StructType, state: list[str]) -> tuple[DataFrame, list[Row]]:
    """df in ranges of (group, order), run through step(part, batches) and written; and the parts in order: part, the group of its first row, and
    group, n and the columns of state of its last one."""
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return step(TaskContext.get().partitionId(), batches)

    table = cut(ranged.mapInArrow(run, schema))
    ends = table.groupBy("part").agg(F.min(F.struct(*group)).alias("first"), F.max(F.struct(F.struct(*group).alias("group"), "n", *state)).alias("last"))
    return table, sorted(ends.collect(), key=lambda r: r.part)


def running(df: DataFrame, group: list[str], order: list[Column], sums: list[str] = [], previous: list[str] = [], latest: list[str] = []) -> DataFrame:  # noqa: B006
    """df with n, the row's place in its group from 1, run_<column> for each long column of sums: its sum up to this row, null as 0,
    prev_<column> for each column of previous: its value in the row before, null in a group's first row, and last_<column> for each column of
    latest: its value in this row or in the last row before that has one.

    order has to tell a group's rows apart but for rows that are equal in all that follows from them.
    """
    names = df.columns
    schema = StructType([*df.schema.fields]).add("part", IntegerType()).add("n", LongType())
    for s in sums:
        schema = schema.add(f"run_{s}", LongType())
    for p in previous:
        schema = schema.add(f"prev_{p}", df.schema[p].dataType)
    for c in latest:
        schema = schema.add(f"last_{c}", df.schema[c].dataType)

    def step(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had, last, kept = np.zeros(1 + len(sums), np.int64), [None] * len(previous), [None] * len(latest)
        for batch, starts, goes_on in runs(batches, group):
            if not goes_on:
                had[:] = 0
            size = np.diff(np.append(starts, batch.num_rows))
            columns = [np.ones(batch.num_rows, np.int64)] + [pc.fill_null(batch.column(batch.schema.get_field_index(s)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for s in sums]
            out = []
            for i, v in enumerate(columns):
                total = np.cumsum(v)
                before = total[starts] - v[starts]
                before[0] -= had[i]
                out.append(total - np.repeat(before, size))
                had[i] = out[-1][-1]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            shifted, at = [], np.arange(batch.num_rows) - 1
            for i, p in enumerate(previous):
                v = batch.column(batch.schema.get_field_index(p))
                before = pa.concat_arrays([v, pa.array([last[i] if goes_on else None], v.type)])
                at[starts[1:]] = -1
                shifted.append(before.take(pa.array(np.where(at < 0, len(v), at), mask=np.isin(np.arange(len(at)), starts[1:]))))
                last[i] = v[-1].as_py()
            for i, c in enumerate(latest):
                v = batch.column(batch.schema.get_field_index(c))
                at = np.where(pc.is_valid(v).to_numpy(zero_copy_only=False), np.arange(len(v)), -1)
                at = np.maximum.accumulate(at)
                at = np.where(at >= np.repeat(starts, size), at, -1)
                before = pa.concat_arrays([v, pa.array([kept[i] if goes_on else None], v.type)])
                first = np.arange(len(v)) < size[0]
                shifted.append(before.take(pa.array(np.where(at < 0, len(v), at), mask=(at < 0) & ~first)))
                kept[i] = shifted[-1][-1].as_py()
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(batch.num_rows, part, np.int32)), *map(pa.array, out), *shifted], schema.names)

    state = [f"run_{s}" for s in sums]
    table, ends = scan(df, group, order, step, schema, [*state, *previous, *(f"last_{c}" for c in latest)])
    carried, before, values, keeps, ended = [], [0] * (1 + len(sums)), [], [None] * len(latest), None
    for r in ends:
        if ended != r.first:
            before, keeps = [0] * len(before), [None] * len(latest)
        if any(before):
            carried.append((r.part, r.first, *before, *values, *keeps))
        here = [r["last"][c] for c in ("n", *state)]
        before = [a + b for a, b in zip(before, here, strict=True)] if r.first == r["last"]["group"] else here
        new = [r["last"][f"last_{c}"] for c in latest]
        keeps = [b if a is None and r.first == r["last"]["group"] else a for a, b in zip(new, keeps, strict=True)]
        ended, values = r["last"]["group"], [r["last"][p] for p in previous]
    if not carried:
        return table.drop("part")
    first = StructType([df.schema[g] for g in group])
    kept = StructType().add("part", IntegerType()).add("__first", first)
    for c in ("n", *state):
        kept = kept.add(f"__{c}", LongType())
    for p in previous:
        kept = kept.add(f"__prev_{p}", df.schema[p].dataType)
    for c in latest:
        kept = kept.add(f"__last_{c}", df.schema[c].dataType)
    more = df.sparkSession.createDataFrame(carried, kept)
    here = F.col("__first").isNotNull()
    for g in group:
        here &= F.col(g).eqNullSafe(F.col(f"__first.{g}"))
    added = {c: F.col(c) + F.when(here, F.col(f"__{c}")).otherwise(0) for c in ("n", *state)}
    added |= {f"prev_{p}": F.when(here & (F.col("n") == 1), F.col(f"__prev_{p}")).otherwise(F.col(f"prev_{p}")) for p in previous}
    added |= {f"last_{c}": F.when(here & F.col(f"last_{c}").isNull(), F.col(f"__last_{c}")).otherwise(F.col(f"last_{c}")) for c in latest}
    return table.join(F.broadcast(more), "part", "left").withColumns(added).select(*names, "n", *state, *(f"prev_{p}" for p in previous), *(f"last_{c}" for c in latest))
