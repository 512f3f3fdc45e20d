"""Correlations over rule matches: counts in sliding windows, and sequences.

Input: rows with rule_key, id, micros (null: dropped) and the key columns (rows with a null key are dropped).
A cluster is a run of a key's rows without a gap above the span; no window reaches over such a gap.

A key may hold most of all rows. So a key's time is cut into buckets of BUCKETS spans, tasks order the rows of one bucket, and what
passes from bucket to bucket (the last time, running sums) is summed over the buckets, of which there are few.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running
from .tables import cut

IDENTITY = ("micros", "actor", "src_ip", "event_type")
BUCKETS = 64
COMPARE = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}


def _bucket(micros: str | Column, span: int | Column) -> Column:
    length = F.greatest(span, F.lit(1)) * BUCKETS if isinstance(span, Column) else F.lit(max(1, span) * BUCKETS)
    return F.floor((F.col(micros) if isinstance(micros, str) else micros) / length)


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    other = b.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    test = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return a.join(other, test).drop(*(f"__k{i}" for i in range(len(keys))))


def _clusters(rows: DataFrame, keys: list[str], span: int | str) -> DataFrame:
    """Dated rows with cluster, from 1 in each key. span: micros, or a column with a key's own."""
    if isinstance(span, str):
        rows = rows.withColumn("__span", F.col(span))
        span = F.col("__span")
    rows = rows.withColumn("__b", _bucket("micros", span))
    order = Window.partitionBy(*keys, "__b").orderBy("micros", "id")
    new = F.coalesce((F.col("micros") - F.lag("micros").over(order) > span).cast("int"), F.lit(0))
    rows = rows.withColumn("__new", new).withColumn("__news", F.sum("__new").over(order))
    more = [F.first("__span").alias("__span")] if isinstance(span, Column) else []
    buckets = rows.groupBy(*keys, "__b").agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.max("__news").alias("news"), *more)
    by_key = Window.partitionBy(*keys).orderBy("__b")
    starts = F.coalesce((F.col("first") - F.lag("last").over(by_key) > span).cast("int"), F.lit(1))
    buckets = buckets.withColumn("__starts", starts).withColumn("__before", F.sum(F.col("__starts") + F.col("news")).over(by_key) - F.col("news"))
    out = _join(rows, buckets.select(*keys, "__b", "__before"), [*keys, "__b"])
    return out.withColumn("cluster", F.col("__before") + F.col("__news")).drop("__b", "__new", "__news", "__before", "__span")


def clustered(rows: DataFrame, keys: list[str], span: int) -> DataFrame:
    """rows with cluster, from 1 in each key."""
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.col("micros").isNotNull()))
    return _clusters(rows, keys, span)


def with_sessions(rows: DataFrame, keys: list[str], span: int | str) -> DataFrame:
    """rows with cluster (span: micros, or a column with a key's own); undated rows of a key are one more, cluster 0. Null keys are a key of their own."""
    return _clusters(rows.where("micros is not null"), keys, span).unionByName(rows.where("micros is null").withColumn("cluster", F.lit(0).cast("long")))


def sessions(rows: DataFrame, keys: list[str], span: int) -> DataFrame:
    """A row for each cluster of with_sessions()."""
    return with_sessions(rows, keys, span).groupBy(*keys, "cluster").agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.count(F.lit(1)).alias("n_events"))


def _running(deltas: DataFrame, keys: list[str], span: int) -> DataFrame:
    """(keys, micros, now): of deltas (keys, micros, d) the sum of all up to each time."""
    at = deltas.groupBy(*keys, "micros").agg(F.sum("d").alias("d")).withColumn("__b", _bucket("micros", span))
    inside = at.withColumn("__sum", F.sum("d").over(Window.partitionBy(*keys, "__b").orderBy("micros")))
    totals = at.groupBy(*keys, "__b").agg(F.sum("d").alias("t"))
    totals = totals.withColumn("__before", F.sum("t").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("t")).drop("t")
    return inside.join(totals, [*keys, "__b"]).select(*keys, "micros", (F.col("__sum") + F.col("__before")).alias("now"))


def _peaks(rows: DataFrame, active: DataFrame, keys: list[str], span: int, threshold: float, test: str) -> DataFrame:
    """Clusters of rows, with their peak: the most that is active at the time of one of their rows. active: (keys, start, end), the end left out."""
    deltas = active.select(*keys, F.col("start").alias("micros"), F.lit(1).cast("long").alias("d")).unionByName(active.select(*keys, F.col("end").alias("micros"), F.lit(-1).cast("long").alias("d")))
    now = _running(deltas, keys, span)
    out = clustered(rows, keys, span).join(now, [*keys, "micros"])
    out = out.groupBy(*keys, "cluster").agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.count(F.lit(1)).alias("n_events"), F.max("now").alias("peak"))
    return out.where(COMPARE[test](F.col("peak"), threshold))


def event_count(rows: DataFrame, keys: list[str], span: int, threshold: float, test: str = "gte") -> DataFrame:
    """Clusters whose largest number of distinct events within a span passes the test. Events that are the same by IDENTITY count once."""
    distinct = rows.where("micros is not null").groupBy(*dict.fromkeys((*keys, *IDENTITY))).agg(F.min("id").alias("id"))
    active = distinct.select(*keys, F.col("micros").alias("start"), (F.col("micros") + span + 1).alias("end"))
    return _peaks(distinct, active, keys, span, threshold, test)


def value_count(rows: DataFrame, keys: list[str], field: str, span: int, threshold: float, test: str = "gte") -> DataFrame:
    """Clusters whose largest number of distinct values of a field within a span passes the test; null is no value.

    A value counts from each time that it occurs until it occurs again or a span has passed, so no set of values is gathered.
    """
    seen = rows.where(F.col("micros").isNotNull() & F.col(field).isNotNull()).select(*keys, F.col(field).alias("__v"), "micros").distinct()
    after = F.lead("micros").over(Window.partitionBy(*keys, "__v").orderBy("micros"))
    active = seen.select(*keys, F.col("micros").alias("start"), F.least(after, F.col("micros") + span + 1).alias("end"))
    # times at which only rows without a value are still have what is active then
    nothing = rows.where("micros is not null").select(*keys, F.col("micros").alias("start"), F.col("micros").alias("end"))
    return _peaks(rows, active.unionByName(nothing), keys, span, threshold, test)


def distinct_values(rows: DataFrame, found: DataFrame, keys: list[str], field: str, span: int) -> DataFrame:
    """(keys, cluster, value): the field's values in each cluster that value_count() found, sorted by who reads them."""
    return clustered(rows, keys, span).join(found.select(*keys, "cluster"), [*keys, "cluster"], "left_semi").where(F.col(field).isNotNull()).select(*keys, "cluster", F.col(field).alias("value")).distinct()


def _chosen(starts: DataFrame, group: list[str]) -> DataFrame:
    """Of windows (group, a, b: places from a on, b left out) those taken from left to right without overlap, by pointer doubling.

    Each window points to the first that begins at or behind its end. A group's first window is reached; each round adds what all that is reached points to, and
    the pointers go twice as far in the next. So there are as many rounds as the logarithm of the windows that are taken.
    """
    ahead = starts.select(*group, F.col("b").alias("at"), F.lit(0).alias("kind"), "a", F.lit(0).cast("long").alias("one"))
    both = ahead.unionByName(starts.select(*group, F.col("a").alias("at"), F.lit(1).alias("kind"), "a", F.lit(1).cast("long").alias("one")))
    told = running(both, group, [F.col("at"), F.col("kind"), F.col("a")], ["one"])
    nodes = told.groupBy(*group, "a").agg(F.max(F.when(F.col("kind") == 1, F.col("run_one"))).alias("i"), F.max(F.when(F.col("kind") == 0, F.col("run_one") + 1)).alias("to"), F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("b"))
    nodes = cut(nodes)
    jump = nodes.select(*group, "i", "to")
    reached = jump.where("i = 1").select(*group, "i")
    while True:
        new = cut(reached.join(jump, [*group, "i"]).select(*group, F.col("to").alias("i")).join(nodes.select(*group, "i"), [*group, "i"], "left_semi"))
        if new.isEmpty():
            return nodes.join(reached, [*group, "i"], "left_semi").select(*group, "a", "b")
        reached = cut(reached.unionByName(new))
        jump = cut(jump.join(jump.select(*group, F.col("i").alias("to"), F.col("to").alias("further")), [*group, "to"]).select(*group, "i", F.col("further").alias("to")))


def temporal_members(rows: DataFrame, keys: list[str], rules: list[str], span: int, ordered: bool = False) -> DataFrame:
    """Of windows of a span in which every rule matches (ordered: first matches in the rules' order), taken from left to right without overlap:
    (keys, cluster, a, rule_key, id, micros), a row for each match within; a tells a cluster's windows apart.

    A window starts at a row and takes all rows up to a span later; after one that holds, the next starts behind it. Rows at one time are in the order of
    their ids and of the rules. Places, ends of spans, next matches and windows are told by sums over ranges of time (ordered.py), so a key's rows lie in many tasks.
    """
    rows = clustered(rows.where(F.col("rule_key").isin(rules)), keys, span)
    group = [*keys, "cluster"]
    rank = F.array_position(F.array(*map(F.lit, rules)), F.col("rule_key")).cast("int") - 1
    own = rows.select(*group, "id", rank.alias("rule"), F.col("micros").alias("at"), F.lit(0).alias("kind"), F.lit(1).cast("long").alias("one"))
    both = own.unionByName(own.withColumns({"at": F.col("at") + span, "kind": F.lit(1), "one": F.lit(0).cast("long")}))
    told = running(both, group, [F.col(c) for c in ("at", "kind", "id", "rule")], ["one"])
    row, end = F.col("kind") == 0, F.col("kind") == 1
    placed = told.groupBy(*group, "id", "rule").agg(F.max(F.when(row, F.col("run_one") - 1)).alias("rn"), F.max(F.when(end, F.col("run_one"))).alias("end"), F.max(F.when(row, F.col("at"))).alias("micros"))
    placed = placed.withColumns({f"p{i}": F.when(F.col("rule") == i, F.col("rn")) for i in range(len(rules))})
    first = [F.col(f"last_p{i}") for i in range(len(rules))]
    ahead = running(placed, group, [F.col("rn").desc()], latest=[f"p{i}" for i in range(len(rules))])
    ok = reduce(lambda a, b: a & b, (F.coalesce(p < F.col("end"), F.lit(False)) for p in first))
    if ordered:
        ok = reduce(lambda a, b: a & b, (p < q for p, q in zip(first, first[1:], strict=False)), ok)
    ahead = ahead.select(*group, "id", "rule", "rn", "end", "micros", ok.alias("ok"))
    windows = _chosen(ahead.where("ok").select(*group, F.col("rn").alias("a"), F.col("end").alias("b")), group)
    marked = ahead.drop("end", "ok").join(windows.withColumn("rn", F.col("a")), [*group, "rn"], "left")
    inside = running(marked, group, [F.col("rn")], latest=["a", "b"]).where("rn < last_b")
    return inside.select(*group, F.col("last_a").alias("a"), F.get(F.array(*map(F.lit, rules)), F.col("rule")).alias("rule_key"), "id", "micros")


def temporal(rows: DataFrame, keys: list[str], rules: list[str], span: int, ordered: bool = False) -> DataFrame:
    """A row for each window of temporal_members()."""
    inside = temporal_members(rows, keys, rules, span, ordered)
    return inside.groupBy(*keys, "cluster", "a").agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.count(F.lit(1)).alias("n_events")).drop("a")


def constant(name: str) -> Column:
    """An aggregate: the only value of a column, null if it has several or none."""
    return F.when(F.min(name) == F.max(name), F.min(name)).alias(name)


def first_refs(rows: DataFrame, keys: list[str], ref: Column, k: int = 5) -> DataFrame:
    """(keys, refs): of each key's rows the first k references, in the order of time.

    The rank is compared to a constant, so the optimizer has every task keep the first k rows of a key before any shuffle: of a key no more than k rows a task meet.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("micros").asc_nulls_last(), "id")
    first = rows.withColumn("__ref", ref).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__ref"))), lambda x: x["__ref"]).alias("refs"))
