"""Detection: all rules over events in one scan, then correlations over their matches and over each other, and what they give as findings.

Events have id, micros, event_type and, where they have them, ENTITY columns and rel_path, sha256 and line_number of their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import span_micros
from . import correlate
from .rules import Correlation, RuleSet, matches
from .tables import cut

ENTITY = ("actor", "src_ip", "dst_ip", "target", "host")
COLUMNS = ("rule_key", "id", "micros", "first_micros", "n_events", "peak", "event_type", *ENTITY, "rel_path", "sha256", "line_number")


def _with(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.withColumns({k: F.lit(None).cast(t) for k, t in types.items() if k not in df.columns})


def correlated(found: DataFrame, c: Correlation, names: list[str]) -> DataFrame:
    """The matches of a correlation: a row for each cluster or window, dated by its last event; entities that differ within it are null."""
    keys = list(c.group_by)
    inside, unit = _inside(found, c, names)
    first = F.min_by(F.struct("rel_path", "sha256", "line_number"), F.struct("micros", "id"))
    figures = [F.min("micros").alias("first_micros"), F.max("micros").alias("__to"), F.max("__n").alias("n_events"), F.max("__peak").alias("peak")]
    out = inside.groupBy(*keys, *unit).agg(F.min("id").alias("id"), *figures, *(correlate.constant(e) for e in (*ENTITY, "event_type") if e not in keys), first.alias("src")).withColumnRenamed("__to", "micros")
    return out.withColumn("rule_key", F.lit(c.name)).select("*", "src.*").drop("src").select(*COLUMNS)


def _inside(found: DataFrame, c: Correlation, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows of found within each match of a correlation, with __n and __peak of the match, and the columns that beside the keys tell matches apart.

    Rows meet their match by its number in their key, so no interval is searched.
    """
    keys, span = list(c.group_by), span_micros(c.timespan)
    rows = found.where(F.col("rule_key").isin(names))
    if c.kind in ("event_count", "value_count"):
        if c.kind == "event_count":
            met = correlate.event_count(rows, keys, span, c.test[1], c.test[0])
        else:
            met = correlate.value_count(rows, keys, c.field, span, c.test[1], c.test[0])
        met = met.select(*keys, "cluster", F.col("n_events").alias("__n"), F.col("peak").alias("__peak"))
        return correlate.clustered(rows, keys, span).join(met, [*keys, "cluster"]), ["cluster"]
    members = cut(correlate.temporal_members(rows, keys, names, span, c.kind == "temporal_ordered"))
    sizes = members.groupBy(*keys, "cluster", "a").agg(F.count(F.lit(1)).alias("__n"))
    met = members.select(*keys, "cluster", "a", "rule_key", "id", "micros").join(sizes, [*keys, "cluster", "a"])
    return rows.join(met, [*keys, "rule_key", "id", "micros"]).withColumn("__peak", F.lit(None).cast("long")), ["cluster", "a"]


def hits(events: DataFrame, rule_set: RuleSet) -> DataFrame:
    """(rule_key, id, micros, ...): all matches of rules (one event each) and correlations, those of correlations that feed others included."""
    events = _with(events, {e: "string" for e in (*ENTITY, "event_type", "rel_path", "sha256")} | {"line_number": "int"})
    found = matches(events, rule_set.rules).withColumns({"first_micros": F.col("micros"), "n_events": F.lit(1).cast("long"), "peak": F.lit(None).cast("long")}).select(*COLUMNS)
    for c in rule_set.correlations:
        found = found.unionByName(correlated(found, c, rule_set.names(c)))
    return found


def members(events: DataFrame, found: DataFrame, c: Correlation, names: list[str], rule_set: RuleSet) -> DataFrame:
    """(rule_key, id, first_micros, keys, event_id): the events within each match of a correlation over rules."""
    keys = list(c.group_by)
    mine = found.where(F.col("rule_key") == c.name).select("rule_key", "id", "first_micros", *keys)
    rows = _with(matches(events, [r for r in rule_set.rules if r.name in names]), {e: "string" for e in (*ENTITY, "event_type", "rel_path", "sha256")} | {"line_number": "int"})
    inside, unit = _inside(rows, c, names)
    inside = cut(inside.select(*keys, *unit, F.col("id").alias("event_id"), "micros"))
    began = inside.groupBy(*keys, *unit).agg(F.min("micros").alias("first_micros"))
    return inside.join(began, [*keys, *unit]).join(mine, [*keys, "first_micros"]).select("rule_key", "id", "first_micros", *keys, "event_id").distinct()
