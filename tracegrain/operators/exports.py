"""What leaves: events and findings as JSON lines, indicators as STIX objects, a manifest, the figures and limits of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import iso
from . import findings as of_findings
from .iocs import ordered, reportable, stix_pattern
from .timeline import as_json

#: A name space of this package's own for names that are the same whenever the same content is exported.
NAMESPACE = "8a3cf1d2-5f0e-5b7a-9c43-2d1e6f7a8b90"


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a name in a name space."""
    digest = F.sha1(F.concat(F.lit(bytearray.fromhex(namespace.replace("-", ""))), name.cast("binary")))
    top = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lower(F.hex(top.cast("long"))), F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def stix_id(kind: str, *parts: Column | str) -> Column:
    named = F.concat_ws("|", F.lit(kind), *(F.lit(p) if isinstance(p, str) else p for p in parts))
    return F.concat(F.lit(f"{kind}--"), uuid5(NAMESPACE, named))


def events_json(events: DataFrame) -> DataFrame:
    """(value): a JSON line for each event, in the order of the timeline; for DataFrameWriter.text()."""
    return as_json(events).orderBy(F.col("micros").asc_nulls_last(), "id").select(F.col("json").alias("value"))


def findings_json(findings: DataFrame, links: DataFrame, with_rejected: bool = False) -> DataFrame:
    """(value): a JSON object for each finding, with the ids of its events; links: (fingerprint, event_id)."""
    rows = findings if with_rejected or "status" not in findings.columns else findings.where("status != 'rejected'")
    ids = links.groupBy("fingerprint").agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"))
    columns = sorted(c for c in rows.columns)
    return of_findings.ordered(rows.join(ids, "fingerprint", "left")).select(F.to_json(F.struct(*columns, "event_ids")).alias("value"))


def stix_indicators(iocs: DataFrame, case: str, created: str) -> DataFrame:
    """(id, json): a STIX 2.1 indicator for each reportable one that has a pattern."""
    rows = reportable(iocs).withColumn("pattern", stix_pattern()).where("pattern is not null")
    ident = stix_id("indicator", case, F.col("type"), F.col("value"))
    kind = F.when(F.col("verdict") == "malicious", "malicious-activity").otherwise("anomalous-activity")
    seen = lambda c: F.coalesce(F.replace(iso(F.col(c)), F.lit("+00:00"), F.lit("Z")), F.lit(created))
    body = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), F.concat_ws(": ", "type", "value").alias("name"), "pattern",
        F.lit("stix").alias("pattern_type"), seen("first_micros").alias("valid_from"), F.array(kind).alias("indicator_types"), F.concat(F.lit("Verdict: "), F.col("verdict"), F.lit("; last seen "), seen("last_micros")).alias("description"),
    )
    return rows.select(ident.alias("id"), F.to_json(body).alias("json"))


def stix_techniques(findings: DataFrame, case: str, created: str) -> DataFrame:
    """(id, json): a STIX 2.1 attack pattern for each technique of the findings, with its tactics."""
    rows = findings.select(F.explode("techniques").alias("technique")).distinct().join(F.broadcast(of_findings.techniques(findings.sparkSession)), "technique", "left")
    rows = rows.groupBy("technique").agg(F.array_sort(F.collect_set(F.translate("tactic", "_", "-"))).alias("tactics"))
    phases = F.transform("tactics", lambda t: F.struct(F.lit("mitre-attack").alias("kill_chain_name"), t.alias("phase_name")))
    ident = stix_id("attack-pattern", case, F.col("technique"))
    body = F.struct(
        F.lit("attack-pattern").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), F.col("technique").alias("name"),
        F.array(F.struct(F.lit("mitre-attack").alias("source_name"), F.col("technique").alias("external_id"))).alias("external_references"), phases.alias("kill_chain_phases"),
    )
    return rows.select(ident.alias("id"), F.to_json(body).alias("json"))


def stix_bundle(iocs: DataFrame, findings: DataFrame, case: str, created: str) -> DataFrame:
    """(id, json) of all objects: attack patterns, indicators, and the report that refers to them; each is a line, for a bundle's `objects`."""
    objects = stix_techniques(findings, case, created).unionByName(stix_indicators(iocs, case, created))
    refs = objects.agg(F.array_sort(F.collect_list("id")).alias("refs"))
    ident = stix_id("report", case)
    body = F.struct(F.lit("report").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit(created).alias("created"), F.lit(created).alias("modified"), F.lit(created).alias("published"), F.lit(f"Investigation: {case}").alias("name"), F.col("refs").alias("object_refs"))
    return objects.unionByName(refs.select(ident.alias("id"), F.to_json(body).alias("json")))


def manifest(scanned: DataFrame) -> DataFrame:
    """(value): the evidence's files as JSON lines, by path."""
    return scanned.orderBy("rel_path").select(F.to_json(F.struct("rel_path", "kind", "size", "sha256", "md5", "symlink_target", "note")).alias("value"))


def write_manifest(scanned: DataFrame, path: str) -> str:
    """Writes the manifest as one file that is there whole or not at all, and gives its SHA-256; lines pass one by one."""
    import hashlib
    import os

    total, part = hashlib.sha256(), f"{path}.part"
    with open(part, "wb") as f:
        for r in manifest(scanned).toLocalIterator():
            line = r.value.encode() + b"\n"
            total.update(line)
            f.write(line)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return total.hexdigest()


def figures(events: DataFrame) -> DataFrame:
    """(artifact_type, n_events, n_errors, n_undated, n_assumed, n_inferred, first_micros, last_micros, hosts): a row for each kind of log."""
    return events.groupBy("artifact_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "parse_error").alias("n_errors"), F.count_if(F.col("micros").isNull()).alias("n_undated"), F.count_if(F.col("timezone_assumed")).alias("n_assumed"),
        F.count_if(F.array_contains("tags", "year_inferred")).alias("n_inferred"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.count_distinct("host").alias("hosts"),
    )


def limitations(figures_: DataFrame, outcomes: DataFrame, findings: DataFrame, iocs: DataFrame) -> DataFrame:
    """(topic, detail, n): what limits what a report can say. outcomes: (rel_path, status) of files; each line is one aggregate."""
    line = lambda topic, detail: F.struct(F.lit(topic).alias("topic"), detail.alias("detail"))
    of = lambda c, topic: figures_.where(F.col(c) > 0).select(F.lit(topic).alias("topic"), F.col("artifact_type").alias("detail"), F.col(c).alias("n"))
    out = of("n_assumed", "time zone assumed").unionByName(of("n_inferred", "year inferred")).unionByName(of("n_undated", "undated events")).unionByName(of("n_errors", "lines that couldn't be read"))
    bad = outcomes.where(F.col("status").isin("unclassified", "unsupported", "error")).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_set("rel_path")), 1, 20).alias("p"))
    out = out.unionByName(bad.select(F.concat(F.lit("files "), F.col("status")).alias("topic"), F.array_join("p", ", ").alias("detail"), "n"))
    gaps = findings.where(F.col("rule_id").endswith("log_gap")).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("gaps in logs").alias("topic"), F.lit("logs were silent longer than usual").alias("detail"), "n")
    none = iocs.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array_compact(F.array(F.when(F.col("n") == 0, line("no indicators", F.lit("nothing could be looked up")))))).alias("x"), "n").select("x.*", "n")
    held = iocs.where(F.array_contains("tags", "internal") | F.array_contains("tags", "private") | F.col("type").isin("username", "path", "url")).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("indicators not sent out").alias("topic"), F.lit("internal, private or personal").alias("detail"), "n")
    return out.unionByName(gaps).unionByName(none).unionByName(held)
