"""Findings: drafts from matches, stable fingerprints, merging with those of an earlier run, review, coverage of techniques."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import iso, span_micros
from .correlate import constant, first_refs, sessions, with_sessions
from .rules import LEVELS, Correlation, Rule, RuleSet

# How a label names an entity's parts, and the tactics in their order with the phase of response to each.
PHRASES = {"src_ip": "from ", "actor": "by ", "host": "on ", "target": "target ", "dst_ip": "to "}
TACTICS = (
    "reconnaissance", "resource_development", "initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion", "credential_access", "discovery", "lateral_movement", "collection", "command_and_control",
    "exfiltration", "impact",
)
PHASES = ("immediate", "short_term", "long_term")
PHASE_OF = {t: "immediate" for t in ("command_and_control", "exfiltration", "impact", "lateral_movement", "credential_access")} | {t: "short_term" for t in ("initial_access", "execution", "persistence", "privilege_escalation", "defense_evasion", "collection")}
#: Techniques of the bundled rules and their tactics.
TECHNIQUES = {
    "T1003": ("credential_access",), "T1021.004": ("lateral_movement",), "T1027": ("defense_evasion",), "T1053.003": ("execution", "persistence", "privilege_escalation"), "T1059.004": ("execution",), "T1070.002": ("defense_evasion",), "T1070.003": ("defense_evasion",),
    "T1070.006": ("defense_evasion",), "T1078": ("defense_evasion", "persistence", "privilege_escalation", "initial_access"), "T1083": ("discovery",), "T1098": ("persistence", "privilege_escalation"), "T1098.004": ("persistence", "privilege_escalation"), "T1105": ("command_and_control",),
    "T1110": ("credential_access",), "T1110.003": ("credential_access",), "T1136.001": ("persistence",), "T1190": ("initial_access",), "T1505.003": ("persistence",), "T1543.002": ("persistence", "privilege_escalation"), "T1546.004": ("persistence", "privilege_escalation"),
    "T1547.006": ("persistence", "privilege_escalation"), "T1548.003": ("defense_evasion", "privilege_escalation"), "T1552.001": ("credential_access",), "T1562.001": ("defense_evasion",), "T1595.002": ("reconnaissance",), "T1567": ("exfiltration",), "T1036.005": ("defense_evasion",),
}


def fingerprint(*parts: str | Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null is an empty part."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts)), 256)


def entity_key(keys: list[str]) -> Column:
    """key=value for each key, joined by a bar; of a null the value is the word None."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys))


def entity_label(keys: list[str]) -> Column:
    """What a finding is about: `from ADDRESS by USER on HOST`, of those parts that are there."""
    return F.concat_ws(" ", *(F.concat(F.lit(PHRASES[k]), F.col(k)) for k in dict.fromkeys((*keys, "host")) if k in PHRASES))


def drafts(matches: DataFrame, rules: list[Rule], keys: list[str], gap: int) -> DataFrame:
    """A finding for each rule, entity and cluster of its matches."""
    spark = matches.sparkSession
    facts = spark.createDataFrame([(r.name, r.title, r.level, LEVELS.index(r.level), float(r.confidence), list(r.techniques)) for r in rules if r.generate], "rule_key string, rule_title string, severity string, severity_rank int, confidence double, techniques array<string>")
    found = sessions(matches, ["rule_key", *keys], gap).join(F.broadcast(facts), "rule_key")
    label = F.concat_ws(" ", *(F.concat(F.lit(PHRASES.get(k, "")), F.col(k).cast("string")) for k in keys))
    return found.withColumn("fingerprint", fingerprint("rule_key", *keys, "first_micros")).withColumn("title", F.concat_ws(" - ", "rule_title", label)).drop("rule_title")


COLUMNS = ("fingerprint", "rule_id", "title", "severity", "severity_rank", "confidence", "techniques", "recommendation", "narrative", "context", "first_micros", "last_micros", "n_events")


def _facts(spark, rule_set: RuleSet) -> DataFrame:
    """What rules that report say of themselves, a row each: as many as there are rules."""
    rows = [
        (r.name, r.id, r.title, r.level, LEVELS.index(r.level), float(r.confidence), list(r.techniques), r.recommendation, r.description, "; ".join(r.false_positives), list(r.group_by), span_micros(r.cluster_gap), isinstance(r, Correlation))
        for r in rule_set.reported()
    ]
    return F.broadcast(spark.createDataFrame(rows, "rule_key string, rule_uuid string, rule_title string, severity string, severity_rank int, confidence double, techniques array<string>, recommendation string, about string, known string, by array<string>, span long, correlated boolean"))


def _narrative(label: Column) -> Column:
    n, first, last = (F.col(c) for c in ("n_events", "first_micros", "last_micros"))
    when = F.when(first.isNull(), "(undated evidence)").when(first == last, F.concat(F.lit("at "), iso(first))).otherwise(F.concat(F.lit("between "), iso(first), F.lit(" and "), iso(last)))
    shown = F.size("refs")
    more = F.when((shown > 0) & (n > shown), F.concat(F.lit(" and "), (n - shown).cast("string"), F.lit(" more"))).otherwise("")
    evidence = F.when(shown > 0, F.concat(F.lit(" Evidence: "), F.array_join("refs", ", "), more, F.lit("."))).otherwise("")
    known = F.when(F.col("known") != "", F.concat(F.lit("\n\nKnown false positives: "), "known", F.lit("."))).otherwise("")
    return F.concat("about", F.lit("\n\nRule '"), "rule_title", F.lit("' matched "), n.cast("string"), F.lit(" event(s) "), when, F.when(label != "", F.concat(F.lit(" "), label)).otherwise(""), F.lit("."), evidence, known)


def _same(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal."""
    return a.join(b.withColumnsRenamed({k: f"__{k}" for k in on}), reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on))).drop(*(f"__{k}" for k in on))


#: What a rule can group by.
ENTITIES = ("actor", "src_ip", "dst_ip", "target", "host", "event_type", "rel_path", "sha256")


def from_hits(hits: DataFrame, rule_set: RuleSet) -> DataFrame:
    """Drafts of all rules that report: of a base rule one for each entity and burst (bursts end at cluster_gap), of a correlation one for each match.

    All rules share one plan: what they say of themselves is a small table, and an entity is the array of the values that its rule groups by.
    """
    columns = [c for c in ENTITIES if c in hits.columns]
    values = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c))))
    source = F.concat(F.coalesce("sha256", F.lit("None")), F.lit(":"), F.coalesce(F.col("line_number").cast("string"), F.lit("None")))
    ref = F.concat_ws(":", "rel_path", F.col("line_number").cast("string"))
    rows = hits.join(_facts(hits.sparkSession, rule_set).select("rule_key", "by", "span", "correlated"), "rule_key").withColumns({"entity": F.transform("by", lambda k: F.element_at(values, k)), "__ref": source, "__shown": ref})
    single = rows.where("correlated").select(
        "rule_key", "entity", "host", "first_micros", F.col("micros").alias("last_micros"), "n_events", "peak", F.array("__shown").alias("refs"), F.array_compact(F.array("rel_path")).alias("sources"), F.col("__ref").alias("ref")
    )
    by, once = ["rule_key", "entity"], ["rule_key", "entity", "cluster"]
    rows = with_sessions(rows.where("not correlated"), by, "span")
    # a host that all of an entity's matches share belongs to the finding, whatever the burst
    hosts = rows.groupBy(*by).agg(constant("host"))
    bursts = rows.groupBy(*once).agg(F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"), F.sum("n_events").alias("n_events"), F.array_sort(F.collect_set("rel_path")).alias("sources"), F.min_by("__ref", F.struct(F.col("micros").isNull(), "micros", "id")).alias("ref"))
    bursts = _same(_same(bursts, first_refs(rows, once, F.col("__shown")), once), hosts, by).withColumn("peak", F.lit(None).cast("long"))
    found = single.unionByName(bursts.select(single.columns)).join(_facts(hits.sparkSession, rule_set), "rule_key")
    # the entity's values by name, and the host if it isn't one of them
    named = F.map_filter(F.map_concat(F.map_from_arrays("by", "entity"), F.when(F.array_contains("by", "host"), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("host"), F.col("host")))), lambda k, v: v.isNotNull())
    phrase = F.create_map(*(F.lit(x) for pair in PHRASES.items() for x in pair))
    label = F.array_join(F.array_compact(F.transform(F.concat("by", F.when(F.array_contains("by", "host"), F.array().cast("array<string>")).otherwise(F.array(F.lit("host")))), lambda k: F.concat(F.element_at(phrase, k), F.element_at(F.col("named"), k)))), " ")
    key = F.array_join(F.zip_with("by", "entity", lambda k, v: F.concat(k, F.lit("="), F.coalesce(v, F.lit("None")))), "|")
    found = found.withColumn("named", named).withColumn("label", label)
    context = F.to_json(F.struct("rule_uuid", F.col("rule_key").alias("rule_name"), F.col("named").alias("entity"), F.col("n_events").alias("count"), "sources", F.col("peak").alias("peak_in_window")))
    title = F.concat("rule_title", F.when(F.col("label") != "", F.concat(F.lit(" — "), "label")).otherwise(""))
    out = found.withColumns({"fingerprint": fingerprint("rule_uuid", key, "ref"), "rule_id": F.col("rule_key"), "title": title, "narrative": _narrative(F.col("label")), "context": context})
    return first_of_each(out.select(*COLUMNS))


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of drafts with one fingerprint the first, by rule, time (undated last), title."""
    order = Window.partitionBy("fingerprint").orderBy("rule_id", F.col("first_micros").asc_nulls_last(), "title")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both by fingerprint, with change. What new says of a finding counts; its status and note stay. Open findings that vanished go,
    reviewed ones that vanished become stale. All columns of either table are kept."""
    own = ("fingerprint", "status", "note")
    s = stored.withColumnsRenamed({c: f"s_{c}" for c in stored.columns if c != "fingerprint"}).withColumn("__s", F.lit(True))
    n = new.groupBy("fingerprint").agg(*(F.max(c).alias(f"n_{c}") for c in new.columns if c not in own)).withColumn("__n", F.lit(True))
    both = s.join(n, "fingerprint", "full_outer")
    status = F.coalesce("s_status", F.lit("open"))
    change = F.when(F.col("__s").isNull(), "new").when(F.col("__n").isNotNull(), "updated").when(status == "open", "deleted").otherwise("stale")
    columns = [c for c in dict.fromkeys((*stored.columns, *new.columns)) if c not in own]
    pick = lambda c: F.when(F.col("__n").isNotNull() & F.lit(c in new.columns), F.col(f"n_{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"s_{c}") if c in stored.columns else F.lit(None)).alias(c)
    note = [F.col("s_note").alias("note")] if "note" in stored.columns else []
    return both.withColumn("change", change).where("change != 'deleted'").select("fingerprint", *(pick(c) for c in columns), status.alias("status"), *note, "change")


def ordered(findings: DataFrame) -> DataFrame:
    """Severe first, undated last."""
    return findings.orderBy(F.desc("severity_rank"), F.col("first_micros").asc_nulls_last(), "fingerprint")


def listed(findings: DataFrame, status: str | None = None, least: str | None = None, verified_by: str | None = None) -> DataFrame:
    """Those of a status, of a severity or above, of an origin; severe first."""
    if status:
        findings = findings.where(F.col("status") == status)
    if least:
        findings = findings.where(F.col("severity_rank") >= LEVELS.index(least))
    if verified_by:
        findings = findings.where(F.col("verified_by") == verified_by)
    return ordered(findings)


def reviewed(findings: DataFrame, fingerprint_: str, status: str, note: str | None = None) -> DataFrame:
    """findings with one of them accepted, rejected or open again; a proposal that is accepted counts as the analyst's."""
    if status not in ("open", "accepted", "rejected"):
        raise ValueError(f"unknown status {status!r}")
    mine = F.col("fingerprint") == fingerprint_
    changes = {"status": F.when(mine, status).otherwise(F.col("status")), "note": F.when(mine & F.lit(note is not None), F.lit(note)).otherwise(F.col("note") if "note" in findings.columns else F.lit(None).cast("string"))}
    if "verified_by" in findings.columns and status == "accepted":
        changes["verified_by"] = F.when(mine & (F.col("verified_by") == "ai_proposed"), "analyst").otherwise(F.col("verified_by"))
    return findings.withColumns(changes)


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, n) of all levels, those without a finding too."""
    levels = findings.sparkSession.createDataFrame([(x, i) for i, x in enumerate(LEVELS)], "severity string, rank int")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(levels).join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def techniques(spark) -> DataFrame:
    """(technique, tactic, tactic_order)"""
    return spark.createDataFrame([(t, tactic, TACTICS.index(tactic)) for t, of in TECHNIQUES.items() for tactic in of], "technique string, tactic string, tactic_order int")


def coverage(findings: DataFrame) -> DataFrame:
    """(tactic, technique, n_findings, top_severity) in the tactics' order; a technique that isn't known has no tactic."""
    rows = findings.select("fingerprint", "severity_rank", F.explode("techniques").alias("technique"))
    met = rows.join(F.broadcast(techniques(findings.sparkSession)), "technique", "left")
    out = met.groupBy("tactic", "tactic_order", "technique").agg(F.count_distinct("fingerprint").alias("n_findings"), F.max("severity_rank").alias("top_severity"))
    return out.orderBy(F.col("tactic_order").asc_nulls_last(), "technique")


def phase(techniques_: str = "techniques") -> Column:
    """When to respond: the earliest phase of any tactic of any of the techniques; long_term if none is known."""
    table = F.create_map(*(x for t, of in TECHNIQUES.items() for x in (F.lit(t), F.lit(min(PHASES.index(PHASE_OF.get(tactic, "long_term")) for tactic in of)))))
    rank = F.coalesce(F.array_min(F.array_compact(F.transform(techniques_, lambda t: F.element_at(table, t)))), F.lit(2))
    return F.get(F.array(*map(F.lit, PHASES)), rank)


def recommendations(findings: DataFrame) -> DataFrame:
    """(phase, recommendation, severity_rank, findings): each text once in a phase, with the findings that give it; urgent and severe first."""
    out = findings.withColumn("phase", phase()).groupBy("phase", "recommendation").agg(F.max("severity_rank").alias("severity_rank"), F.array_sort(F.collect_set("fingerprint")).alias("findings"))
    return out.orderBy(F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")), F.desc("severity_rank"), "recommendation")


def by_event(finding_events: DataFrame, findings: DataFrame) -> DataFrame:
    """(event_id, finding_ids, severity_rank): the findings of each event, and the most severe of them."""
    met = finding_events.join(findings.select("finding_id", "severity_rank"), "finding_id")
    return met.groupBy("event_id").agg(F.array_sort(F.collect_set("finding_id")).alias("finding_ids"), F.max("severity_rank").alias("severity_rank"))
