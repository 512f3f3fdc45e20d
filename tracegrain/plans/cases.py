"""Queries of findings, indicators, references, redaction and exports over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytic_drafts, analytics, correlate, detect, exports, findings, iocs, redact
from ..operators.rules import Correlation, Rule, RuleSet, matches
from ..operators.tables import cut
from ..operators.timeline import as_json
from ..sources import merkle
from .queries import DAY, EV, RULES, _MATCHED, _of, events

KEY = bytes(range(32))
CHAIN = RuleSet([
    Rule("failed", "Failed login", {"s": {"event_type": "auth.login.failure"}, "condition": "s"}, "low", generate=False, id="r1"),
    Rule("created", "New account", {"s": {"event_type": "user.create"}, "condition": "s"}, "medium", 0.5, ("T1136.001",), ("actor",), "Ask.", id="r2", cluster_gap="1d", description="An account."),
    Correlation("often", "Many failed", "high", 0.6, ("T1110",), ("actor",), "Block.", id="r3", kind="event_count", rules=("failed",), timespan="1d", test=("gte", 3), description="Failed often."),
    Correlation("then", "Account after many failed", "critical", 0.7, ("T1078",), ("actor",), "Isolate.", id="r4", kind="temporal", rules=("r3", "created"), timespan="2d", description="Both."),
])


def _found(spark, d):
    """Two kinds of findings by actor: (finding_id, status, severity_rank, actor) and (finding_id, event_id)."""
    hits = matches(events(spark, d), RULES[2:])
    rows = hits.groupBy("rule_key", "actor").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(":", "rule_key", "actor").alias("finding_id"), F.when(F.col("actor").endswith("3"), "rejected").otherwise("open").alias("status"), F.when(F.col("rule_key") == "odd_key", 2).when(F.col("rule_key") == "private_source", 3).otherwise(4).alias("severity_rank"))
    return rows, hits.select(F.concat_ws(":", "rule_key", "actor").alias("finding_id"), F.col("id").alias("event_id"))


def chained_correlations(spark, d):
    """A correlation of a correlation; matches by rule."""
    return detect.hits(events(spark, d), CHAIN).groupBy("rule_key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_events").alias("n_events"), F.max("micros").alias("last_micros"))


def finding_texts(spark, d):
    """Findings with their texts and contexts; matches are a table, as findings read them several times."""
    hits = detect.hits(events(spark, d).withColumns({"rel_path": F.lit("auth.log"), "sha256": F.lit("ab"), "line_number": F.col("id").cast("int")}), CHAIN)
    return findings.from_hits(cut(hits), CHAIN)


def first_references(spark, d):
    """The first five failed logins of each actor."""
    refs = correlate.first_refs(_of(events(spark, d), "auth.login.failure"), ["actor"], F.concat_ws(":", "host", F.col("id").cast("string")))
    return refs.select("actor", F.array_join("refs", ",").alias("refs"))


def constant_entities(spark, d):
    """Of each day and address the host, if it is one, and when it was first and last seen."""
    ev = events(spark, d).withColumn("day", F.floor(F.col("micros") / DAY))
    return ev.groupBy("day", "src_ip").agg(correlate.constant("host"), F.min("micros").alias("first_micros"), F.max("micros").alias("last_micros"))


def severity_counts(spark, d):
    facts = spark.createDataFrame([(r.name, r.level) for r in RULES[2:4]], "rule_key string, severity string")
    return findings.by_severity(matches(events(spark, d), RULES).join(F.broadcast(facts), "rule_key"))


def technique_coverage(spark, d):
    facts = spark.createDataFrame([(r.name, list(r.techniques), i) for i, r in enumerate(RULES) if r.techniques], "rule_key string, techniques array<string>, severity_rank int")
    rows = matches(events(spark, d), RULES).join(F.broadcast(facts), "rule_key").select(F.concat_ws(":", "rule_key", "actor").alias("fingerprint"), "techniques", "severity_rank").distinct()
    return findings.coverage(rows).select("tactic", "technique", "n_findings", "top_severity")


def event_findings(spark, d):
    rows, links = _found(spark, d)
    return findings.by_event(links, rows).select("event_id", F.array_join("finding_ids", ",").alias("finding_ids"), "severity_rank")


def ioc_table(spark, d):
    ev = events(spark, d)
    found = iocs.extract_events(ev.select("id", "micros", "event_type", "src_ip", "raw", F.col("actor").alias("target"), *(F.lit(None).cast(t).alias(c) for c, t in (("dst_ip", "string"), ("command", "string"), ("tags", "array<string>"), ("extra", "map<string,string>")))))
    rows, links = _found(spark, d)
    out = iocs.table(found, ev, iocs.finding_links(links, rows))
    return out.select("type", "value", "first_micros", "last_micros", "event_count", F.array_join("tags", ",").alias("tags"), F.array_join("finding_ids", ",").alias("finding_ids"))


def ioc_upsert(spark, d):
    ev = _of(events(spark, d), "web.request")
    of = lambda rows: rows.groupBy(F.lit("ipv4").alias("type"), F.col("src_ip").alias("value")).agg(F.count(F.lit(1)).alias("event_count"))
    stored = of(ev.where("id % 3 = 0")).select("type", "value", F.when(F.col("value").endswith("1"), "malicious").otherwise("unknown").alias("verdict"), F.lit("{}").alias("enrichment"))
    return iocs.upsert(stored, of(ev.where("id % 3 = 1"))).select("type", "value", "event_count", "verdict", "change")


def lookup_policy(spark, d):
    rows = events(spark, d).select(F.lit("ipv4").alias("type"), F.col("src_ip").alias("value"), F.when(F.col("src_ip").startswith("10."), F.array(F.lit("private"))).otherwise(F.array()).alias("tags")).distinct()
    rows = rows.unionByName(events(spark, d).select(F.lit("username").alias("type"), F.col("actor").alias("value"), F.array().cast("array<string>").alias("tags")).distinct())
    return rows.groupBy("type", iocs.may_ask(F.col("type"), F.col("value"), F.col("tags")).alias("answer")).agg(F.count(F.lit(1)).alias("n"))


def combined_verdicts(spark, d):
    """Two providers' answers on each address, of which the more severe verdict counts."""
    k, one = F.col("k").cast("string"), events(spark, d).groupBy("src_ip").agg(F.max("k").alias("k"))
    abuse = F.concat(F.lit('{"data":{"abuseConfidenceScore":'), k, F.lit(',"totalReports":'), (F.col("k") % 2).cast("string"), F.lit("}}"))
    scan = F.concat(F.lit('{"data":{"attributes":{"last_analysis_stats":{"malicious":'), (F.col("k") % 4).cast("string"), F.lit(',"harmless":9}}}}'))
    rows = one.select(F.lit("ipv4").alias("type"), F.col("src_ip").alias("value"), F.explode(F.array(iocs.abuse_verdict(abuse), iocs.scan_verdict(scan))).alias("verdict"))
    return iocs.combined(rows)


def pseudonyms(spark, d):
    values = events(spark, d).select(F.explode(F.array(F.struct(F.lit("user").alias("category"), F.col("actor").alias("value")), F.struct(F.lit("host").alias("category"), F.col("host").alias("value")))).alias("x")).select("x.*").distinct()
    return redact.mapping(values, KEY)


def redacted_texts(spark, d):
    """Texts with users' names replaced."""
    ev = _of(events(spark, d), "user.create")
    table = redact.mapping(events(spark, d).select(F.lit("user").alias("category"), F.col("actor").alias("value")).distinct(), KEY)
    return redact.redact(ev.select("id", "raw"), "id", "raw", table)


def redacted_lines(spark, d):
    """Log lines with ports, colons, URLs and names of two words, and with names that only look alike; e-mail addresses are found as they stand."""
    ev = events(spark, d)
    last = F.substring("actor", 2, 9)
    values = ev.select(F.explode(F.array(*(F.struct(F.lit(c).alias("category"), v.alias("value")) for c, v in (
        ("user", F.col("actor")), ("user", F.concat(F.lit("User "), last)), ("host", F.col("host")), ("domain", F.concat("host", F.lit(".corp"))), ("ip", F.when(F.col("src_ip").startswith("10."), F.col("src_ip")))
    )))).alias("x")).select("x.*").where("value is not null").distinct()
    line = F.concat(F.lit("from "), "src_ip", F.lit(":5022 user:"), "actor", F.lit(" "), "host", F.lit(":22 http://"), "host", F.lit(".corp:80/x by User "), last, F.lit(" here x-"), "actor", F.lit(" "), "actor", F.lit(".d mail "), "actor", F.lit("@"), "src_ip", F.lit(" ("), "actor", F.lit(")."))
    return redact.redact(ev.select("id", line.alias("line")), "id", "line", redact.mapping(values, KEY), KEY)


def events_as_json(spark, d):
    return as_json(_of(events(spark, d), "web.request").select("id", "micros", "actor", "src_ip", "event_type").withColumns({"line_number": F.lit(1)})).select("id", "json")


def stix_ids(spark, d):
    """The names and patterns of indicators in an export."""
    rows = events(spark, d).select(F.lit("ipv4").alias("type"), F.col("src_ip").alias("value")).distinct()
    return rows.select("value", exports.stix_id("indicator", "case", F.col("type"), F.col("value")).alias("stix_id"), iocs.stix_pattern().alias("pattern"))


def log_figures(spark, d):
    ev = events(spark, d).withColumns({"artifact_type": F.col("event_type"), "timezone_assumed": F.col("k") > 50, "tags": F.when(F.col("k") % 2 == 0, F.array(F.lit("year_inferred"))).otherwise(F.array().cast("array<string>"))})
    return exports.figures(ev)


def cut_login_records(spark, d):
    """Two wtmp files, one of which is empty, against logins elsewhere."""
    ev = events(spark, d).withColumns({"artifact_type": F.when(F.col("host") == "h1", "utmp.wtmp").otherwise("linux.auth"), "path": F.col("host")})
    ev = ev.where("host != 'h1' or micros > 1706000000000000")
    files = spark.createDataFrame([("h1", "utmp.wtmp"), ("none", "utmp.wtmp")], "path string, artifact_type string")
    return analytics.cut_login_records(ev, files)


def evidence_tree(spark, d):
    """The tree of hashes over all events."""
    return merkle.tree(events(spark, d), "id", ["id", "micros", "actor", "raw"])


def corr_temporal(spark, d):
    """Windows of two days with failed logins and a new account in any order."""
    return correlate.temporal(matches(events(spark, d), CHAIN.rules), ["actor"], ["failed", "created"], 2 * DAY)


def analytic_findings(spark, d):
    """Drafts of all five analytics; some of the events are boots, restarts of logging, keys and binary login records."""
    ev, kind = events(spark, d), F.col("event_type")
    kinds = F.when(kind == "auth.login.failure", "system.boot").when(kind == "user.create", "ssh.key.present").otherwise(kind)
    odd = F.when((kind == "user.create") & (F.col("k") >= 60), None).otherwise(F.array(F.concat(F.lit("key:"), F.col("k").cast("string"))))
    ev = ev.withColumns({"event_type": kinds, "target": F.when(F.col("k") < 20, "rsyslogd").otherwise("other"), "tags": F.coalesce(odd, F.array().cast("array<string>")), "path": F.col("host"), "artifact_type": F.when(F.col("host") == "h1", "utmp.wtmp").otherwise("linux.auth")})
    ev = ev.where("host != 'h1' or micros > 1706000000000000")
    files = spark.createDataFrame([("h1", "utmp.wtmp", None), ("none", "utmp.wtmp", "ab"), ("h2", "linux.auth", "cd")], "path string, artifact_type string, sha256 string")
    return analytic_drafts.drafts(ev, files, least_gap=0, times_median=5.0).select("fingerprint", "rule_id", "title", "severity", "first_micros", "last_micros", "n_events", F.array_join(F.array_sort("event_ids"), ",").alias("event_ids"))


QUERIES = {
    f.__name__: f
    for f in (
        chained_correlations, finding_texts, first_references, constant_entities, severity_counts, technique_coverage, event_findings, ioc_table, ioc_upsert, lookup_policy, combined_verdicts, pseudonyms, redacted_texts, redacted_lines, events_as_json, stix_ids,
        log_figures, cut_login_records, corr_temporal, analytic_findings, evidence_tree,
    )
}

_FOUND = f"""{_MATCHED}, hits AS (SELECT *, rule_key || ':' || actor AS finding_id FROM m WHERE rule_key NOT IN ('login_failure', 'login_success')),
 fs AS (SELECT DISTINCT finding_id, CASE WHEN ends_with(actor, '3') THEN 'rejected' ELSE 'open' END AS status, CASE rule_key WHEN 'odd_key' THEN 2 WHEN 'private_source' THEN 3 ELSE 4 END AS severity_rank FROM hits)"""
_TACTICS = ", ".join(f"('{t}', '{tactic}')" for t, of in findings.TECHNIQUES.items() for tactic in of)
_HMAC = "sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({m}))))"


def _pseudonym(category: str, value: str) -> str:
    inner, outer = (redact._padded(KEY, b).hex() for b in (0x36, 0x5C))
    return f"'{category}-' || substr({_HMAC.format(o=outer, i=inner, m=f"'{category}:' || {value}")}, 1, 6)"


_RECURSIVE = EV.replace("WITH ev", "WITH RECURSIVE ev", 1)


def _windows(span: int) -> str:
    """Of m (id, micros, actor, a: whether the first of two rules matches): n, the rows by place, and pick, the windows of both rules in any order."""
    return f"""n AS (SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY actor, cluster ORDER BY micros RANGE BETWEEN UNBOUNDED PRECEDING AND {span} FOLLOWING) AS till
  FROM (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY micros, id, a DESC) AS cluster FROM (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY actor ORDER BY micros, id, a DESC) <= {span} THEN 0 ELSE 1 END AS new FROM m))
  WINDOW w AS (PARTITION BY actor, cluster ORDER BY micros, id, a DESC)),
 f AS (SELECT *, min(CASE WHEN a THEN rn END) OVER w AS pa, min(CASE WHEN NOT a THEN rn END) OVER w AS pb FROM n WINDOW w AS (PARTITION BY actor, cluster ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 ok AS (SELECT actor, cluster, rn, till FROM f WHERE pa < till AND pb < till),
 pick AS (SELECT actor, cluster, min(rn) AS rn, min_by(till, rn) AS till FROM ok GROUP BY actor, cluster
  UNION ALL SELECT * FROM (SELECT p.actor, p.cluster, min(o.rn) AS rn, min_by(o.till, o.rn) AS till FROM pick p JOIN ok o ON o.actor = p.actor AND o.cluster = p.cluster AND o.rn >= p.till GROUP BY p.actor, p.cluster, p.rn)),
 met AS (SELECT n.actor, CAST(n.cluster AS BIGINT) AS cluster, min(micros) AS first_micros, max(micros) AS last_micros, count(*) AS n_events FROM n JOIN pick p ON n.actor = p.actor AND n.cluster = p.cluster AND n.rn >= p.rn AND n.rn < p.till GROUP BY n.actor, n.cluster, p.rn)"""


def _iso(micros: str) -> str:
    return f"strftime(make_timestamp({micros}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {micros} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({micros} % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"


def _analytic(a: analytic_drafts.Analytic, parts: str, suffix: str, first: str, last: str, n: str, ids: str, rows: str) -> str:
    return f"SELECT sha256(concat_ws(chr(31), '{a.rule_id}', {parts})) AS fingerprint, '{a.rule_id}' AS rule_id, '{a.title} — ' || {suffix} AS title, '{a.level}' AS severity, {first} AS first_micros, {last} AS last_micros, CAST({n} AS BIGINT) AS n_events, {ids} AS event_ids FROM {rows}"


_TWO = "CASE WHEN {a} IS NULL OR {a} = {b} THEN CAST({b} AS VARCHAR) ELSE least({a}, {b}) || ',' || greatest({a}, {b}) END"
_ANALYTIC = f"""{EV}, e AS (SELECT id, micros, host, actor, src_ip, k, CASE event_type WHEN 'auth.login.failure' THEN 'system.boot' WHEN 'user.create' THEN 'ssh.key.present' ELSE event_type END AS kind FROM ev WHERE host != 'h1' OR micros > 1706000000000000),
 s AS (SELECT host, id, micros, lag(micros) OVER w AS before, lag(id) OVER w AS before_id FROM e WHERE host != 'h1' WINDOW w AS (PARTITION BY host ORDER BY micros, id)),
 u AS (SELECT host, median(micros - before) AS usual FROM s GROUP BY host HAVING count(*) >= 20),
 gap AS (SELECT *, CASE host WHEN 'h2' THEN 'cd' ELSE host END AS sha FROM s JOIN u USING (host) WHERE micros > before AND micros - before > 5.0 * usual),
 other AS (SELECT micros AS other_micros, id AS other_id FROM e WHERE kind = 'auth.login.success' AND host != 'h1' ORDER BY micros, id LIMIT 1),
 own AS (SELECT micros AS own_micros, id AS own_id FROM e WHERE host = 'h1' ORDER BY micros, id LIMIT 1),
 cut AS (SELECT 'h1' AS path, 'h1' AS sha, own_micros, own_id, other_micros, other_id FROM own, other WHERE own_micros - other_micros > {DAY} UNION ALL SELECT 'none', 'ab', NULL, NULL, other_micros, other_id FROM other),
 src AS (SELECT actor, src_ip, count(*) AS n, min(id) AS id, min(micros) AS micros FROM e WHERE kind = 'auth.login.success' GROUP BY actor, src_ip),
 rare AS (SELECT * FROM src JOIN (SELECT actor, sum(n) AS logins FROM src GROUP BY actor) USING (actor) WHERE n = 1 AND logins >= 5 AND NOT starts_with(src_ip, '10.')),
 again AS (SELECT * FROM e a WHERE kind = 'service.start' AND k < 20 AND NOT EXISTS (SELECT 1 FROM e b WHERE b.kind = 'system.boot' AND b.host = a.host AND abs(a.micros - b.micros) <= 900000000)),
 lost AS (SELECT actor, k, count(*) AS n, min(micros) AS first_micros, max(micros) AS last_micros, arg_min(id, (micros, id)) AS one, arg_max(id, (micros, id)) AS two FROM e WHERE kind = 'auth.login.success' AND k NOT IN (SELECT k FROM e WHERE kind = 'ssh.key.present' AND k < 60) GROUP BY actor, k)
 {_analytic(analytic_drafts.GAP, f"sha, {_iso('before')}", "host || ' silent for ' || printf('%.1f', (micros - before) / 3600000000.0) || ' h'", "before", "micros", "2", _TWO.format(a="before_id", b="id"), "gap")}
 UNION ALL {_analytic(analytic_drafts.LOGINS_CUT, "sha", "path", "other_micros", "coalesce(own_micros, other_micros)", "CASE WHEN own_id IS NULL THEN 1 ELSE 2 END", _TWO.format(a="own_id", b="other_id"), "cut")}
 UNION ALL {_analytic(analytic_drafts.RARE, "actor, src_ip", "actor || ' from ' || src_ip", "micros", "micros", "1", "CAST(id AS VARCHAR)", "rare")}
 UNION ALL {_analytic(analytic_drafts.RESTART, f"'rsyslogd', {_iso('micros')}, host", f"'rsyslogd started at ' || {_iso('micros')}", "micros", "micros", "1", "CAST(id AS VARCHAR)", "again")}
 UNION ALL {_analytic(analytic_drafts.KEY, "actor, CAST(k AS VARCHAR)", "actor || ' with ' || k", "first_micros", "last_micros", "n", _TWO.format(a="one", b="two"), "lost")}"""

_PART = "length(CAST({c} AS VARCHAR)) || ':' || {c}"
ORACLE_SQL = {
    "evidence_tree": f"""{_RECURSIVE}, d AS (SELECT greatest(1, CAST(ceil(log(count(*) / 1024.0) / log(16) - 1e-9) AS INTEGER)) AS digits FROM ev),
 r AS (SELECT sha256(CAST(id AS VARCHAR)) AS k, sha256({" || ".join(_PART.format(c=c) for c in ("id", "micros", "actor", "raw"))}) AS h FROM ev),
 t AS (SELECT left(k, digits) AS node, sha256(string_agg(h, '' ORDER BY k, h)) AS digest, count(*) AS n_rows FROM r, d GROUP BY 1
  UNION ALL SELECT left(node, length(node) - 1), sha256(string_agg(digest, '' ORDER BY node)), CAST(sum(n_rows) AS BIGINT) FROM t WHERE length(node) > 0 GROUP BY 1)
 SELECT * FROM t""",
    "analytic_findings": _ANALYTIC,
    "corr_temporal": f"{_RECURSIVE}, m AS (SELECT id, micros, actor, event_type = 'auth.login.failure' AS a FROM ev WHERE event_type IN ('auth.login.failure', 'user.create')), {_windows(2 * DAY)} SELECT * FROM met",
    "chained_correlations": f"""{_RECURSIVE}, one AS (SELECT min(id) AS id, micros, actor, src_ip FROM ev WHERE event_type = 'auth.login.failure' GROUP BY micros, actor, src_ip),
 runs AS (SELECT *, sum(new) OVER (PARTITION BY actor ORDER BY micros, id) AS run FROM (SELECT *, CASE WHEN micros - lag(micros) OVER (PARTITION BY actor ORDER BY micros, id) <= {DAY} THEN 0 ELSE 1 END AS new FROM one)),
 often AS (SELECT actor, min(id) AS id, max(micros) AS micros, count(*) AS n_events FROM (SELECT *, count(*) OVER (PARTITION BY actor, run ORDER BY micros RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS c FROM runs) GROUP BY actor, run HAVING max(c) >= 3),
 m AS (SELECT id, micros, actor, true AS a FROM often UNION ALL SELECT id, micros, actor, false FROM ev WHERE event_type = 'user.create'), {_windows(2 * DAY)}
 SELECT CASE event_type WHEN 'user.create' THEN 'created' ELSE 'failed' END AS rule_key, count(*) AS n, count(*) AS n_events, max(micros) AS last_micros FROM ev WHERE event_type IN ('auth.login.failure', 'user.create') GROUP BY 1
 UNION ALL SELECT 'often', count(*), CAST(sum(n_events) AS BIGINT), max(micros) FROM often HAVING count(*) > 0 UNION ALL SELECT 'then', count(*), CAST(sum(n_events) AS BIGINT), max(last_micros) FROM met HAVING count(*) > 0""",
    "events_as_json": f"""{EV} SELECT id, '{{"actor":"' || actor || '","event_type":"web.request","id":' || id || ',"source":{{"line_number":1}},"src_ip":"' || src_ip || '","timestamp_utc":"' || {_iso('micros')} || '"}}' AS json FROM ev WHERE event_type = 'web.request'""",
    "first_references": f"{EV}, n AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY micros, id) AS n FROM ev WHERE event_type = 'auth.login.failure') SELECT actor, string_agg(host || ':' || id, ',' ORDER BY n) AS refs FROM n WHERE n <= 5 GROUP BY actor",
    "constant_entities": f"{EV} SELECT micros // {DAY} AS day, src_ip, CASE WHEN count(DISTINCT host) = 1 THEN max(host) END AS host, min(micros) AS first_micros, max(micros) AS last_micros FROM ev GROUP BY micros // {DAY}, src_ip",
    "severity_counts": f"{_MATCHED}, l AS (SELECT * FROM (VALUES ('info', 0, ''), ('low', 1, ''), ('medium', 2, 'odd_key'), ('high', 3, 'private_source'), ('critical', 4, '')) v(severity, rank, rule_key)) SELECT severity, rank, (SELECT count(*) FROM m WHERE m.rule_key = l.rule_key) AS n FROM l",
    "technique_coverage": f"""{_MATCHED}, t AS (SELECT * FROM (VALUES ('odd_key', 'T1078', 2), ('private_source', 'T1190', 3), ('private_source', 'T1059', 3), ('new_account', 'T1136', 4)) v(rule_key, technique, severity_rank)),
 k AS (SELECT * FROM (VALUES {_TACTICS}) v(technique, tactic))
 SELECT tactic, technique, count(DISTINCT rule_key || ':' || actor) AS n_findings, max(severity_rank) AS top_severity FROM m JOIN t USING (rule_key) LEFT JOIN k USING (technique) GROUP BY tactic, technique""",
    "event_findings": f"{_FOUND} SELECT id AS event_id, string_agg(DISTINCT finding_id, ',' ORDER BY finding_id) AS finding_ids, max(severity_rank) AS severity_rank FROM hits JOIN fs USING (finding_id) GROUP BY id",
    "ioc_table": f"""{_FOUND}, i AS (SELECT id, micros, 'ipv4' AS type, src_ip AS value, CASE WHEN starts_with(src_ip, '10.') THEN ['private', 'src_ip'] ELSE ['src_ip'] END AS tags FROM ev
 UNION ALL SELECT id, micros, 'username', actor, ['user_created'] FROM ev WHERE event_type = 'user.create'),
 l AS (SELECT type, value, string_agg(DISTINCT finding_id, ',' ORDER BY finding_id) AS finding_ids FROM i JOIN (SELECT id, finding_id FROM hits JOIN fs USING (finding_id) WHERE status != 'rejected') USING (id) GROUP BY type, value)
 SELECT type, value, min(micros) AS first_micros, max(micros) AS last_micros, count(DISTINCT id) AS event_count, array_to_string(max(tags), ',') AS tags, any_value(finding_ids) AS finding_ids FROM i LEFT JOIN l USING (type, value) GROUP BY type, value""",
    "ioc_upsert": f"""{EV}, e AS (SELECT * FROM ev WHERE event_type = 'web.request'), s AS (SELECT DISTINCT src_ip AS value FROM e WHERE id % 3 = 0), n AS (SELECT src_ip AS value, count(*) AS event_count FROM e WHERE id % 3 = 1 GROUP BY src_ip)
 SELECT 'ipv4' AS type, value, event_count, CASE WHEN s.value IS NOT NULL AND ends_with(s.value, '1') THEN 'malicious' ELSE 'unknown' END AS verdict,
 CASE WHEN n.value IS NULL THEN 'removed' WHEN s.value IS NULL THEN 'created' ELSE 'updated' END AS change FROM s FULL JOIN n USING (value)""",
    "lookup_policy": f"{EV} SELECT 'ipv4' AS type, CASE WHEN starts_with(src_ip, '10.') THEN 'private address' ELSE 'allowed' END AS answer, count(DISTINCT src_ip) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'username', 'type is never sent', count(DISTINCT actor) FROM ev",
    "combined_verdicts": f"""{EV}, o AS (SELECT src_ip, max(k) AS k FROM ev GROUP BY src_ip), v AS (SELECT src_ip, greatest(CASE WHEN k >= 75 THEN 3 WHEN k >= 25 THEN 2 WHEN k % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN k % 4 >= 3 THEN 3 WHEN k % 4 >= 1 THEN 2 ELSE 1 END) AS r FROM o)
 SELECT 'ipv4' AS type, src_ip AS value, ['unknown', 'clean', 'suspicious', 'malicious'][r + 1] AS verdict FROM v""",
    "pseudonyms": f"{EV} SELECT DISTINCT actor AS value, {_pseudonym('user', 'actor')} AS pseudonym FROM ev UNION ALL SELECT DISTINCT host, {_pseudonym('host', 'host')} FROM ev",
    "redacted_lines": f"""{EV} SELECT id, 'from ' || CASE WHEN src_ip LIKE '10.%' THEN {_pseudonym('ip', 'src_ip').replace("'ip-'", "'PRIVATE-IP-'")} ELSE src_ip END || ':5022 user:' || {_pseudonym('user', 'actor')} || ' ' || {_pseudonym('host', 'host')}
 || ':22 http://' || {_pseudonym('domain', "(host || '.corp')")} || '.redacted.invalid:80/x by ' || {_pseudonym('user', "('User ' || substr(actor, 2))")} || ' here x-' || actor || ' ' || actor || '.d mail ' || {_pseudonym('email', "(actor || '@' || src_ip)")} || '@redacted.invalid (' || {_pseudonym('user', 'actor')} || ').' AS line FROM ev""",
    "redacted_texts": f"{EV} SELECT id, replace(raw, ' ' || actor || ' ', ' ' || {_pseudonym('user', 'actor')} || ' ') AS raw FROM ev WHERE event_type = 'user.create'",
    "stix_ids": f"""{EV}, h AS (SELECT DISTINCT src_ip AS value, sha1(unhex('{exports.NAMESPACE.replace("-", "")}') || encode('indicator|case|ipv4|' || src_ip)) AS d FROM ev)
 SELECT value, 'indicator--' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(d, 17, 1) AS BIGINT) % 4 + 1] || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS stix_id,
 '[ipv4-addr:value = ''' || value || ''']' AS pattern FROM h""",
    "log_figures": f"""{EV} SELECT event_type AS artifact_type, count(*) AS n_events, CAST(0 AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS n_undated, count(*) FILTER (k > 50) AS n_assumed, count(*) FILTER (k % 2 = 0) AS n_inferred,
 min(micros) AS first_micros, max(micros) AS last_micros, count(DISTINCT host) AS hosts FROM ev GROUP BY event_type""",
    "cut_login_records": f"""{EV}, o AS (SELECT min(micros) AS other_micros, min_by(id, micros) AS other_id FROM ev WHERE event_type = 'auth.login.success' AND host != 'h1'),
 f AS (SELECT 'h1' AS path, min_by(id, (micros, id)) AS id, min(micros) AS micros FROM ev WHERE host = 'h1' AND micros > 1706000000000000 UNION ALL SELECT 'none', NULL, NULL)
 SELECT path, id, micros, other_id, other_micros, micros - other_micros AS lag FROM f, o WHERE micros IS NULL OR micros - other_micros > {DAY}""",
}
