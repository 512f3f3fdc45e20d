"""The log operators against plain versions, and every query against its SQL."""

import gzip
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tracegrain.functions.regexes import from_python, glob, wildcard
from tracegrain.operators import correlate, findings, iocs, rules
from tracegrain.plans import registry as queries
from tracegrain.sources import evidence

TABLES = ("events", "documents", "pages")


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, db, name):
    got = queries.QUERIES[name](spark, sf_dir)
    cur = db.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    same_rows(got, [dict(zip(names, r, strict=True)) for r in cur.fetchall()], got.columns)


def greedy(rows, wanted, span, ordered):
    out, i = [], 0
    while i < len(rows):
        window = [r for r in rows[i:] if r[0] - rows[i][0] <= span]
        first = [next((j for j, r in enumerate(window) if r[2] == w), None) for w in wanted]
        if None not in first and (not ordered or first == sorted(first)):
            out.append((window[0][0], window[-1][0], len(window)))
            i += len(window)
        else:
            i += 1
    return out


@pytest.mark.parametrize("ordered", [True, False])
def test_temporal_equals_a_loop(spark, ordered):
    rng = random.Random(7)
    rows = [(i, f"a{rng.randrange(12)}", rng.randrange(300), rng.choice("xyz")) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, actor string, micros long, rule_key string")
    groups = defaultdict(list)
    for i, a, m, r in rows:
        groups[a].append((m, i, r))
    expected = [(a, *w) for a, g in groups.items() for w in greedy(sorted(g), "xyz", 9, ordered)]
    got = [(r.actor, r.first_micros, r.last_micros, r.n_events) for r in correlate.temporal(df, ["actor"], list("xyz"), 9, ordered).collect()]
    assert sorted(got) == sorted(expected) and expected


def test_sessions_keep_undated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 10), (3, "a", 21), (4, "a", None), (5, None, 5)], "id long, actor string, micros long")
    got = {(r.actor, r.first_micros, r.n_events) for r in correlate.sessions(df, ["actor"], 10).collect()}
    assert got == {("a", 0, 2), ("a", 21, 1), ("a", None, 1), (None, 5, 1)}


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "Accepted password", "sshd -D", ["ssh", "key:1"], {"status": "200", "ok": "true"}, "10.1.2.3", "Root"), (2, None, "x*y", [], None, "2001:db8::1", None), (3, "line\nnext", "C:\\tmp", ["web"], {"status": "abc"}, "999.1.1.1", "root")],
        "id long, raw string, command string, tags array<string>, extra map<string,string>, src_ip string, actor string",
    )

    def hit(body, condition="s"):
        rule = rules.Rule("r", "r", ({"s": body} if condition == "s" else body) | {"condition": condition})
        return {r.id for r in rules.matches(df, [rule]).collect()}

    assert hit({"raw|contains": "PASSWORD"}) == {1} == hit({"raw": "acc*word"}) == hit({"raw|startswith": "a?cepted"})
    assert hit({"command": r"x\*y"}) == {2} == hit({"raw": None}) and hit({"raw|exists": True}) == {1, 3}
    assert hit({"status|gte": 200}) == {1} == hit({"extra.status": 200}) and hit({"ok|gt": 0}) == set() and hit({"ok": True}) == {1}
    assert hit({"src_ip|cidr": "10.0.0.0/8"}) == {1} and hit({"src_ip|cidr": "2001:db8::/32"}) == {2}
    assert hit({"tags|contains": "key:"}) == {1} and hit({"tags": None}) == set() and hit({"tags|contains|all": ["s", "k"]}) == {1}
    assert hit({"raw|re": "^next"}) == set() and hit({"raw|re": "(?m)^next$"}) == {3} and hit({"raw|re|i": "ACC.p"}) == {1} and hit({"raw|re": "ACC.p"}) == set()
    assert hit(["password", "tmp"]) == {1, 3} and hit([{"id": 1}, {"id": 2}]) == {1, 2}
    assert hit({"a": {"id": 1}, "b": {"actor": "root"}}, "not a and b") == {3} and hit({"a": {"id": 1}, "b": {"id": 2}}, "1 of them") == {1, 2}
    assert hit({"a": {"raw|contains": "zzz"}}, "not a") == {1, 2, 3}
    for bad in ("a and", "nope", "a | count() > 3", "(a", "a b", "1 of q*"):
        with pytest.raises(rules.RuleError):
            hit({"a": {"id": 1}}, bad)
    with pytest.raises(rules.RuleError):
        hit({"raw|near": "x"})
    assert len(rules.load("name: a\ntitle: A\ndetection: {s: {id: 1}, condition: s}\n---\nname: b\ntitle: B\nlevel: high\ndetection: {s: {id: 2}, condition: s}")) == 2


def test_patterns(spark):
    import re

    assert wildcard("plain") is None and wildcard("a*b?") == "a.*b."
    for p, text in ((r"(?P<n>a+)\d\Z", "xaa5"), (r"\w+é$", "naïveé"), (r"a.b", "a\rb")):
        assert spark.range(1).select(F.lit(text).rlike(from_python(p))).first()[0] == bool(re.search(p, text))
    assert spark.range(1).select(F.lit("var/log/auth.log").rlike(glob("*/auth.*"))).first()[0]
    with pytest.raises(ValueError):
        from_python("[[a]]")


def test_evidence_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo \xff\n")
    (tmp_path / "b.txt").write_bytes(gzip.compress(b"three\nfour\n"))
    (tmp_path / "empty").write_bytes(b"")
    got = {(r.path.rsplit("/", 1)[1], r.line_number, r.line) for r in evidence.lines(spark, str(tmp_path)).collect()}
    assert got == {("a.log", 1, "one"), ("a.log", 2, "two \ufffd"), ("b.txt", 1, "three"), ("b.txt", 2, "four")}
    before = spark.createDataFrame(evidence.files(spark, str(tmp_path)).collect())
    assert {r.compression for r in before.where("path like '%b.txt'").collect()} == {"gzip"}
    (tmp_path / "a.log").write_bytes(b"changed")
    (tmp_path / "new").write_bytes(b"n")
    out = {r.path.rsplit("/", 1)[1]: r.outcome for r in evidence.verify(before, evidence.files(spark, str(tmp_path))).collect()}
    assert out == {"a.log": "modified", "b.txt": "ok", "new": "new"}
    names = spark.createDataFrame([("auth.log.1.gz",), ("x-20240101",), ("plain",)], "n string").select(evidence.rotation(F.col("n")).alias("r")).collect()
    assert [(r.r["base"], r.r["index"]) for r in names] == [("auth.log", 1), ("x", 20240101), ("plain", None)]


def test_digest_is_of_all_rows_in_any_order(spark):
    df = spark.range(500).selectExpr("id", "concat('v', id) as v")
    one = evidence.digest(df, "id", "v").first()
    assert one == evidence.digest(df.orderBy(F.desc("id")).repartition(7), "id", "v").first() and one.n_rows == 500
    assert one.digest != evidence.digest(df.withColumn("v", F.when(F.col("id") == 3, "other").otherwise(F.col("v"))), "id", "v").first().digest


def test_digest_equals_a_plain_version(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    parts = defaultdict(lambda: [0] * 7)
    for i in range(500):
        d, part = sha(f"{i}\tv{i}"), parts[sha(str(i))[:2]]
        for j in range(6):
            part[j] += int(d[12 * j : 12 * j + 12], 16)
        part[6] += 1
    expected = sha(",".join(":".join(map(str, (p, *v))) for p, v in sorted(parts.items())))
    assert evidence.digest(spark.range(500).selectExpr("id", "concat('v', id) as v"), "id", "v").first().digest == expected


def test_indicators(spark):
    df = spark.createDataFrame([(1, "see http://Evil.Example.com/x?y and 8.8.8.8, 10.0.0.1 or 999.1.1.1"), (2, "D41D8CD98F00B204E9800998ECF8427E /tmp/.x/run"), (3, None)], "id long, t string")
    got = {(r.id, r.type, r.value, r.tag) for r in iocs.extract(df, "id", "t").collect()}
    assert got == {(1, "url", "http://Evil.Example.com/x?y", ""), (1, "domain", "evil.example.com", ""), (1, "ipv4", "8.8.8.8", ""), (1, "ipv4", "10.0.0.1", "private"), (2, "md5", "d41d8cd98f00b204e9800998ecf8427e", ""), (2, "path", "/tmp/.x/run", "")}
    assert iocs.rollup(iocs.extract(df, "id", "t")).where("type = 'ipv4'").select(iocs.stix_pattern().alias("p")).orderBy("p").first().p == "[ipv4-addr:value = '10.0.0.1']"


@pytest.mark.parametrize(("kind", "size"), [("md5", 32), ("sha256", 64)])
def test_adjacent_hashes(spark, kind, size):
    hashes = [f"{i:0{size}x}" for i in range(10)]
    df = spark.createDataFrame([(1, " ".join(hashes)), (2, ",".join(hashes)), (3, "a" * (size + 1)), (4, f"x{hashes[1]}g{hashes[2].upper()}")], "id long, t string")
    got = sorted((r.id, r.value) for r in iocs.extract(df, "id", "t", (kind,)).collect())
    assert got == sorted([(i, h) for i in (1, 2) for h in hashes] + [(4, hashes[1]), (4, hashes[2])])


def test_findings_of_reviewed_state(spark):
    stored = spark.createDataFrame([("a", 1, "open"), ("b", 2, "accepted"), ("c", 3, "rejected"), ("d", 1, "open")], "fingerprint string, n_events long, status string")
    new = spark.createDataFrame([("a", 5), ("b", 6), ("e", 1)], "fingerprint string, n_events long")
    assert {tuple(r) for r in findings.upsert(stored, new).collect()} == {("a", 5, "open", "updated"), ("b", 6, "accepted", "updated"), ("c", 3, "rejected", "stale"), ("e", 1, "open", "new")}


def test_stream_of_matches(spark, tmp_path):
    from tracegrain.streaming.matches import matched_stream, sessions_stream

    rows = [(i, f"2024-01-01 00:0{i % 5}:00", "a", "auth.login.failure" if i % 2 else "x") for i in range(10)]
    spark.createDataFrame(rows, "id long, t string, actor string, event_type string").selectExpr("id", "cast(t as timestamp) as timestamp_utc", "actor", "event_type").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    rule = rules.Rule("f", "f", {"s": {"event_type": "auth.login.failure"}, "condition": "s"})
    q = sessions_stream(matched_stream(stream, [rule]), ["actor"], "10 minutes", "1 minute").writeStream.format("memory").queryName("clusters").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.rule_key, r.n_events) for r in spark.table("clusters").collect()] == [("f", 5)]


def test_first_references_are_cut_before_they_meet(spark):
    """Every task keeps the first rows of a key; only those are shuffled."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("actor"), "id", F.col("id").alias("micros"))
    found = correlate.first_refs(df, ["actor"], F.col("id"), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2 and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    assert {r.actor: r.refs for r in found.collect()} == {0: [0, 2, 4], 1: [1, 3, 5]}
