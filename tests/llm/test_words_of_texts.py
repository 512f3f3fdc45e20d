"""Operators 4, 5, 9 and 10 against plain versions, on the odd cases and on the documents of the test tables."""

from collections import Counter, defaultdict

import pytest

from tests.conftest import same_rows
from tests.llm.helpers import empty, odd_documents, sha, words
from tracegrain.llm import exact_dedup, quality_rules, registry
from tracegrain.llm.jaccard_join import JaccardJoin
from tracegrain.llm.substring_dedup import RepeatedSpans


@pytest.fixture(scope="module", params=["odd", "table"])
def docs(request, spark, sf_dir):
    return odd_documents(spark) if request.param == "odd" else spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_exact_groups(docs):
    groups = defaultdict(list)
    for i, t in rows_of(docs):
        groups[t or ""].append(i)
    expected = []
    for t, ids in groups.items():
        keep, left = max((i for i in ids if i is not None), default=None), 1
        for i in ids:
            kept = i == keep and left == 1
            left -= kept
            expected.append({"doc_id": i, "keep_id": keep, "group_size": len(ids), "kept": kept, "text_sha256": sha(t)})
    same_rows(exact_dedup.exact_groups(docs), expected)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.select("text").collect()) == sorted(groups)
    assert exact_dedup.exact_groups(empty(docs)).count() == 0 == exact_dedup.exact_dedup(empty(docs)).count()


def test_null_may_have_no_equal(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "")], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df, null_as_empty=False).count() == 3
    assert [r.doc_id for r in exact_dedup.exact_dedup(df).collect()] == [3]


def base_statistics(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, repeated = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            repeated |= {i, i + 1, i + 2}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
    }


def test_quality_statistics_and_base_rules(docs, spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_rules.quality_rules(docs, labels)
    expected = []
    for i, t in rows_of(docs):
        s = base_statistics(t)
        expected.append({"doc_id": i, **s, "base_failed": s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]})
    same_rows(got, expected, expected[0])
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules.quality_rules(empty(docs), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.where("1 = 0")).where("kept = base_failed").count() == 0


def test_windows_whose_hashes_share_40_bits_are_not_equal(spark):
    """The hashes of the windows 'w1482728 x y' and 'w2761922 x y' differ in their low 24 bits only."""
    a, b = "w1482728 x y", "w2761922 x y"
    texts = [f"{a} q1 q2 {b}", f"{a} q1 q2 {b} q3 q4 {a}", f"{a} q1 {b} q2 {a} q3 {b}", f"{a} q1 {a}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality_rules.statistics(docs).orderBy("doc_id").collect()
    assert [r.n_repeat_words for r in got] == [base_statistics(t)["n_repeat_words"] for t in texts] == [0, 6, 12, 6]


def test_quality_rules_learn_a_list():
    rows = [{f: 0.1 for f in quality_rules.FEATURES} | {"symbol_share": 0.9 if i % 4 == 0 else 0.01, "mean_word": float(i % 7), "bad": int(i % 4 == 0), "part": i % 3} for i in range(400)]
    rules = quality_rules.learn(rows)
    assert rules and all(t.feature == "symbol_share" for t in rules[0])
    assert all(all(t.holds(r) for t in rules[0]) == bool(r["bad"]) for r in rows)
    assert quality_rules.learn([]) == [] == quality_rules.learn([r | {"bad": 0} for r in rows])


def test_kept_is_the_plain_evaluation_of_the_list(spark, docs, sf_dir):
    """Features of each text by their definitions; the first rule of the list that holds rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = quality_rules.learn(quality_rules.labelled_sample(table, labels, "doc_id", "text", "quality", 6000))
    T = quality_rules.Threshold
    for rules in (learned, [], [(T("digit_share", True, 0.2),), (T("mean_word", True, 5.5), T("upper_share", False, 0.01)), (T("repeat_share", True, 0.1), T("dup_line_share", True, 0.1))]):
        expected = []
        for i, t in rows_of(docs):
            s, text = base_statistics(t), t or ""
            count = lambda chars: sum(text.count(c) for c in chars)  # noqa: E731, B023
            lines, chars, n = sum(bool(words(x)) for x in text.split("\n")), max(1, s["word_chars"]), max(1, s["n_words"])
            f = {
                "symbol_share": s["n_symbols"] / chars, "mean_word": s["word_chars"] / n, "dup_line_share": s["n_dup_lines"] / max(1, lines), "repeat_share": s["n_repeat_words"] / n,
                "upper_share": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, "mark_share": count("!?|#*$%&<>{}[]=_~^@;") / chars, "digit_share": count("0123456789") / chars,
            }
            first = next((j for j, rule in enumerate(rules, 1) if all((f[x.feature] >= x.value) == x.above for x in rule)), 0)
            failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
            expected.append({"doc_id": i, "rule": first, "kept": not failed and not first})
        same_rows(quality_rules.judge(docs, rules), expected, ["doc_id", "rule", "kept"])


def test_pruning_leaves_one_threshold_a_feature_and_direction():
    T = quality_rules.Threshold
    rows = [{f: i / 100 for f in quality_rules.FEATURES} | {"bad": int(i > 50)} for i in range(100)]
    rule = quality_rules._prune((T("mark_share", True, 0.1), T("mark_share", True, 0.51), T("mean_word", False, 2.0)), rows)
    assert rule == (T("mark_share", True, 0.51),) or rule == (T("mark_share", True, 0.51), T("mean_word", False, 2.0))


def test_long_texts_have_exact_windows(spark):
    """Half a million different words have no repeated window; with the first ten words again at the end they have six or more."""
    text = " ".join(f"{i:x}" for i in range(500_000))
    docs = spark.createDataFrame([(1, text), (2, text + " " + " ".join(f"{i:x}" for i in range(10)))], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.statistics(docs).select("doc_id", "n_repeat_words").collect()}
    assert got == {1: 0, 2: 20}


def test_quality_rules_on_held_out_labels(spark, sf_dir):
    """Learned on half of the labels: few good documents go, and junk that the rules find is junk."""
    from pyspark.sql import functions as F

    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0
    out = quality_rules.quality_rules(docs, labels.where(half)).join(labels.where(~half), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert dict(out)[1] >= 0.97


def removals(rows, k=35):
    at = Counter()
    all_words = [words(t) for _, t in rows]
    for w in all_words:
        at.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, all_words, strict=True):
        gone = set()
        for j in range(len(w) - k + 1):
            if at[tuple(w[j : j + k])] > 1:
                gone.update(range(j, j + k))
        out.append({"doc_id": i, "n_words": len(w), "n_removed": len(gone), "kept_sha256": sha(" ".join(x for j, x in enumerate(w) if j not in gone))})
    return out


def test_repeated_spans(docs):
    same_rows(RepeatedSpans(docs).removals(), removals(rows_of(docs)))


def test_paths_are_verified_repeats(docs):
    spans = RepeatedSpans(docs)
    for r in spans.paths().collect():
        assert r.n > 1 and r.windows > 0
    cleaned = spans.deduplicated()
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    plain = {(r["doc_id"], r["n_words"] - r["n_removed"]) for r in removals(rows_of(docs))}
    assert {(r.doc_id, len(words(r.text))) for r in cleaned.collect()} == plain
    assert RepeatedSpans(empty(docs)).removals().count() == 0


def shingles(text, k=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def linked(rows, k=4, t=85):
    sets = [shingles(x, k) for _, x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same_id or (sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])):
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [{"doc_id": d, "n_shingles": len(sets[i]), "component_id": least.get(root(i))} for i, (d, _) in enumerate(rows)]


def test_jaccard_components(docs):
    got = JaccardJoin(docs).membership().selectExpr("id as doc_id", "n_shingles", "component as component_id")
    same_rows(got, linked(rows_of(docs)))
    assert JaccardJoin(empty(docs)).membership().count() == 0


def test_jaccard_links_at_the_bound(spark):
    """Chains whose neighbours lie just at and just below the bound, and groups that share most of their words."""
    import random

    rng, texts = random.Random(5), []
    for n in (40, 103, 200):
        base = [f"b{n}x{i}" for i in range(n)]
        for cut in range(0, 20, 2):
            texts.append(" ".join(base[: n - cut] + [f"c{n}x{cut}x{i}" for i in range(cut)]))
    common = [f"k{i}" for i in range(150)]
    for _ in range(60):
        at = rng.randrange(150)
        texts.append(" ".join([*common[:at], *(f"v{rng.randrange(40)}" for _ in range(rng.randrange(1, 9))), *common[at:]]))
    texts += texts[:15]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rounds in (0, 1, 2, 5):
        got = JaccardJoin(df, rounds=rounds).membership().selectExpr("id as doc_id", "n_shingles", "component as component_id")
        same_rows(got, linked(list(enumerate(texts))))


def test_long_words_of_equal_polynomials_differ():
    """A Thue-Morse word and its complement have the same polynomial modulo 2**64 for any base."""
    import numpy as np

    from tracegrain.llm.words import word_bounds, word_hashes

    for n in (64, 1024, 4096):
        x = "".join("ab"[i.bit_count() % 2] for i in range(n))
        data = np.frombuffer(f"{x} {x.translate(str.maketrans('ab', 'ba'))} {x.upper()}".encode(), np.uint8)
        start, end = word_bounds(data, np.array([0, len(data)]))
        h = word_hashes(data, start, end)
        assert len(set(h.tolist())) == 3
        low = word_hashes(data, start, end, lower=True)
        assert low[0] == low[2] == h[0] != low[1]


def test_prefixes_lose_no_link():
    """Sets that link share a shingle of their prefixes at places that the smaller one has in front and that let them link, whichever shingles are frequent."""
    import numpy as np

    from tracegrain.llm.jaccard_join import overlap, prefix

    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 97, 130, 400, 3000]:
        for t in (50, 85, 97):
            for _ in range(12):
                both, a = int(rng.integers(max(1, n // 2), n + 1)), [0, 0]
                while 100 * both >= t * (both + sum(a) + 1) and rng.random() < 0.95:
                    a[int(rng.random() < 0.5)] += 1
                s = rng.integers(0, 2**63, both + sum(a), dtype=np.uint64) * np.uint64(2)
                often = dict(zip(s.tolist(), rng.random(len(s)) < 0.4, strict=True))
                x, y = np.unique(s[: both + a[0]]), np.unique(np.concatenate([s[:both], s[both + a[0] :]]))
                assert overlap(x, y) == both
                p, q = (prefix(z, t, 4, np.array([often[v] for v in z.tolist()])).tolist() for z in sorted((x, y), key=len))
                small, large = sorted((len(x), len(y)))
                met = [(p.index(h), q.index(h)) for h in set(p) & set(q)]
                good = sum(i < small - -(-2 * t * small // (100 + t)) + 4 and (100 + t) * (4 + min(small - i - 1, large - j - 1)) >= t * (small + large) for i, j in met)
                assert good >= min(4, -(-t * large // 100))


def test_jaccard_on_one_id_with_different_texts(spark):
    rows = [(1, "a b c d e"), (7, "a b c d e"), (7, "f g h i j"), (9, "f g h i j"), (2, "k l m n"), (None, "k l m n")]
    got = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string")).membership().selectExpr("id as doc_id", "n_shingles", "component as component_id")
    same_rows(got, linked(rows))


def test_the_oracle_gives_the_same_rows(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.queries()[name](spark, sf_dir)
        same_rows(got, db.execute(sql).df().to_dict("records"), got.columns)


def test_jaccard_links_lead_over_rows_without_an_id(spark):
    """A chain whose middle has no id: its neighbours are one component."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*(f"x{j}" for j in range(cut)), *base[cut:]]) for cut in (0, 12, 24)]
    for ids in ((1, None, 3), (None, 2, None), (None, None, None)):
        rows = list(zip(ids, texts, strict=True))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        same_rows(JaccardJoin(df).membership().selectExpr("id as doc_id", "n_shingles", "component as component_id"), linked(rows))
