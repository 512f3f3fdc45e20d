"""The pipeline: what each stage keeps, by plain versions of its contract."""

import pytest

from tests.llm.test_words_of_texts import base_statistics, linked, shingles

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents before and after each stage."""
    from tracegrain.llm.shared import cut

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = cut(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay_but_for_the_last_stage(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns


def test_quality_rules_reject(stages):
    before, after = map(texts, stages["quality_rules"])
    assert set(after.items()) <= set(before.items())
    for i, t in before.items():
        s = base_statistics(t)
        if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]:
            assert i not in after
    assert len(after) > len(before) // 3


def test_exact_copies_go(stages):
    before, after = map(texts, stages["exact_dedup"])
    keep = {}
    for i, t in before.items():
        keep[t] = max(i, keep.get(t, i))
    assert after == {i: t for t, i in keep.items()}


def test_one_of_each_near_group_stays(stages):
    before, after = map(texts, stages["jaccard_join"])
    assert set(after) == {r["component_id"] for r in linked(list(before.items()))}
    assert all(before[i] == t for i, t in after.items())
    assert all(shingles(t) for t in after.values())


def test_personal_data_goes_and_documents_stay(stages):
    from tracegrain.llm.pii import base_spans

    before, after = map(texts, stages["pii"])
    assert set(before) == set(after)
    for i, t in before.items():
        assert not base_spans(t) or after[i] != t
        assert not any(t[a:b] in after[i] for k, a, b in base_spans(t) if k == "email")
    assert stages["pii"][1].where("n_chars != length(text)").count() == 0


def test_packing_holds_every_document(stages):
    before, after = stages["sum_of_squares_packing"]
    assert {r.doc_id for r in after.collect()} == set(texts(before))


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, expected = (sorted(map(tuple, df.select(columns).collect())) for df in (pipeline.run(spark, sf_dir), stages["sum_of_squares_packing"][1]))
    assert got == expected
