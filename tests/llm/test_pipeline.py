"""Each stage of the pipeline against a plain version on a small table."""

import collections

import pytest
from test_small_tables import bench_words, components, docs, none, shingle_print, texts  # noqa: F401

import corpus_pipeline as pipeline
from quayside.llm import langid, secrets
from quayside.llm.common import stored

SMALL = "/root/testdata/sf0.001"


def table(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def steps(spark):
    found = [table(spark)]
    for name, stage in pipeline.STAGES:
        found.append(stored(stage(spark, found[-1], SMALL), name))
    return found


def test_columns(steps):
    for step in steps[1:-1]:
        assert step.schema.names == steps[0].schema.names and step.dtypes == steps[0].dtypes


def test_language_stage(spark, steps):
    model = langid.fit(steps[0].where(~langid.held_out()).select("text", "lang"))
    rows = steps[0].collect()
    _, _, rejected = model.predict([r.text for r in rows])
    assert sorted(r.doc_id for r in steps[1].collect()) == sorted(r.doc_id for r, x in zip(rows, rejected) if not x)


def test_near_dedup_stage(steps):
    rows = steps[1].collect()
    heads = components([shingle_print(r.text) for r in rows], [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(set(heads))


def test_near_dedup_with_repeated_ids(spark):
    first, second = "one text of some words", "quite another line that says more"
    data = [(1, first), (1, second), (1, second), (2, second), (3, "a third"), (None, first)]
    got = pipeline.near_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), SMALL)
    assert sorted(map(tuple, got.collect())) == [(1, first), (1, second), (3, "a third")]


def test_near_dedup_without_ids(spark):
    """Of a component that has no id one row stays, too."""
    data = [(None, "a text that comes twice")] * 3 + [(None, "another text"), (None, None), (None, ""), (None, " "), (7, "with an id"), (None, "with an id")]
    got = [tuple(r) for r in pipeline.near_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), SMALL).collect()]
    blank = [x for x in got if not (x[1] or "").strip()]
    assert len(blank) == 1
    assert sorted((x for x in got if x not in blank), key=repr) == sorted([(7, "with an id"), (None, "a text that comes twice"), (None, "another text")], key=repr)


def test_decontamination_stage(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = bench_words(r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    want = []
    for r in steps[2].collect():
        w, hit = bench_words(r.text), set()
        for size in {len(x) for x in windows}:
            hit |= {j for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for j in range(i, i + size)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(want)


def test_decontamination_without_ids(spark):
    dirty = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").first().text
    data = [(None, dirty), (None, "clean words only"), (None, None), (1, dirty), (1, "other clean words"), (2, "more clean words")]
    got = pipeline.decontaminate(spark, spark.createDataFrame(data, "doc_id long, text string"), SMALL)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, (x for x in data if x[1] != dirty)))


def test_secret_stage(steps):
    forest = secrets.train()
    before = steps[3].collect()
    found = secrets.scan([r.text for r in before], forest)
    want = {r.doc_id: secrets.redact(r.text, spans) for r, spans in zip(before, found)}
    after = steps[4].collect()
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if "[SECRET]" in r.text)


def test_packing_stage(steps):
    sizes = collections.Counter()
    for r in steps[5].collect():
        sizes[r.doc_id] += r.n_bytes
    assert sizes == {r.doc_id: len(r.text.encode()) for r in steps[4].collect()}


def test_odd_tables(spark, docs, none):  # noqa: F811
    for start in (docs, none):
        step = start
        for name, stage in pipeline.STAGES:
            step = stored(stage(spark, step, SMALL), name)
            assert name == "pack" or step.dtypes == start.dtypes
    assert step.count() == 0


def test_run(spark, steps):
    assert pipeline.run(spark, SMALL).count() == steps[5].count()
