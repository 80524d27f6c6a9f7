from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lotwise.llm import near, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Each stage's input and output."""
    out, now = {}, docs
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out.parquet")
        f(spark, now, "unused").write.parquet(path)
        fresh = spark.read.parquet(path)
        out[name] = (now, fresh)
        now = fresh
    return out


def test_stages(stages):
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == COLUMNS, name
    before, after = stages["quality_rules"]
    kept = {r.doc_id for r in quality.judge(before, carry=["doc_id"]).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() == len(kept) > 40
    before, after = stages["line_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text)
        left = r.text.split("\n")
        assert all(line in texts[r.doc_id].split("\n") for line in left)
    full = [line for r in after.collect() for line in r.text.split("\n") if len(line) >= 20]
    assert len(full) == len(set(full))
    before, after = stages["near_dedup"]
    groups = {r.doc_id: r.component_id for r in near.near_groups(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))
    before, after = stages["source_mix"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 2
    before, after = stages["bpe"]
    assert after.count() == before.count() and after.where("not exact").count() == 0


def test_awkward_tables(spark, nasty, nothing, tmp_path):
    for i, start in enumerate((nasty, nothing)):
        now = start
        for name, f in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{i}-{name}")
            f(spark, now, "unused").write.parquet(path)
            now = spark.read.parquet(path)
        assert now.count() <= start.count()


def test_registered():
    q = entry.queries()
    assert sum(n.startswith("op") for n in q) >= 10 and "pipeline" in q


def test_queries_on_the_smallest_tables(spark):
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    for name, run in entry.queries().items():
        if name.startswith("op") and name[2].isdigit():
            df = run(spark, d)
            assert df.count() > 0 and len(set(df.columns)) == len(df.columns), name
