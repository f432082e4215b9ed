"""The pipeline's stages, each on its own input, and run() against the stages in turn."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from folioscope.llm import decontamination, jaccard_join, mixing, token_ids, toxicity
from folioscope.llm.shared import stored

FOLDER = "/root/testdata/sf0.001"


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES:
        before, docs = docs, stored(stage(spark, docs, FOLDER), f"test-{name}")
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
            want = toxicity.score(before, model).filter("score < 0.5").count()
            assert docs.count() == want < before.count()
        elif name == "jaccard_join":
            assert {r.doc_id for r in docs.collect()} == {r.class_id for r in jaccard_join.classes(before).collect()}
        elif name == "decontamination":
            found = decontamination.find(docs, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
            assert docs.count() == before.count()
            assert found.filter(F.size("hit_words") > 0).count() == 0
        elif name == "mixing":
            assert docs.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == mixing.mix(before).agg(F.sum("taken")).first()[0]
        else:
            assert docs.count() == before.count()
    got = sorted(tuple(r) for r in cp.run(spark, FOLDER).collect())
    assert got == sorted(tuple(r) for r in docs.collect())


def test_stages_take_hard_tables(spark, clashing, empty):
    for docs in (clashing, empty):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, FOLDER)
            docs = stored(out, f"hard-{name}") if name != "token_ids" else out
        assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "jaccard_join", "decontamination", "mixing", "token_ids"]
    assert pytest.approx(token_ids.END_ID) == 2
