"""The pipeline's stages against plain versions of what they keep."""

from collections import defaultdict

import corpus_pipeline
from gridloom.llm import op2_quality, op4_language, op6_jaccard
from gridloom.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        kept[name] = before, docs
        assert name == "packing" or docs.columns == columns
    before, after = kept["quality"]
    good = {r.doc_id for r in op2_quality.quality(before, table(spark, DATA, "labels")).filter("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == good
    before, after = kept["language"]
    known = {r.doc_id for r in op4_language.language_id(before).filter("lang_pred <> 'und'").collect()}
    assert {r.doc_id for r in after.collect()} == known
    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for r in before.collect():
        groups[r.text.lower() if r.text.isascii() else r.text].append(r.doc_id)
    assert len(after.collect()) <= len(groups) and {max(ids) for ids in groups.values()} >= {r.doc_id for r in after.collect()}
    before, after = kept["near_dedup"]
    heads = {r.component_id for r in op6_jaccard.near_groups(before).collect()}
    assert {r.doc_id for r in after.collect()} == heads
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
