"""The pipeline stage by stage on the smallest tables: columns, kept documents, decisions that take effect."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from proofsheet.llm import common as C
from proofsheet.llm import minhash_dedup, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, C.staged(stage(spark, docs, SF), "test")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["quality rules"]
    kept = {r.doc_id for r in quality.quality_rules(before).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and 0 < len(kept) < before.count()
    before, after = seen["line dedup"]
    assert after.count() == before.count() and after.agg(F.sum("n_chars")).first()[0] <= before.agg(F.sum("n_chars")).first()[0]
    before, after = seen["near dedup"]
    parts = {r.component_id for r in minhash_dedup.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(parts)
    before, after = seen["personal data"]
    assert after.count() == before.count()
    assert not [r for r in after.collect() if re.search(r"[\w.]+@[\w-]+\.\w+", r.text or "")]
    before, after = seen["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "a b c", None, None, 5), (2, "", "en", "s", 0), (3, "x " * 300, "en", "s", 600), (3, "x " * 300, "en", "s", 600)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        stage(spark, docs.limit(0), SF).count()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == ["1", "2", "3", "None"]
