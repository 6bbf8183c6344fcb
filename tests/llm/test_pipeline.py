"""The pipeline's stages, each on rows of its own."""

import corpus_pipeline
from homeledger.llm import decontamination, language_id, mixing
from homeledger.llm.common import table
from test_near_copies import brute


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("n_chars", "weight").selectExpr("*", "'x' AS fp")
    rows = [(None, "a text without an id " * 9, "en", None, 3, "x"), (10**6, "12 34", None, "s", 3, "x"), (10**6 + 1, None, "en", "s", 3, "x")]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        after = {(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()}
        assert after < before, name
        if name == "language_id":
            assert not {d for d, _ in after} & {10**6, 10**6 + 1}
            found = language_id.language_id(docs.select("doc_id", "text", "lang")).collect()
            sure = {(r.doc_id, r.text): r.lang_pred for r in found if r.lang_pred != "und" and r.lang_score >= corpus_pipeline.LEAST_SCORE}
            assert {((r.doc_id, r.text), r.lang) for r in kept.collect()} == set(sure.items())
        if name == "near_duplicates":
            rows = docs.selectExpr(f"{corpus_pipeline.KEY} AS k", "doc_id", "text").orderBy("k").collect()
            root = brute([r.text for r in rows])
            assert after == {(r.doc_id, r.text) for i, r in enumerate(rows) if root[i] == i}
        if name == "decontamination":
            found = decontamination.contamination(docs.selectExpr("doc_id", "text"), table(spark, sf, "benchmark"))
            assert before - after == {(r.doc_id, r.text) for r in docs.join(found.where("contaminated").select("doc_id"), "doc_id").select("doc_id", "text").collect()}
        if name == "mixing":
            found = mixing.mix(docs.drop("weight")).collect()
            assert after == {(r.doc_id, r.text) for r in found if r.sampled}
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == docs.count()


def test_language_of_empty_stage(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    assert language_id.UND == "und"
