"""The pipeline's stages against what the operators say, each on what the one before kept."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline as cp
from eventloom.llm import mixing, multimatch, quality_rules, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: collections.Counter(r[0] for r in df.select("doc_id").collect())
    kept = []
    for i, (_, stage) in enumerate(cp.STAGES):
        kept.append(docs)
        out = stage(spark, docs, SF)
        if i < len(cp.STAGES) - 1:
            assert out.columns == list(cp.COLUMNS)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    raw, mild, good, single, mixed = kept
    assert ids(mild) == ids(raw.join(toxicity.classify(raw, labels).where("predicted = 0").select("doc_id"), "doc_id"))
    assert ids(good) == ids(quality_rules.judge(mild).where("kept"))
    assert ids(single) == ids(multimatch.link(good, width=5, num=8, den=10).where("doc_id = component_id"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(single).collect()}
    got = collections.Counter()
    for r in mixed.select("doc_id", mixing.words(F.col("text")).alias("w")).collect():
        got[r["doc_id"]] += r["w"]
    assert got == collections.Counter({k: v for k, v in taken.items() if v})
    assert docs.count() == mixed.count() and docs.where("n_tokens <> size(token_ids)").count() == 0


def test_stages_on_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "few words", None, None, 9), (2, "few words", None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in cp.STAGES:
            stage(spark, df, SF).collect()
