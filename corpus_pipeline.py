"""From raw documents to an encoded training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, mixing, multimatch, quality_rules, toxicity
from eventloom.llm.tables import discard, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is in ids; rows of one id, or of null, are judged together."""
    ids = ids.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar scores 0.5 or more go."""
    return toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep stay."""
    return _keep(docs, quality_rules.judge(docs).where("kept").select("doc_id"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) the one of the least id stays, and texts without words do."""
    linked = multimatch.link(docs, width=5, num=8, den=10)
    kept = _keep(docs, linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"))
    # Rows of one id and one text are one document.
    return kept.dropDuplicates(["doc_id", "text"])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, and the digests of ids and decoded text."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True, decode=False).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing", mix_sources),
    ("byte-pair encoding", encode),
]

#: The stages learn, link and encode in ways that SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage-{i}")
            discard(before)
    return docs
