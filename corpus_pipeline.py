"""A corpus pipeline: quality rules, exact and near deduplication, secret redaction, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of `documents`. A stage's result is written as Parquet and read again by the next, so a lost executor costs
no more than its part of one stage. Tables of a stage that has ended are deleted, texts before redaction among them.

Edge cases, for every stage: decisions are made and take effect row by row, also where rows share a doc_id or have none (rows are numbered then,
see `common.with_row_ids`); null or empty text fails the base rule of the first stage, later stages take it as empty; of identical rows
one stays; an empty table gives an empty result; extra columns of any name pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import common, exact_dedup, ngram_join, packing, quality, secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    return quality.kept_only(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _as_documents(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, and the name of that column."""
    rows, name, _ = common.with_row_ids(docs)
    return rows, name


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(common.column(name).alias("doc_id"), "text")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the first row in the order of doc_id."""
    rows, name = _as_documents(docs)
    gone = exact_dedup.deduplicated(_numbered(rows, name)).filter("NOT kept").select("doc_id")
    return common.without(rows, gone, name).select(*map(common.column, docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows joined by links of similarity 0.75 or more, the first in the order of doc_id."""
    rows, name = _as_documents(docs)
    gone = ngram_join.near_groups(_numbered(rows, name)).filter("doc_id <> component_id").select("doc_id")
    return common.without(rows, gone, name).select(*map(common.column, docs.columns))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets but copied examples are replaced in the texts, at their places; n_chars, if there is one, follows."""
    out = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the tokenised texts in sequences."""
    import public_tokenizers as tokenizers_dir

    return packing.best_fit(docs, tokenizers_dir.path("byte_bpe_50k.json"))[1]


STAGES = [("quality rules", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("secret scans", secret_stage), ("best-fit packing", packing_stage)]

#: The learned rules and the packing can't be expressed in SQL; tests/llm/test_pipeline.py chains brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        kept: list[DataFrame] = []
        before = docs
        with common.passing_tables(spark, kept):
            docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            kept.append(docs)
        common.drop(spark, before)
    return docs
