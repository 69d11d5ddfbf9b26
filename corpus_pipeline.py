"""The corpus pipeline: quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined cases, by stage: null, empty and wordless texts fail the quality rules; repeated rows pass them alike, lose the
same lines and stay once in near-dedup; of equal lines the largest doc_id's stay, of near copies the row of the smallest
doc_id, of several such the one whose text's hash is least; a null doc_id is the smallest document for lines and names a
group of copies only if all its ids are null; very long texts are handled whole; a table without labels keeps all that
passes the base rule; an empty table gives no rows; extra columns pass through all stages but the last, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernflow.llm import common, line_dedup, packing, quality_rules
from quernflow.llm import near_copies as near
from quernflow.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels."""
    rules = quality_rules.fit(docs, common.table(spark, sf_dir, "labels"))
    return quality_rules.filter_quality(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat over documents; n_chars follows the text."""
    rows, _, _ = line_dedup.dedup_lines(docs)
    kept = rows.select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: operator 10's links, widened by min-wise candidates, and an exact Jaccard
    similarity of five-word shingles of 0.8 or more."""
    return near.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece, with its ids."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("packing", pack)]
#: SQL can express neither the learned rules nor the vocabulary; the stages are tested against brute force (tests/llm/test_pipeline_stages.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
