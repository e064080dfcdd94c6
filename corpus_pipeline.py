"""Cleans the documents in five stages; each reads what the one before wrote, and all but the last return its columns.

1. quality_rules keeps documents with 50 words and more, few repeats, and metrics within the certified cutoffs.
2. near_dedup keeps one document of each group of near copies, that of the least id.
3. decontaminate drops documents in which a benchmark item is found.
4. secret_scan puts [kind] in place of each secret and sets n_chars to match.
5. sentence_pieces gives doc_id, n_tokens and digests of the ids and of the decoded text.

Cases: decisions are made per row, or per id and text where a row has copies. Null and empty texts fail the first
stage; documents without an id, and several texts under one id, each count as documents of their own; rows that agree
in id and text stay or go together in stage 2; columns beyond those of documents go through, whatever their names;
an empty table, an empty benchmark or no labels give what is left of the rules, and an empty table in the end if
nothing is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quaystone.llm import decontaminate, near_dedup, quality_rules, secret_scan, sentence_pieces
from quaystone.llm.common import shared_dir, table

#: (name, function): a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("secret_scan", secret_scan.stage),
    ("sentence_pieces", sentence_pieces.stage),
]

#: SQL can't express binomial bounds, linked components and merge-type encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; every result is written as Parquet to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
