"""The corpus pipeline: documents through five stages, each written as Parquet and read by the next."""

import public_tokenizers as public
from pyspark.sql import DataFrame, SparkSession

from fragloom.llm import decontaminate, quality, secret_scan, simhash
from fragloom.llm.queries import RANKS, bpe_digests, table
from fragloom.operators.lineage import materialise, remove


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that fail a base rule or a certified cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, encoded and decoded."""
    return bpe_digests(docs.select("doc_id", "text"), public.path(RANKS), public.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_redaction", secret_redaction), ("tokens", tokens)]

#: Fingerprints, the test battery and byte-pair merges are not expressible in plain SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        following = materialise(stage(spark, docs, sf_dir))
        if i:  # the table between two stages has had its reader
            remove(docs)
        docs = following
    return docs
