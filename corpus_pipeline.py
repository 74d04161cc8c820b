"""A training-data pipeline over `documents`: quality, exact copies, near copies, secrets, packing.

Every stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.  All but the last
return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.common import plain_text, save, table
from threadloom.llm.exact_dedup import exact_duplicates, normalised
from threadloom.llm.packing import pack_documents, packing_digest
from threadloom.llm.quality import THRESHOLD, quality_scores
from threadloom.llm.secret_scan import all_spans, found_in, masked
from threadloom.llm.simhash import near_duplicates

VOCABULARY = "word_bpe_49k.json"


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have: longer than any of its own."""
    return name + "_" * max(map(len, docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, doesn't reject.

    A null or empty text is scored like any other, at whole length; repeated rows share their fate.  Without labels of
    both values nothing is rejected.  All columns pass through, whatever their names; an empty table stays empty.
    """
    score = fresh(docs, "score")
    scored = quality_scores(docs, table(spark, sf_dir, "labels"), docs.columns, score)
    return scored.filter(F.col(score) >= THRESHOLD).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space.

    The longest text stays, then the smallest doc_id (a null one last); of rows that are equal in both, one.  Null and
    blank texts are one group.  All columns pass through, whatever their names; an empty table stays empty.
    """
    id_, hash_ = fresh(docs, "id"), fresh(docs, "hash")
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(hash_))
    own = F.sha2(normalised(plain_text()), 256)
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (own == F.col(hash_)))
    return first_of(rows, hash_).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked fingerprints.

    Of rows with that doc_id and equal fingerprints' group, that with the longest text stays.  Null, empty and blank
    texts have fingerprint zero and link like any others; a group without any doc_id keeps one row.  All columns pass
    through, whatever their names; an empty table stays empty.
    """
    id_, hash_, group_ = (fresh(docs, x) for x in ("id", "hash", "group"))
    own = F.xxhash64(plain_text())
    found = near_duplicates(docs.select("doc_id", "text", own.alias(hash_)), keep=[hash_])
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fingerprint "), "fingerprint"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_), hash_, group.alias(group_)).distinct()
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (own == F.col(hash_)))
    return first_of(rows, group_).select(*docs.columns)


def first_of(rows: DataFrame, group: str) -> DataFrame:
    """One row per group, where a group is left with more than one: that with the longest text."""
    rank, n = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.length(plain_text())), "text", "doc_id")), fresh(rows, "n")
    return rows.withColumn(n, rank).filter(F.col(n) == 1)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of each secret and n_chars counted anew where there was one.

    Null texts stay null; repeated rows stay.  All other columns pass through, whatever their names; an empty table
    stays empty.
    """
    both, spans = fresh(docs, "both"), fresh(docs, "spans")
    found = docs.withColumn(both, found_in(spark, plain_text())).withColumn(spans, all_spans(F.col(both)))
    hit = F.size(spans) > 0
    text = masked(F.col("text"), F.col(spans))
    if "n_chars" in docs.columns:
        counted = F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", counted)
    return found.withColumn("text", text).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    A null or empty text is its end mark alone; repeated rows are packed as often as they occur; an empty table gives
    no piece.
    """
    return packing_digest(pack_documents(docs, public_tokenizers.path(VOCABULARY)))


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: A fitted network and a packing that depends on the order of rows have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
