"""A training corpus from raw documents: reject toxic ones, drop repeated lines, keep one of each group of near copies,
reject those with benchmark passages, encode what is left.

Every stage takes the columns of ``documents`` and, but for the last, gives the same ones. Their names are free: a stage packs
the rows, so that no column of the input meets one of its own. Defined cases: a null text is an empty text, and stays null
where nothing is taken out of it but in the line stage, which gives the empty text; null and repeated ids are rows of their own;
of rows with equal words one stays; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm import bpe, decontaminate, line_dedup, shingle_dedup, toxicity
from pixelweave.llm.common import table, written


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """``_row`` (all columns but those named), ``_id`` and ``_text``."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(F.struct(*rest, F.lit(0).alias("_")).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs``, those in ``new`` from there and the others from ``_row``."""
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"_row.`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.scored(packed(docs), model, text_col="_text", keep=("_row",))
    return unpacked(rows.filter("_score < 0.3"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(packed(docs, "text", "n_chars"), id_col="_id", text_col="_text", keep=("_row",))
    return unpacked(out, docs, text=F.col("_kept"), n_chars=F.char_length("_kept").cast("long"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_dedup.keep_one(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # A row is known by its id and the hash of its text, so texts stay out of the search.
    full = packed(docs).withColumn("_hash", F.xxhash64("_text"))
    found = decontaminate.contamination(full, table(spark, sf_dir, "benchmark"), id_col="_id", text_col="_text", keep=("_hash",))
    bad = found.filter(decontaminate.is_contaminated()).select(F.col("_id").alias("_bad"), F.col("_hash").alias("_bad_hash"))
    clean = full.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_hash") == F.col("_bad_hash")), "left_anti")
    return unpacked(clean, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(docs))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", reject_contaminated),
    ("bpe", encode),
]
ORACLE_SQL = None  # the learned lexicon has no SQL form; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
