"""Corpus pipeline: language ID, near duplicates, repeated passages, source mix, encoding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; the last returns token counts and
digests. Stages are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, jaccard, langid, mixing, suffixtree
from driftlens.llm.common import crc_class, table, written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """Other columns than those of documents get neutral names, so none can clash with a stage's own."""
    return docs.toDF(*[c if c in DOCUMENT else f"_x{k}" for k, c in enumerate(docs.columns)])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: NULL texts and texts without letters."""
    names, docs = docs.columns, plain(docs)
    samples = langid.samples_of(docs.filter(crc_class("doc_id", 4) != 2))
    known = langid.predict(docs, samples, tuple(docs.columns))
    # Without labelled texts, or with a label of this name, texts with letters can be predicted unknown too.
    keep = (F.col("lang_pred") != langid.UNKNOWN) | F.col("text").rlike(r"\p{L}")
    return known.filter(keep).select(*docs.columns).toDF(*names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of every group of linked documents."""
    return jaccard.first_of_groups(plain(docs)).toDF(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words inside windows of 35 words that occur elsewhere; other texts stay as they are."""
    names, docs = docs.columns, plain(docs)
    cut = suffixtree.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return cut.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns]).toDF(*names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop whole documents so that sources reach their target words."""
    return mixing.repeat(plain(docs)).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of every document the mix takes, once per copy."""
    return bpe.encoded_and_back(plain(docs), bpe.tokenizer_path())


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", passages),
    ("mix_sources", mix),
    ("bpe_encode", tokens),
]
#: SQL can express neither the predictions nor the rounded mix; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL = {}
