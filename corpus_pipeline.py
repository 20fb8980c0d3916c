"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, packing, each stage by its operator in tessera.llm."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, mixing, ngrams, packing, suffixes
from tessera.llm.common import MADE, dropped, shared_dir, small_batches, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


_LEFT: list[str] = []  # intermediate tables of the stage called last


def _stage(function):
    """A stage deletes the intermediate tables of the one before it: its input is that one's output, written and read again."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        dropped(spark, _LEFT)
        before = set(MADE)
        out = function(spark, docs, sf_dir)
        _LEFT[:] = [x for x in MADE if x not in before]
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labelled texts at hand; documents without a letter go, and where any text has a label, those with hardly any n-gram that two texts of a language have.

    So null and empty texts go; repeated rows stay, each judged for itself; a null label doesn't count; an empty table gives no rows;
    long texts are judged as a whole. Columns other than those of documents don't come along.
    """
    filters = langid.fit(docs)
    said = langid.identify(docs.select(*COLUMNS), filters)
    keep = (F.col("lang_pred") != "und") & (F.col("known") >= 0.1) if filters.languages else F.col("text").rlike(r"\p{L}")
    return said.filter(keep).select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity 0.8 or more: one document of each class that links connect stays.

    That with the smallest doc_id does; null ids come last, and of equal ids the first row read stays. Repeated rows are of one class.
    Texts without words link with nothing and stay (null ones as empty); an empty table gives no rows.
    """
    return ngrams.keep_one(docs.select(*COLUMNS), threshold=0.8, words=5)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that also start elsewhere go; documents of which no letter or digit is left go with them.

    So null and empty texts go; of repeated rows all copies lose what they share; halves of characters that a cut leaves go too.
    """
    out = suffixes.remove_repeats(docs.select(*COLUMNS), text_out=True)
    return _documents(out.filter(F.col("text").rlike(r"[\p{L}\p{N}]")))


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of 64 words taken to the sources' targets. The words a document gives in a pass, block after block, are a row of their own.

    Null sources are a source, the last one; null and empty texts have no words, so they aren't taken; repeated rows count each for itself.
    """
    return _documents(mixing.mixed_texts(docs.select(*COLUMNS)))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids, a row for each piece; a null or empty text is its end id alone; an empty table gives no rows."""
    pieces = packing.pack(docs, vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("source_mixing", mixed), ("packing", packed)]

#: Bloom filters, the binary round trips and seeded draws have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; of what is written on the way, only the last output stays."""
    docs, source = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        dropped(spark, [*_LEFT, *source])
        _LEFT.clear()
        docs, source = spark.read.parquet(path), [path]
    return docs
