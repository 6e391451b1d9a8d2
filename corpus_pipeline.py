"""A corpus from cleaning to packed sequences: each stage calls one operator of granary.llm.

Every stage takes the columns of documents and ignores others, whatever their names. Nulls, empty and very long texts,
repeated rows, ties and empty tables are handled as the operators say; each stage tells what that makes of its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import mixing, packing, quality, secrets, simhash
from granary.llm.common import materialize
from granary.llm.queries import END_ID, SEQUENCE_TOKENS, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents in a sequence at most, so that it does not fall to crumbs; short documents meet this before the tokens.
SEQUENCE_DOCUMENTS = 16
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their failing lines removed.

    Null and empty texts fail the rules and go; rows that repeat are judged each and stay or go together.
    """
    judged = quality.judge(docs.select(*COLUMNS))
    text = F.col("cleaned")
    return judged.filter("kept").select("doc_id", text.alias("text"), "lang", "source", F.when(text == F.col("text"), F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near copies of one that stays: five-word shingles, 0.8 or more of them in common.

    Documents come in the order of their ids; of texts without a word, and of rows that repeat, the first stays. Rows
    without an id can't be told apart and all stay.
    """
    return simhash.deduplicate(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted; null and empty texts stay as they are, and so does every row."""
    clean = secrets.redact(secrets.scan(docs.select(*COLUMNS)))
    changed = F.size("found") > 0
    return clean.select("doc_id", "text", "lang", "source", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by the probabilities that bring sources, languages and topics to their targets.

    A null source or language is a value of its own. Rows of one id are kept or dropped together. Texts without a token
    take their cell's probability, which is zero in a cell that has none.
    """
    return mixing.mix(docs.select(*COLUMNS)).filter("sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most SEQUENCE_DOCUMENTS pieces.

    Null and empty texts give one piece with the end token; rows that repeat are packed each.
    """
    limits = packing.Capacities(SEQUENCE_TOKENS, SEQUENCE_DOCUMENTS, SEQUENCE_TOKENS**2)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), END_ID, limits)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("best_fit_packing", pack),
]

#: SimHash, raking and packing have no SQL form; tests/llm holds each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
