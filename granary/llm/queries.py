"""The ten registered queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, media, mixing, packing, quality, secrets, simhash, tokencount, warc
from .oracle import ORACLE_SQL as ORACLE_SQL

#: Fixed values of the contracts.
SEQUENCE_TOKENS = 4096
END_ID = 1


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over all documents."""
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost_chars")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.RULES if r.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    listed = secrets.as_text(F.filter("found", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(listed, 256).alias("base_sha256"), secrets.as_text(F.col("found")).alias("spans"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, rendered and read back."""
    ok = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", ok), (-7, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.read_back(chat.format_chats(chat.message_log(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling probabilities of all documents, and the sample."""
    found = mixing.mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), "probability", "sampled")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of at most 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID, packing.Capacities(SEQUENCE_TOKENS, SEQUENCE_TOKENS, SEQUENCE_TOKENS**2))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    ids = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return warc.read_archives(archives).select(ids("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ids("refers_to").alias("refers_to"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents."""
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), SEQUENCE_TOKENS)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as grey images, stored, read back and hashed; tile_sha256 is of the NPY tile's bytes."""
    found = media.text_media(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three quarters of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    dictionaries = langid.learn(docs, ~held_out)
    return langid.predict(docs, dictionaries).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_chat_formatting": op3_chat_formatting,
    "op6_source_mixing": op6_source_mixing,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_warc": op5_warc,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_media_columns": op9_media_columns,
    "op10_language_id": op10_language_id,
}
