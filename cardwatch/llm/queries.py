"""Named queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cardwatch.llm import chat, oracles
from cardwatch.llm.decontaminate import leaks
from cardwatch.llm.html_text import extract_text
from cardwatch.llm.importance import resample
from cardwatch.llm.licenses import scan_licenses
from cardwatch.llm.near_dups import near_duplicates
from cardwatch.llm.packing import pack
from cardwatch.llm.phrases import collocations
from cardwatch.llm.pii import scan_pii
from cardwatch.llm.prefix_trie import heads_shared, numbered_turns, prefix_trie
from cardwatch.llm.quality import quality_rules
from cardwatch.llm.simhash import simhash_components
from cardwatch.llm.toxicity import Toxicity
from cardwatch.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each conversation, read back from its formatted string."""
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("\\### Assistant: </turn> ok"))
    turns = given.union(hard).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_chat(turns).withColumn("pieces", chat.read_turns(F.col("formatted")))
    read = F.transform("pieces", lambda p: F.concat(chat.read_role(p), F.lit("\n"), chat.read_body(p), F.lit("\n")))
    return (
        out.withColumn("loss", chat.read_loss(F.col("pieces"), F.col("loss_spans")))
        .select(
            "conv_id",
            F.size("pieces").cast("long").alias("n_turns"),
            F.sha2(F.array_join(read, ""), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(_table(spark, sf_dir, "documents")).select(*columns, "words_left")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of ids whose crc32 leaves 0 modulo 5 are held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = Toxicity.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return model.scored(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun like the first of its group."""
    turns = stage(numbered_turns(_table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(heads_shared(turns))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_chat": op2_chat,
    "op3_importance": op3_importance,
    "op4_decontamination": op4_decontamination,
    "op5_main_text": op5_main_text,
    "op6_licenses": op6_licenses,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_simhash": op12_simhash,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}

_CHAT_ESCAPED = "replace(replace(replace(replace(coalesce({}, ''), '\\', '\\b'), '###', '\\h'), '</turn>', '\\e'), '<|', '\\p')"

ORACLES: dict[str, str] = {
    "op11_prefix_trie": oracles.TRIE,
    "op13_phrases": oracles.PHRASES,
    "op2_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) AS r(t))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.OPEN + chat.SPLIT + chat.CLOSE)} + length(replace({_CHAT_ESCAPED.format("role")}, ':', '\\c')) + length({_CHAT_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id""",
}
