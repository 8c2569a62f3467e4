"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, langid, mixing, oracles, simhash, spm, substrings, tokencount, topk, toxicity
from strandline.llm.quality import quality
from strandline.llm.text import GAP, SPACES
from strandline.plans.shared import fresh_path, make_folder, materialize, table

#: The end-of-document id of byte_bpe_50k.
SEPARATOR = 50256


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted between separators of flat files written from the whole table."""
    folder = fresh_path(spark, "flat-files")
    named = tokencount.write_flat_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), SEPARATOR, folder)
    named = materialize(named, "flat-names")
    make_folder(spark, folder)  # an empty table writes no file
    found = tokencount.separator_scan(tokencount.read_flat_files(spark, folder), SEPARATOR)
    out = found.where("closed").join(named.hint("merge"), ["stream", "doc_no"])
    return out.select(F.col("id").alias("doc_id"), "stream", "doc_no", "start", "n_tokens")


def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, in all and by shard, beside its source's size and target."""
    placed, drawn = mixing.mix(table(spark, sf_dir, "documents"))
    piece = F.struct("shard", "order_key", F.col("length").alias("words"))
    taken = drawn.groupBy(F.col("rank").alias("t_rank"), F.col("offset").alias("t_offset")).agg(F.sort_array(F.collect_list(piece)).alias("shards"))
    # an offset names one row with words; rows without any share theirs and are never drawn
    out = placed.join(taken, F.expr("rank = t_rank AND offset = t_offset AND size > 0"), "left")
    words = F.coalesce(F.aggregate("shards", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", words.alias("taken"), "shards")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document and whether it counts as toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "p_toxic", "toxic")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; profiles come from the four fifths that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    profiles = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted windows."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = chat.read_back(chat.windows(rows))
    part = F.struct(
        "window",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.col("loss_text").alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    whole = back.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    total = lambda field: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x[field])
    text = lambda field: F.array_join(F.transform("p", lambda x: x[field]), "")
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a passage of a smaller one, and a digest of what is kept."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)), GAP, " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 100."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixture": op2_mixture,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op7_simhash": op7_simhash,
    "op8_chat_format": op8_chat_format,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_topk": op10_topk,
    "op6_quality_rules": op6_quality_rules,
}

ORACLE_SQL = {
    "op6_quality_rules": oracles.QUALITY_RULES,
    "op8_chat_format": oracles.CHAT_FORMAT,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_topk": oracles.TOPK,
}
