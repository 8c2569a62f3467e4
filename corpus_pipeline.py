"""A corpus pipeline: toxic documents go, near copies and repeated passages go, sources are mixed, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as
the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import mixing, simhash, spm, substrings, toxicity
from strandline.plans.shared import materialize, release, table


def _aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that are named like an operator's moved aside, and what selects them again as they were."""
    moved = {c: f"__input_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not call toxic; it learns from the labelled rows of the corpus.

    Null and empty texts, very long ones, rows that repeat and rows without an id are judged by their whole
    text alone, so ties do not matter; an empty table stays empty.  Further columns, also those named like the
    model's, go through unchanged.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    body, back = _aside(docs, "severity", "p_toxic", "toxic")
    return toxicity.score(body, model).where(~F.col("toxic")).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near duplicates.

    Documents without words (null, empty, blank) share fingerprint zero and so are one another's copies.  Rows
    are told apart by id, text and all other columns: where an id repeats, each text is judged by itself, the
    smaller hash wins a tie, and rows alike in everything are one; a null id counts as the largest.  Very long
    texts are read whole; an empty table stays empty; further columns of any name go through unchanged.
    """
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a smaller id holds; ``n_chars`` counts what is left.

    A document that loses all its words goes; one that had none to begin with (null, empty, blank) stays.  Rows
    that repeat, or that share an id, never cut one another; rows without an id are left alone.  Very long texts
    are read whole; an empty table stays empty; further columns of any name go through unchanged.
    """
    body, back = _aside(docs, "n_words", "n_removed", "spans")
    cut = substrings.remove_repeats(body)
    kept = cut.where("n_removed = 0 OR n_removed < n_words")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, shard by shard: one row for what a shard takes of a pass over a document.

    Texts without words (null, empty, blank) are never taken; a null source is a source; rows that repeat and
    rows without an id are rows of their own; very long texts are taken in parts; ties are broken by hashes, so
    that reruns agree; an empty table stays empty; further columns of any name go through unchanged.
    """
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with their count and digests, and the columns of ``documents`` but the text.

    Null and empty texts have begin and end id only; very long ones are encoded whole; rows that repeat are
    encoded each, and nothing depends on their order; an empty table gives an empty result.  Further columns go
    through, but for those named like a result, which it replaces.
    """
    out = spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", drop_repeats),
    ("mixture", mix_sources),
    ("sentencepiece", encode),
]

#: Regression, hashing and segmentation have no SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again before the next, and then deleted."""
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
