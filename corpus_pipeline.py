"""The corpus pipeline: five of the training-data operators, one after another.

Each stage gets what the one before it left, whole, and its decisions take
effect: toxic documents go, one row of equal texts stays, one document of each
near-duplicate group stays, documents are repeated or left out as the mix
says, and the last stage packs what is left. All but the last return the
columns of documents.

The mix repeats documents, so a doc_id may occur several times in the last
stage's input; every repeat is packed as a document of its own. An empty table
passes through as one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearmatch.llm import exact_dedup, mixing, packing, simhash, toxicity
from nearmatch.llm.common import materialize, table, text_batches
from nearmatch.sources.shared import temporary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows not predicted to be toxic. Null and empty texts stay; repeated rows stay or go together; no table of labels but an empty one: all stay."""
    text_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_ordinary(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space aside: that of the smallest doc_id, of a null one only if there is no other. Null and empty texts are one text."""
    text_batches(spark)
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that of the smallest doc_id, of a null one only if there is no other. Texts without words are one group."""
    text_batches(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, none to three times. Rows without words go; null sources are one source; repeated rows are rows of their own."""
    text_batches(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences; a null or empty text is a piece of its end mark alone."""
    import public_tokenizers

    text_batches(spark)
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage but exact deduplication can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return STAGES[-1][1](spark, docs, sf_dir)
