"""A corpus pipeline over ``documents``: each stage's result is written as Parquet and read again by the next.

Toxic documents go; of near duplicates one stays; repeated passages are cut out; sources are brought to their
target weights by repetition; and what is left is packed into sequences. All but the last stage return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonoframe.llm import mixing, packing, simhash, suffix_dedup, toxicity
from sonoframe.llm.common import scratch_paths, stored_at, sweep, written

#: Fixed by the vocabulary: what ends a document.
END_ID = 2
#: The fold that toxicity isn't learned from.
FOLDS, HELD_OUT = 5, 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from this corpus's labels, doesn't hold to be toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(*toxicity.labelled_sample(docs, labels, FOLDS, HELD_OUT)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each SimHash component."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 100-byte strings; one that nothing is left of stays, empty."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, smaller sources up to the repetition limit: one row for each pass over it."""
    return mixing.mix(docs, marks=False)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, each with its end, in bins of the permitted lengths; packing.sequences() puts them together. A document that became empty is its end alone."""
    import public_tokenizers

    return packing.pack_documents(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"), end_id=END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = scratch_paths()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            # the stage's result is stored, so what it and those before it kept can go
            docs = written(docs, name.replace(" ", "-"))
            sweep(spark, [*held, stored_at(docs)])
    return docs
