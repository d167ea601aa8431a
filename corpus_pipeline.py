"""A training-data pipeline of five stages over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtally.llm._common import durable, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_tone(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``sf_dir``, scores 0.7 or more go."""
    from tagtally.llm import toxicity

    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id stays; rows of null ids come last."""
    from tagtally.llm.jaccard_join import distinct_documents

    return distinct_documents(docs).select(*COLUMNS)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the spans of secrets in their texts become a mask."""
    from tagtally.llm.secret_scan import redact

    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of a document into the mix, in the shuffled order of its shard; a document may be drawn twice or not at all."""
    from tagtally.llm.mixing import mix, shuffled

    return shuffled(mix(docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, digests and the ids of every row's text."""
    import public_tokenizers

    from tagtally.llm.bpe import encode

    return encode(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "source"])


STAGES = [
    ("toxicity", clean_tone),
    ("ngram_jaccard_join", distinct_texts),
    ("secret_scans", masked_secrets),
    ("mixing", mixed_sources),
    ("bpe", token_ids),
]

#: Several stages train a model, tokenize or draw by hash; SQL does not express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``; each stage's rows are cut off from those before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
