"""Documents to token files: the stages of the corpus pipeline.

Each stage takes what the one before kept. All but the last return the columns
of documents, extra ones included; the last returns the documents found in the
written token files. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, jaccard_join, mixing, token_ids, toxicity
from folioscope.llm.shared import stored, table, tuned


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents the grammar rejects go.

    Null and empty texts match nothing and stay, long texts are scored whole, a
    score of exactly 0.5 goes, repeated rows are judged alike, null ids are ids
    like others, and a column called score keeps its values.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    clash = "score" in docs.columns
    scored = toxicity.score(docs.withColumnRenamed("score", "_given_score") if clash else docs, model)
    kept = scored.filter(F.col("score") < 0.5).drop("score")
    return (kept.withColumnRenamed("_given_score", "score") if clash else kept).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, the one of the smallest id.

    Texts without words (null, empty, signs only) all stay. Of rows that repeat
    id and text one stays; of texts of one id in a group the one of the smaller
    digest. A group of null ids alone keeps one row. Long texts count whole.
    """
    tuned(spark)
    return jaccard_join.representatives(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages of the benchmark are cut out of the texts.

    No row goes. Null, empty and clean texts stay as they are, long ones are
    searched whole, repeated rows are cut alike; n_chars counts what stays.
    """
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: repeated epochs are repeated rows.

    Documents of which nothing is taken go, null and empty ones among them. A
    null source is a source; rows that repeat an id or a text each take their own
    share; the document at a source's cut ends there, however long it is.
    """
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: files of ids in ascending order of doc_id, null first, read back.

    Epochs and other rows of one id are told apart by their order; a null text
    has the end id alone; columns besides id and text are not written.
    """
    return token_ids.encode_documents(tuned(spark), docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_ids", write_token_ids),
]

# Learned scores, sampled paths and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
