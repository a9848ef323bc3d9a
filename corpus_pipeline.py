"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspec.llm import decontaminate, linededup, packing, simhash, toxicity
from lumenspec.llm.common import saved, table

#: Documents of this toxicity score or more go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labels of the stage's documents; rejected documents go.

    Every row is judged by its text alone, so null ids, repeated ids and repeated rows are kept or go like any other;
    null and empty texts have no passage and stay. Without labels nothing goes. Labels of null ids are ignored.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model, TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters that five documents hold stay in the one with the largest id; n_chars follows.

    Rows that repeat an id are one document; a row with a null id keeps all its lines. Null texts stay null. No row goes.
    """
    out = linededup.dedup_lines(docs, min_chars=40, min_docs=5)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(linededup.free_name(docs, "n_dropped")) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents (five-word shingles, 0.8) the one with the smallest id stays.

    A null id counts as the largest; of rows equal in id and text one stays; documents without words all stay.
    """
    return simhash.first_of_groups(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth go.

    Every row is judged by its text, so equal texts go or stay together, whatever their ids; null and empty texts stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=13, ratio=20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids. Null ids stay null, repeated rows are packed as often as they come, a null text is empty."""
    return packing.pack(docs, capacity=2048, end_id=1)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_copies), ("benchmark_decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the first stage nor the last; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
