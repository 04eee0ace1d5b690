"""Five stages that make a training corpus of ``documents``: each calls one operator of ``cubelens.llm``.

A stage is ``function(spark, docs, sf_dir) -> DataFrame``; it works on all rows that the stage before has kept, and all
but the last return rows with the columns of ``documents``. :func:`run` writes each stage's rows as Parquet to the
shared folder (``spark.checkpoint.dir``) and reads them again, so that a lost executor costs one stage at most. Texts of
any length are taken whole, equal scores and sizes are settled by id, and columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubelens.llm import common, decontaminate, mixing, simhash, token_output, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; the model is fitted on labelled rows of ``docs``.

    Null texts count as empty and stay; each of repeated rows is judged alike; no rows give none.
    """
    common.ship(spark)
    return toxicity.reject(docs, spark, sf_dir)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that SimHash links reach, the one with the smallest id stays.

    Null and empty texts are one group; of rows that share the id one stays; rows without an id stay; no rows give none.
    """
    common.ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of ``benchmark`` go.

    Null and empty texts stay, null items match nothing; each of repeated rows is judged alike; no rows give none.
    """
    common.ship(spark)
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, a row for each draw of a document, shuffled by shard.

    A null source is one of its own; texts without words are drawn with their block; repeated rows are drawn alike; no
    rows give none.
    """
    common.ship(spark)
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: ``doc_id, start, n_tokens, ids_crc32, n_bytes`` of each draw.

    Null texts are the end id alone; rows without an id come first; repeated rows each have their ids; no rows give none.
    """
    common.ship(spark)
    path = common.scratch(spark, "token-files")
    token_output.write(docs, path)
    return token_output.read(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_tokens),
]

#: The grammar, the fingerprints and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
