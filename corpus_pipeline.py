"""A training corpus out of documents: quality, near duplicates, personal identifiers, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the cluster's shared folder and
read again as the next one's docs.  All but the last return the columns of documents (and any others that docs has).  Empty tables, nulls, repeated rows and
further columns are treated as the operators' modules say.

run() removes each stage's folder once the next one is written; the last one holds the rows that it returns, so that it stays until
drop_result(spark, rows) or whoever empties the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import kneser_ney, packing, pii, simhash
from keyloom.session import ensure_checkpoint_dir, remove_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose perplexity is above their language's threshold."""
    return kneser_ney.keep_trusted_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies, the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal identifiers replaced by their kinds."""
    return pii.mask_identifiers(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, position, doc_id, piece, first_token, n_tokens, text): the training sequences, with the masked text of each piece."""
    return packing.pack_texts(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_duplicates", near_duplicates), ("identifiers", identifiers), ("packing", packed)]

#: SQL can express neither the model nor the search nor the transducers; the tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    base = f"{ensure_checkpoint_dir(spark).sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove_folder(spark, f"{base}/{k - 1}")
    return docs


def drop_result(spark: SparkSession, rows: DataFrame) -> None:
    """Remove what run() wrote for rows that it returned."""
    for folder in {f.rpartition("/")[0] for f in rows.inputFiles()}:
        remove_folder(spark, folder.rpartition("/")[0])
