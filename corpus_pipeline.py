"""From raw documents to packed training sequences, one Parquet table after each stage.

Defined results: empty tables give no rows; null texts go with the first stage (no known language);
rows without a doc_id take part in language identification and packing alone; of rows that repeat a
doc_id and its text one is left by the near-copy stage; other columns, whatever their names, are kept
up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matricula.llm import decontaminate, langid, linededup, packing, simhash
from matricula.llm.common import arrow_rows, materialize, new_path, scratch, table

#: Rows of an Arrow batch in all stages, some megabytes of texts. Executors and their Python workers keep
#: much of what batches have taken outside the heap, and over five stages that adds up.
ARROW_ROWS = 500


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows."""
    arrow_rows(spark, ARROW_ROWS)
    return langid.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of lines that an earlier document has."""
    arrow_rows(spark, ARROW_ROWS)
    return linededup.dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    arrow_rows(spark, ARROW_ROWS)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    arrow_rows(spark, ARROW_ROWS)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in the training sequences."""
    arrow_rows(spark, ARROW_ROWS)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The trained network, alignments, fingerprint components and token ids are beyond SQL; tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what the first four write on their way is deleted after each."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"{name}-")
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
