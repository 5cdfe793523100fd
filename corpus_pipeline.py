"""Corpus cleaning: toxicity, near-duplicates, benchmark passages, secrets, and the mix of sources.

``run`` writes each stage's rows as Parquet in the shared folder and reads them
again for the next, so an executor's loss costs the running stage at most.  The last
stage returns the mix: which documents are taken, how often, and for how many words.

Defined cases: null and empty texts pass the first four stages as empty texts (copies of
each other, so one stays) and take no part in the mix; repeated rows and equal texts are
copies, of which one row stays, that of the least id; of equal ids with different texts
each text is judged on its own; other columns of documents are carried along; an empty
table gives an empty mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontamination, minhash, mixing, secrets, toxicity
from pagewright.llm.shared import cut, shared_folder, table

#: SQL can express neither the toxicity model nor the signatures; tests/llm/test_pipeline_stages.py compares the stages with plain versions.
ORACLE_SQL = None


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least id stays."""
    return minhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which no word is left goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark; no document goes."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with copies and words taken."""
    return mixing.mix(docs.select("doc_id", "text", "source")).where("taken > 0")


STAGES = [
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("secrets", secret_scans),
    ("mixing", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"

    def drop(path: str) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            drop(f"{folder}/{number - 1}")
    mixed = cut(STAGES[-1][1](spark, docs, sf_dir))  # narrow rows; the texts are no longer needed
    drop(folder)
    return mixed
