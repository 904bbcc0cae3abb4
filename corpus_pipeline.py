"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, packing.

Every stage takes null and repeated ids, null, empty and very long texts, ties and an empty table. Null and empty
texts are in no group, hold no item and no span, score as a text without telling n-grams, and become one end token. Rows
that repeat an id are one document when groups are formed and rows of their own everywhere else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandgraph.llm import decontaminate, minhash, packing, pii, toxicity
from strandgraph.llm.common import delete, shared_folder, table
from strandgraph.operators.graph import passing_cuts


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return toxicity.without_toxic(spark, docs, sf_dir)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates."""
    return minhash.deduplicated(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and n_chars counted anew."""
    return pii.redacted(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their sequences."""
    return packing.packed_documents(docs, packing.public_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", redact_personal),
    ("packing", pack),
]
#: Models fitted on the corpus and tokens have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again.

    A stage's files are deleted once the next stage's are written, so that two stages' files are held at most; the checkpoints
    of a stage are deleted once its own files are written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    used = None
    for number, (name, stage) in enumerate(STAGES):
        with passing_cuts(spark):
            stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{number}_{name}")
        docs = spark.read.parquet(out)
        if used:
            delete(spark, used)
        used = out
    return docs
