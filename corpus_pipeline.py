"""The training-corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. language ID: documents that no language can be given go;
2. toxicity: documents with a noisy-or score of at least 0.5 go;
3. n-gram Jaccard join: one document of each group linked by five-word shingles at 0.8 stays;
4. benchmark decontamination: documents that hold a benchmark text go;
5. best-fit packing by minimum bin slack: the kept documents' pieces with their sequence and offset.

The first four return the columns of ``documents``. No stage is expressible in SQL, so ORACLE_SQL is None and the tests
hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import drop_table, materialise, table
from foliant.llm.decontaminate import decontamination_stage
from foliant.llm.jaccard_join import dedup_stage
from foliant.llm.langid import langid_stage
from foliant.llm.packing import packing_stage
from foliant.llm.toxicity import toxicity_stage

STAGES = [
    ("language_id", langid_stage),
    ("toxicity", toxicity_stage),
    ("jaccard_join", dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if last is not None:
            drop_table(last)  # nothing reads a stage's input any more
        last = docs
    return docs
