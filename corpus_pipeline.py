"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), its result is written as Parquet and read
again as the next stage's docs, so a lost executor costs at most one stage. A table
is deleted once the next stage's is written; the last one stays for the caller.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, linededup, mixing, simhash, toxicity
from loomline.llm.common import remove, shared_folder, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("source_mixing", mixing.stage),
]

#: Learned scores and 64-bit shingle hashes are beyond SQL; the stages have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
