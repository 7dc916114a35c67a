"""The corpus pipeline: raw documents to packed training sequences.

``STAGES`` in order; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from edgeflow.llm import stages
from edgeflow.storage import release, remove, scope, shared_dir

STAGES = [
    ("language", stages.known_language),
    ("simhash", stages.near_copies),
    ("repeats", stages.repeats),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: SQL cannot express the fitted language model nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's table is written to the shared folder.

    What a stage saved on its way goes once its table is written, and that table once the next is.
    Null, empty and letterless texts go in the first stage; null ids, repeated rows, ties, very
    long texts and columns of any name pass as each stage's docstring says.  Without labelled
    rows every text stays in the first stage.  An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{re.sub('[^a-z]', '', name)}"
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, before)
        before = path
    return docs
