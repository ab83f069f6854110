"""A corpus from raw documents to packed bins: rules, classifier, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes each stage's rows as Parquet in the
folder that the cluster shares and reads them again as the next stage's documents. A stage's folder is removed once the
next stage is written; the last one stays, since the result reads it.

Null or empty text fails the rules and goes in the first stage. Null ids, languages and sources are kept. Very long texts are
judged, compared, scanned and packed whole. Of repeated rows one stays (near-duplicates). Ties of the classifier's keys
are kept together. An empty table gives an empty result. Further columns of documents, whatever their names, come through
all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftwell.functions.folders import shared_folder
from siftwell.llm import importance, packing, quality_rules, secrets_scan, similar
from siftwell.llm.shared import table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that importance resampling takes."""
    return importance.keep_selected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4's index: one document of each near-duplicate group, five-word shingles, Jaccard similarity of 0.8 at least."""
    return similar.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents, with secrets replaced in their texts."""
    return secrets_scan.redacted(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the bin of every piece of every document."""
    return packing.packed(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_duplicates), ("secret scan", secrets), ("best-fit packing", bins)]

#: The classifier's models and the packing can't be told in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole documents table."""
    folder, docs, before = shared_folder(spark), table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        path = f"{folder}/stage-{uuid.uuid4().hex}-{n}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
