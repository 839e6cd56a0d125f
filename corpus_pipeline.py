"""The corpus pipeline: five operators, one after another, over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to the
shared checkpoint folder and reads again as the next stage's documents, so a lost executor costs no
more than the stage it was in. Rows that a stage keeps keep their columns.

1. quality: documents that the classifier holds for bad or toxic go.
2. near_dedup: one document of each group of near duplicates (the one of the least doc_id, those
   without one last) stays. Fingerprints within two bits link, and texts whose five-word shingles
   have a similarity of 0.8 or more.
3. decontamination: documents that hold an item of the benchmark go.
4. secrets: what the scan finds is masked in the text, and n_chars follows.
5. packing: what is left is packed into sequences; its rows are pieces.

Null and empty texts pass every stage but the second, which keeps one of them; rows are told apart
by their place, not their doc_id; empty tables give no rows. No stage can be left out of SQL's sight: the classifier and the tokenizer have no SQL
form, so the pipeline is tested against the operators' own definitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wavelark.llm import decontaminate, packing, quality, secrets, simhash
from wavelark.llm.common import shared_folder, table


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", drop_bad), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("secrets", mask_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents of `sf_dir`."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:  # nothing reads it any more
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        docs, before = spark.read.parquet(out), out
    return docs
