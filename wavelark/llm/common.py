"""What the training-data operators share: table access, Arrow mapping, durable cuts of lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch to a Python worker. Documents vary from nothing to megabytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`, with Arrow batches bounded by rows and by bytes, and shuffled files that go when what wrote them has ended."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """`mapInArrow`; `make()` runs once per task and returns what turns one batch into one (or None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's `spark.checkpoint.dir` names it.

    Where that is unset a local session gets a folder of its own, as in tests; a cluster is refused.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="wavelark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the checkpoint folder that all executors share, so it outlives any of them."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Keys with such a share of the rows, and at least so many of them, are looked up apart: no more than HOT keys have it.
HOT, HOT_ROWS = 1024, 64


def look_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """`rows` joined by `key` with `table`, which has each key once; both durable. Rows without a match go.

    An ordinary join puts all rows of a key into one task. Here the keys that hold a share of 1/HOT
    of the rows take their match from a broadcast of at most HOT rows; the others are joined as usual.
    """
    least = max(HOT_ROWS, rows.count() / HOT)
    hot = [r[0] for r in rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") >= least).select(key).collect()]
    if not hot:
        return rows.join(table, key)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot], f"{key} {dict(rows.dtypes)[key]}"))
    apart = rows.join(F.broadcast(table.join(keys, key, "left_semi")), key)
    return rows.join(keys, key, "left_anti").join(table, key).unionByName(apart)


def doc_text() -> "F.Column":
    """The whole text; null counts as empty."""
    return F.coalesce(F.col("text"), F.lit("")).alias("text")
