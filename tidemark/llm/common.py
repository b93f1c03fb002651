"""Small helpers that the operators of this subpackage share.

* ``table`` reads one parquet table of a data folder through Spark's readers only.
* ``spread`` deals a table anew that too few tasks would read.
* ``batches`` sets how many rows and bytes an Arrow batch may hold, so that very long texts don't pile up in a Python worker.
* ``training_sample`` picks a bounded, deterministic sample of labelled rows for a classifier.
* ``with_score`` adds a column that a scorer computes from texts.
* ``only`` keeps stores of one operator from adding to those of another in the same Python worker.
* ``settle`` cuts lineage with ``checkpoint()`` in the folder that the session names; ``let_go`` gives that space back.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FOLDS = 5
#: Spark's own removal of shuffle files when an action ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_PER_BATCH, BYTES_PER_BATCH = 256, 4 << 20
#: Characters of one class that a classifier learns from at most.
SAMPLE_CHARS = 16_000_000


#: What operators keep between tasks in a Python worker, by operator: how to let go of it. And whose task was last here.
KEPT: dict[str, Callable[[], object]] = {}
_LAST: list[str] = []


def only(operator: str) -> None:
    """A task of this operator begins: what other operators kept in this worker goes, and the memory goes back to the system."""
    if _LAST == [operator]:
        return
    _LAST[:] = [operator]
    for name, let_go in KEPT.items():
        if name != operator:
            let_go()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it has
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt anew if fewer tasks than cores would have any, as of a table in one row group; else as they are.

    Only the files' footers are read to know, and only a table of less than one row group a core is moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    busy = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows.repartition(cores) if busy < cores else rows


def batches(spark: SparkSession) -> None:
    """An Arrow batch ends with so many rows or bytes, whichever comes first; the same for all operators, as plans run later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no classifier learns from; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; lost executors don't lose it.

    Nothing reads the shuffles behind it any more, so their files go at once instead of when the driver happens to
    collect garbage; the setting holds for this one action. The folder is the session's ``spark.checkpoint.dir``; without one, only a local session gets a folder of its own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or own_folder())
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, as the setting is read when a plan is made
    finally:
        spark.conf.set(CLEANUP, was)


def let_go(*settled: DataFrame) -> None:
    """Deletes what ``settle`` wrote for these; no frame that still has to run may come from them."""
    for df in settled:
        jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def own_folder() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="checkpoint-")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``per_class`` labelled texts of each class, never from the held-out fold, whole.

    The rows are those whose hashed id is smallest, so the choice doesn't depend on partitions or order. Of a class the
    first so many are taken that ``sample_chars`` characters hold; a row that doesn't fit any more is left out. Rows
    without id, text or label aren't learnt from; of repeated ids one row counts; ids may be of any type. The driver
    holds at most ``2 * sample_chars`` characters.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("_key"), F.col(label).cast("int").alias("y"))
    known = known.where(F.col("_key").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("_key"))).groupBy("_key").agg(F.min("y").alias("y"))
    chosen = known.where("y = 0").orderBy(F.xxhash64("_key"), "_key").limit(per_class).unionByName(known.where("y = 1").orderBy(F.xxhash64("_key"), "_key").limit(per_class))
    texts = docs.select(F.col("doc_id").cast("string").alias("_key"), "text").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen), "_key").groupBy("_key").agg(F.min("y").alias("y"), F.min("text").alias("text"))  # at most 2 * per_class rows
    upto = F.sum(F.length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64("_key"), "_key"))
    rows = found.withColumn("upto", upto).where(F.col("upto") <= sample_chars).orderBy(F.xxhash64("_key"), "_key").collect()
    return [(r["text"], r["y"]) for r in rows]


def with_score(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str, score_col: str) -> DataFrame:
    """``docs`` plus the score of each text; each task calls ``scorer`` once. A column that already has the name is replaced."""
    batches(docs.sparkSession)
    docs = docs.drop(score_col)
    names = docs.columns
    at = names.index(text_col)

    def run(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("score")
        score = scorer()
        for batch in them:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(texts), pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))
