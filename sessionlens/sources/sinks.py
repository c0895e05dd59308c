"""Writers and shared-storage checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from sessionlens.functions import columns as C
from sessionlens.functions.columns import stable_hash


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_candidates_csv(df: DataFrame, path: str) -> None:
    cols = [c for c in ("session", "aid", "type", "rank") if c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def sequence_rows(events: DataFrame) -> DataFrame:
    """Sequence-model rows with typed column headers; time in nanoseconds as float."""
    return events.select(
        F.col("session").alias("session:token"),
        F.col("aid").alias("aid:token"),
        C.nanoseconds(C.seconds(F.col("ts"))).alias("ts:float"),
    )


def write_sequence_tsv(events: DataFrame, path: str) -> None:
    """Rows of a session lie together and in (session, aid, ts) order inside each file."""
    ordered = sequence_rows(events).repartitionByRange("`session:token`", "`aid:token`", "`ts:float`")
    ordered = ordered.sortWithinPartitions("`session:token`", "`aid:token`", "`ts:float`")
    ordered.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_submission_csv(submission: DataFrame, path: str) -> None:
    submission.select("session_type", "labels").write.mode("overwrite").option("header", True).csv(path)


def write_score_chunks(scores: DataFrame, path: str, chunks: int = 20) -> None:
    """Scores in ``chunks`` directories, a session's rows in one of them."""
    chunked = scores.withColumn("chunk", F.pmod(stable_hash(F.col("session")), F.lit(chunks)))
    chunked.write.mode("overwrite").partitionBy("chunk").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see, from ``spark.checkpoint.dir``.

    Where it is unset, a single-machine session gets a temporary folder of its own; a cluster gets an error,
    because a folder on one machine would lose rows there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows read back from reliable storage, with the lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder.

    For results several later steps read: they prune columns and push filters, no step repeats the
    work behind it, and a lost executor costs a re-read. ``drop_staged`` deletes the tables.
    """
    spark = df.sparkSession
    path = stage_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession) -> str:
    """A new path among the staged tables, for files of another format."""
    return f"{_stage_root(spark)}/{uuid.uuid4().hex}"


def staged_together(*dfs: DataFrame) -> list[DataFrame]:
    """Independent tables staged as jobs that run side by side."""
    spark = dfs[0].sparkSession
    _stage_root(spark)
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(staged), dfs))


def drop_staged(*tables: DataFrame, spark: SparkSession | None = None) -> None:
    """Delete these staged tables, or with ``spark`` all that the session has staged; nothing may read them later."""
    paths = {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}
    for path in paths | ({_stage_root(spark)} if spark else set()):
        context = (spark or tables[0].sparkSession).sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """What the session stages inside the scope is deleted at its end."""
    try:
        yield
    finally:
        drop_staged(spark=spark)


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is staged inside the scope is deleted at its end, but for the tables put into the list; earlier tables stay."""
    before, keep = _staged_paths(spark), []
    try:
        yield keep
    finally:
        files = [df.inputFiles() for df in keep]
        kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for own in files for f in own}
        for path in _staged_paths(spark) - before if all(files) else ():  # a table without files can't be told from the others
            if path.rsplit("/", 1)[1] not in kept:
                target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _staged_paths(spark: SparkSession) -> set[str]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_stage_root(spark))
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().toString() for x in system.listStatus(root)} if system.exists(root) else set()


def _stage_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}"
