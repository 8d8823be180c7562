"""Cutting lineage through a folder that all executors share."""

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the session's ``spark.checkpoint.dir``; a local one, deleted at the end, only where that is unset."""
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        told = tempfile.mkdtemp(prefix="placewright-checkpoint-")
        atexit.register(shutil.rmtree, told, True)
    context.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; it survives a lost executor.

    Spark deletes the files with the last reference if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared checkpoint folder, for tables that a query writes and reads again."""
    import uuid

    _SCRATCH.append(f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def clear_scratch(spark: SparkSession) -> None:
    """Delete what ``scratch`` named so far; for when the results of those queries have been read."""
    from placewright.sources.tables import delete_path

    while _SCRATCH:
        delete_path(spark, _SCRATCH.pop())
