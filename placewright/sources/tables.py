"""Reading the project's tables from a directory of Parquet files."""

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``root`` (a file or a directory of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def views(spark: SparkSession, root: str, *names: str) -> None:
    """Register tables as temporary views under their own names."""
    for name in names:
        table(spark, root, name).createOrReplaceTempView(name)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    system, found = _path(spark, path)
    return system.exists(found)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, found = _path(spark, path)
    system.delete(found, True)


def move_path(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder."""
    system, found = _path(spark, old)
    if not system.rename(found, _path(spark, new)[1]):
        raise OSError(f"{old} can't be moved to {new}")
