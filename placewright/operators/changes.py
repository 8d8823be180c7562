"""Change data capture and upserts as joins; every function returns a new table, lazily."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame, key: str | list[str], digest: str) -> DataFrame:
    """Every key of ``new`` with ``status``: inserted, updated or unchanged. Keys are unique on both sides."""
    keys = [key] if isinstance(key, str) else key
    o = old.select(*(F.col(k).alias(f"__k_{k}") for k in keys), F.col(digest).alias("__old"), F.lit(True).alias("__seen"))
    status = F.when(F.col("__seen").isNull(), "inserted").when(F.col("__old").eqNullSafe(F.col(digest)), "unchanged").otherwise("updated")
    same = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    return new.join(o, same, "left").withColumn("status", status).drop(*(f"__k_{k}" for k in keys), "__old", "__seen")


def changed_only(old: DataFrame, new: DataFrame, key: str | list[str], digest: str) -> DataFrame:
    """Rows of ``new`` that are unknown or differ."""
    return classify(old, new, key, digest).where("status <> 'unchanged'").drop("status")


def merge(old: DataFrame, new: DataFrame, key: str, digest: str, touched: str, stamp: Column) -> DataFrame:
    """Upsert by hash: unchanged rows keep the old row, others take the new one with ``touched`` set.

    One full outer join reads either side once, so a chain of merges stays as long as it has links.
    """
    side = lambda df, name: df.select(F.col(key).alias(f"__{name}"), F.struct(*old.columns).alias(name))
    fresh = new.withColumn(touched, stamp)
    both = side(old, "o").join(side(fresh, "n"), F.col("__o") == F.col("__n"), "full_outer")
    same = F.col("n").isNull() | (F.col("o").isNotNull() & F.col(f"o.`{digest}`").eqNullSafe(F.col(f"n.`{digest}`")))
    return both.select(F.when(same, F.col("o")).otherwise(F.col("n")).alias("x")).select(*(F.col(f"x.`{c}`").alias(c) for c in old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of ``new`` and those of ``old`` whose key isn't in ``new``."""
    return old.join(new.select(key), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def replace_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Children of the given parents are replaced by ``fresh``; repeated rows are dropped."""
    kept = children.join(parents.select(parent_key).distinct(), parent_key, "left_anti")
    return kept.select(children.columns).unionByName(fresh.select(children.columns)).dropDuplicates()


def without(rows: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't rejected."""
    return rows.join(rejected.select(key), key, "left_anti")


def stale(rows: DataFrame, updated: str, marker: str) -> DataFrame:
    """Rows never synchronised, or updated since."""
    return rows.where(F.col(marker).isNull() | (F.col(updated) > F.col(marker)))


def marked(rows: DataFrame, updated: str, marker: str, now: Column) -> DataFrame:
    """The rows with the marker set where they were stale."""
    return rows.withColumn(marker, F.when(F.col(marker).isNull() | (F.col(updated) > F.col(marker)), now).otherwise(F.col(marker)))


def rebuild_needed(rows: DataFrame, updated: str, marker: str, derived_exists: bool) -> bool:
    """Whether a derived table is built again: it isn't there, or some row was never synchronised or has changed since."""
    return not derived_exists or not stale(rows, updated, marker).isEmpty()


def replace_unless_empty(fresh: DataFrame, path: str) -> bool:
    """Write a derived table anew; an empty result leaves the old one as it is. Tells whether it was written.

    The caller sets its marks only then. The new table is written beside the old one and read back before it takes its place.
    """
    from placewright.sources.tables import delete_path, move_path

    spark = fresh.sparkSession
    beside = path.rstrip("/") + ".new"
    fresh.write.mode("overwrite").parquet(beside)
    if spark.read.parquet(beside).isEmpty():
        delete_path(spark, beside)
        return False
    delete_path(spark, path)
    move_path(spark, beside, path)
    return True
