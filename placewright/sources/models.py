"""Named queries that refer to one another: staging views and stored marts."""

import graphlib
import string

from pyspark.sql import DataFrame, SparkSession


def references(sql: str) -> set[str]:
    """The names in braces of a query text."""
    return {name for _, name, _, _ in string.Formatter().parse(sql) if name}


def build(spark: SparkSession, sources: dict[str, DataFrame], models: dict[str, str], stored: set[str], path: str) -> dict[str, DataFrame]:
    """The frames of all models, each query after those it refers to (``{name}`` in its text, a source or a model).

    Models in ``stored`` are written under ``path`` and read from there on; the others stay views, planned together with what uses them.
    Unknown names and circles are errors before anything runs.
    """
    needs = {name: references(sql) for name, sql in models.items()}
    unknown = {r for refs in needs.values() for r in refs} - set(models) - set(sources)
    if unknown or set(models) & set(sources) or stored - set(models):
        raise ValueError(f"names that are unknown or double: {sorted(unknown | (set(models) & set(sources)) | (stored - set(models)))}")
    try:
        order = [n for n in graphlib.TopologicalSorter(needs).static_order() if n in models]
    except graphlib.CycleError as e:
        raise ValueError(f"models in a circle: {e.args[1]}") from e
    built = dict(sources)
    for name in order:
        df = spark.sql(models[name], **{r: built[r] for r in needs[name]})
        if name in stored:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            df = spark.read.parquet(f"{path}/{name}")
        built[name] = df
    return {name: built[name] for name in models}
