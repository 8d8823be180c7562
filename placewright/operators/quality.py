"""Data quality: required fields, uniqueness, references, schema contracts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_places(df: DataFrame) -> DataFrame:
    """Rows with id, name and coordinates in range (both ends count; NaN and infinities fail)."""
    return df.dropna(subset=["id", "name"]).where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column_name``, ``nulls``: one pass over the table."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns))
    return one.select(F.explode(pairs).alias("x")).select("x.*")


def repeated_keys(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``name``, ``n`` of keys that occur more than once."""
    return df.where(key.isNotNull()).groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference isn't null and isn't in the parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")


def contract_breaks(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """``column_name``, ``expected``, ``actual`` of columns that are missing or of another type; from the schema alone."""
    actual = dict(df.dtypes)
    rows = [(c, t, actual.get(c)) for c, t in expected.items() if actual.get(c) != t]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string")


def within(name: str, value: int, low: int, high: int) -> int:
    """A parameter inside its domain, both ends included; ValueError otherwise."""
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}, not {value!r}")
    return value


def given(name: str, value: str) -> str:
    """A text parameter that isn't blank; ValueError otherwise."""
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that isn't blank")
    return value
