"""Relations that many queries start from, for Spark and, as CTEs, for SQL."""

from pyspark.sql import functions as F

from placewright.functions.text import latest
from placewright.sources.tables import table

#: Latest row of every place.
PL = "pl as (select * from (select *, row_number() over (partition by id order by updated_at desc nulls last, source_content_hash desc nulls last) rn from silver_places) where rn = 1)"
#: Links without repeats, with the category's name.
PC = "pc as (select distinct l.place_id, l.category_id, c.name category from silver_place_categories l join silver_categories c on c.id = l.category_id)"
#: Places whose coordinates can be used.
OK = "lat between -90 and 90 and lon between -180 and 180"


def places(spark, d):
    """The latest row of every place; ties fall to the hash and then to the other columns, so the row doesn't depend on the order of reading."""
    rows = table(spark, d, "silver_places")
    rest = [c for c in rows.columns if c not in ("id", "updated_at", "source_content_hash")]
    return latest(rows, ["id"], [F.desc_nulls_last("updated_at"), F.desc_nulls_last("source_content_hash"), *(F.desc_nulls_last(c) for c in rest)])


def categories(spark, d):
    return table(spark, d, "silver_categories")


def links(spark, d):
    return table(spark, d, "silver_place_categories").distinct()


def named_links(spark, d):
    """Links with category names. The category table is a small dimension, which Spark broadcasts by its size."""
    c = categories(spark, d).select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return links(spark, d).join(c, "category_id").select("place_id", "category_id", "category")


def usable():
    return F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)


def joined(c, sep="|"):
    return F.array_join(c, sep)


def avg_to(c, digits):
    """A rounded average. The nudge keeps exact halves from falling either way with the order of summation."""
    return F.round(F.avg(c) + 1e-9, digits)
