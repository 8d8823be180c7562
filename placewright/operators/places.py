"""Places: categories per place, snapshots, summaries, cells, graph, searches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def category_lists(named: DataFrame) -> DataFrame:
    """``place_id``, ``categories``: distinct names in order."""
    return named.groupBy("place_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


def with_categories(places: DataFrame, named: DataFrame) -> DataFrame:
    """Places with their category list; empty where there is none."""
    lists = category_lists(named).withColumnRenamed("place_id", "__p")
    empty = F.array().cast("array<string>")
    return places.join(lists, F.col("id") == F.col("__p"), "left").withColumn("categories", F.coalesce("categories", empty)).drop("__p")


def price_rollup(prices: DataFrame) -> DataFrame:
    """Per place and currency (null is one) the lowest minimum and highest maximum; a missing maximum is the minimum."""
    rows = prices.dropna(how="all", subset=["min_price", "max_price", "currency"])
    return rows.groupBy("place_id", "currency").agg(F.min("min_price").alias("min_price"), F.max(F.coalesce("max_price", "min_price")).alias("max_price"))


def snapshot(places: DataFrame, named: DataFrame, prices: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per place with child aggregates. Each child is reduced before the join, so nothing fans out."""
    price = prices.groupBy(F.col("place_id").alias("__r")).agg(F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"), F.max("currency").alias("currency"))
    date = dates.groupBy(F.col("place_id").alias("__d")).agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
    full = with_categories(places, named)
    return full.join(price, F.col("id") == F.col("__r"), "left").join(date, F.col("id") == F.col("__d"), "left").drop("__r", "__d")


def cells(scored: DataFrame, least: int = 2, names: int = 5) -> DataFrame:
    """Clusters of a cell column: total score, places, first named city by id, first distinct names by id.

    Names are reduced to their first id per cell before they are ranked, so a cell's list never grows
    beyond ``names``.
    """
    stats = scored.groupBy("cell").agg(F.sum("score").alias("total_score"), F.countDistinct("id").alias("poi_count"), F.min_by("city", F.when(F.col("city") != "", F.col("id"))).alias("city")).where(F.col("poi_count") >= least)
    first = scored.where("name is not null").groupBy("cell", "name").agg(F.min("id").alias("first_id"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("first_id", "name"))
    top = first.withColumn("r", rank).where(F.col("r") <= names).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("r", "name"))).alias("x"))
    return stats.join(top.select("cell", F.col("x.name").alias("sample_names")), "cell", "left")


def related(places: DataFrame, links: DataFrame, seeds: DataFrame, k: int, same_city: bool) -> DataFrame:
    """Per seed (``id``) the first ``k`` distinct names of other places that share a category (and, if wanted, the city), by name.

    Two hops over the bridge. The names of a category (in a city) are made few before they meet its seeds: only the
    first ``k + 1`` can be wanted, since a seed is left out at most once. So a popular category in a large city never joins all its places with all its seeds.
    """
    seed = seeds.select(F.col("id").alias("seed")).distinct()
    group = ["category_id", "other_city"] if same_city else ["category_id"]
    home = places.select(F.col("id").alias("seed"), F.col("city").alias("other_city"))
    hop = links.join(seed, links.place_id == F.col("seed")).select("seed", "category_id").join(home, "seed").select("seed", *group)
    info = places.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("city").alias("other_city"))
    other = links.select(F.col("place_id").alias("other"), "category_id").join(info, "other").where("other_name is not null")
    names = other.groupBy(*group, "other_name").agg(F.min("other").alias("other"), F.max("other").alias("last"))
    ranked = names.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy("other_name"))).where(F.col("r") <= k + 1)
    pairs = hop.join(ranked, group).where((F.col("other") != F.col("seed")) | (F.col("last") != F.col("seed")))
    return _first_names(seed, pairs.select("seed", "other_name").distinct(), k)


def _first_names(seed: DataFrame, found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("other_name"))
    lists = found.withColumn("r", rank).where(F.col("r") <= k).groupBy("seed").agg(F.array_sort(F.collect_list("other_name")).alias("related"))
    return seed.join(lists, "seed", "left").select(F.col("seed").alias("id"), F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def search(places: DataFrame, named: DataFrame, city: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Places of a city (any case) with at least one of the wanted categories (any case); each filter is optional."""
    found = places if city is None else places.where(F.lower("city") == city.lower())
    if wanted:
        hit = named.where(F.lower("category").isin([w.lower() for w in wanted])).select(F.col("place_id").alias("id")).distinct()
        found = found.join(hit, "id", "left_semi")
    return found


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)
