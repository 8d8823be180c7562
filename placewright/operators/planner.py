"""Day plans over candidate places: ranking, schedules, legs, round robin, nearest centres, K-means."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.scalars import haversine_km
from placewright.operators.places import top_per_group
from placewright.operators.quality import within
from placewright.plans.cut import cut


def nearest_center(places: DataFrame, centers: list[tuple[float, float]]) -> DataFrame:
    """``day`` (from 1) and ``d2`` (squared degrees) of the nearest centre; the first of equal ones.

    Centres are a short list of parameters, so they become an expression, not a join.
    """
    d2 = [F.pow(F.col("lat") - a, 2) + F.pow(F.col("lon") - o, 2) for a, o in centers]
    best = F.array_min(F.array(*(F.struct(d.alias("d2"), F.lit(i + 1).alias("day")) for i, d in enumerate(d2))))
    return places.withColumn("__n", best).withColumn("day", F.col("__n.day")).withColumn("d2", F.col("__n.d2")).drop("__n")


def schedule(rank: Column, first: str = "09:00", visit_min: int = 120, gap_min: int = 30) -> tuple[Column, Column]:
    """Start and end clock of the stop with this rank; the clock wraps at midnight."""
    h, m = map(int, first.split(":"))
    start = F.lit(60 * h + m) + (rank - 1) * (visit_min + gap_min)
    clock = lambda x: F.format_string("%02d:%02d", F.pmod((x / 60).cast("int"), F.lit(24)).cast("int"), F.pmod(x, F.lit(60)).cast("int"))
    return clock(start), clock(start + visit_min)


def legs(stops: DataFrame, group: list[str], rank: str) -> DataFrame:
    """``leg_km`` from the stop before within the group; null for the first."""
    w = Window.partitionBy(*group).orderBy(rank)
    return stops.withColumn("leg_km", haversine_km(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))


def round_robin(places: DataFrame, group: list[str], order: list[Column], days: int, most: int) -> DataFrame:
    """The first ``days * most`` rows of each group dealt to days in turn: ``day``, ``stop`` (both from 1)."""
    within("days", days, 1, 50)
    within("most", most, 1, 50)
    first = top_per_group(places, group, order, days * most, "__r")
    return first.withColumn("day", F.pmod(F.col("__r") - 1, F.lit(days)) + 1).withColumn("stop", ((F.col("__r") - 1) / days).cast("int") + 1).drop("__r")


def kmeans_days(places: DataFrame, k: int, starts: int = 10) -> DataFrame:
    """Days by K-means on degrees, the best of several starts, all of which move at once: ``day``, ``d2`` (squared degrees to the day's centre).

    Rows without coordinates are left out; days are numbered by their centre's coordinates.
    """
    ready = places.dropna(subset=["lat", "lon"]).where(~F.isnan("lat") & ~F.isnan("lon"))
    if k < 2:
        return ready.withColumn("day", F.lit(1)).withColumn("d2", F.lit(0.0))
    found = kmeans_centers(ready.withColumn("__g", F.lit(1)), "__g", k, starts).first()  # one row
    if found is None:
        return ready.withColumn("day", F.lit(1)).withColumn("d2", F.lit(0.0))
    centers = [(found[f"a{j}"], found[f"o{j}"]) for j in range(k) if found[f"a{j}"] is not None]
    return nearest_center(ready, centers)


def _distances(k: int) -> tuple[list[Column], Column, Column]:
    """Squared degrees to each of ``k`` centres (``a0``, ``o0`` and so on), the least, and the first centre that has it; missing centres are null, which least passes over."""
    d2 = [F.pow(F.col("lat") - F.col(f"a{j}"), 2) + F.pow(F.col("lon") - F.col(f"o{j}"), 2) for j in range(k)]
    least = F.least(*d2) if k > 1 else d2[0]
    return d2, least, F.coalesce(*(F.when(d == least, j) for j, d in enumerate(d2)))


def kmeans_centers(places: DataFrame, group: str, k: int, starts: int = 10, rounds: int = 50, small: int = 100_000) -> DataFrame:
    """K-means centres of many groups at once, the best of several starts: ``group``, ``a0``, ``o0`` and so on, in the order of their coordinates.

    Every row of every group counts. Equal points are taken together with their number, and each round of
    Lloyd's iterations is one aggregation over all points, groups and starts that still move, so a group of any
    size is summed in parts by many tasks. Centres are broadcast as long as they are at most ``small`` rows.
    Starts are ``k`` distinct points, the first by a hash; a group of fewer points lacks the last centres.
    """
    numbers = range(k)
    near = lambda df: F.broadcast(df) if df.count() <= small else df
    _, least, day = _distances(k)

    usable = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
    points = cut(places.where(F.col(group).isNotNull() & usable).groupBy(F.col(group).alias("g"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).agg(F.count(F.lit(1)).alias("w")))
    w = Window.partitionBy("g", "s").orderBy(F.xxhash64("lat", "lon", "s"), "lat", "lon")
    first = points.select("g", "lat", "lon", F.explode(F.sequence(F.lit(1), F.lit(starts))).alias("s")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    pick = lambda c, j: F.max(F.when(F.col("r") == j + 1, F.col(c)))
    centers = cut(first.groupBy("g", "s").agg(*(pick(c, j).alias(f"{n}{j}") for j in numbers for n, c in (("a", "lat"), ("o", "lon")))))

    settled = None
    for turn in range(rounds + 1):
        at = points.join(near(centers), "g").withColumn("d2", least).withColumn("j", day)
        mine = lambda x, j: F.sum(F.when(F.col("j") == j, x))
        sums = at.groupBy("g", "s").agg(
            F.sum(F.col("w") * F.col("d2")).alias("cost"),
            *(F.first(f"{n}{j}").alias(f"{n}{j}") for j in numbers for n in "ao"),
            *(F.coalesce(mine(F.col("w") * F.col(c), j) / mine(F.col("w"), j), F.first(f"{n}{j}")).alias(f"{n}{j}_") for j in numbers for n, c in (("a", "lat"), ("o", "lon"))),
        )
        names = [f"{n}{j}" for j in numbers for n in "ao"]
        moves = F.lit(False)
        for n in names:
            moves = moves | F.coalesce(F.abs(F.col(f"{n}_") - F.col(n)) > 1e-8 + 1e-5 * F.abs(F.col(n)), F.lit(False))
        state = cut(sums.withColumn("moves", moves if turn < rounds else F.lit(False)))
        still = state.where(~F.col("moves")).select("g", "s", "cost", *names)
        settled = still if settled is None else settled.unionByName(still)
        centers = state.where("moves").select("g", "s", *(F.col(f"{n}_").alias(n) for n in names))
        if centers.isEmpty():
            break

    # the centres in the order of their coordinates; those that a group of few points lacks are left out
    ordered = F.array_sort(F.filter(F.array(*(F.struct(F.col(f"a{j}").alias("lat"), F.col(f"o{j}").alias("lon")) for j in numbers)), lambda c: c["lat"].isNotNull()))
    best = settled.groupBy("g").agg(F.min_by(F.struct(*names), F.struct("cost", "s")).alias("b")).select(F.col("g").alias(group), "b.*").withColumn("c", ordered)
    return cut(best.select(group, *(F.get("c", F.lit(j))[x].alias(f"{n}{j}") for j in numbers for n, x in (("a", "lat"), ("o", "lon")))))


def kmeans_per_group(places: DataFrame, group: str, k: int, starts: int = 10, rounds: int = 50, small: int = 100_000) -> DataFrame:
    """K-means days for many groups at once: ``group``, ``id``, ``day``."""
    best = kmeans_centers(places, group, k, starts, rounds, small)
    if best.count() <= small:
        best = F.broadcast(best)
    return places.select(group, "id", "lat", "lon").join(best, group).select(group, "id", (_distances(k)[2] + 1).alias("day"))


def weather_suits(outdoor: Column, rain: Column, precipitation: Column, code: Column, wind: Column) -> Column:
    """1 in good or unknown weather, else one less the share of stops in the open."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    bad = (known(precipitation) > 0) | (known(rain) > 0) | (known(code) >= 51) | (known(wind) >= 40)
    return F.when(bad, F.greatest(F.lit(0.0), 1 - outdoor)).otherwise(1.0)


def wanted_or_all(places: DataFrame, group: list[str], hit: Column) -> DataFrame:
    """The rows that are hits; of groups without any, all rows."""
    found = places.withColumn("__hit", hit)
    some = found.where("__hit").select(*group).distinct().withColumn("__some", F.lit(True))
    return found.join(some, group, "left").where(F.col("__hit") | F.col("__some").isNull()).drop("__hit", "__some")
