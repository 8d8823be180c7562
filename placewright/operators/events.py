"""Event tables: idempotent intake, flattening, counters, gauges, rates and alerts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.functions.scalars import event_instant, try_number

KEY = ["topic", "partition_id", "offset_value"]


def deduplicated(events: DataFrame, key: list[str] | None = None, order: str = "id") -> DataFrame:
    """One row per message: the first by ``order``. A partial aggregate runs before the shuffle."""
    key = key or KEY
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__x")).select(*key, "__x.*").select(events.columns)


def new_only(events: DataFrame, known: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Messages that the target doesn't hold yet, each once."""
    key = key or KEY
    return events.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def split_payloads(raw: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is a JSON object, and the dead letters."""
    # a position in the text tells an object from other JSON; the parse tells JSON from the rest
    good = F.coalesce(F.try_parse_json(F.col(value)).isNotNull() & F.col(value).rlike(r"^\s*\{"), F.lit(False))
    return raw.where(good), raw.where(~good)


def flatten(raw: DataFrame, value: str) -> DataFrame:
    """Columns of the analytics table from enveloped messages: type, time, city, counts, metrics."""
    at = lambda p: F.get_json_object(value, f"$.{p}")
    number = lambda p: try_number(at(p))
    metrics = ("category_match_rate", "avg_distance_km", "avg_recommendations", "weather_suitability_score")
    weather = ("temperature_2m", "rain", "wind_speed_10m")
    return raw.select(
        "*",
        F.coalesce(at("event_type"), F.lit("unknown")).alias("event_type"),
        event_instant(at("event_time")).alias("event_time"),
        F.lower(at("payload.city")).alias("city"),
        at("payload.categories").alias("categories"),
        number("payload.selected_place_count").cast("int").alias("selected_place_count"),
        *(number(f"payload.quality_metrics.{m}").alias(m) for m in metrics),
        *(number(f"payload.weather.{m}").alias(m) for m in weather),
    )


def envelope(event_type: Column, event_time: Column, payload: Column) -> Column:
    """The JSON text of a message."""
    return F.to_json(F.struct(event_type.alias("event_type"), F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("event_time"), payload.alias("payload")))


def last_values(events: DataFrame, by: list[str], value: str, time: str, tie: str) -> DataFrame:
    """The latest value that isn't null, per label."""
    return events.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def rates(events: DataFrame, time: str, width: str, seconds: int, by: list[str]) -> DataFrame:
    """``window_start``, labels, ``n`` and ``per_second`` in tumbling windows."""
    n = events.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("window_start"), *by, "n", F.round(F.col("n") / seconds, 9).alias("per_second"))


def increases(samples: DataFrame, by: list[str], time: str, value: str, steps: DataFrame, step: str, seconds: int) -> DataFrame:
    """Labels, ``step``, ``increase``, ``per_second`` of counters in the range of ``seconds`` before each step (sliding windows, open at their begin).

    ``time`` and ``step`` are whole seconds. A sample below the one before it is a counter that began anew, and counts whole. A
    sample's gain is added to every step whose range holds it; nothing is extrapolated to the ends of the range.
    """
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(time))
    gain = F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    gains = samples.select(*by, F.col(time).alias("__t"), gain.alias("__gain"))
    # steps meet the gains of their range by the blocks of that length that the range touches
    block = lambda c: F.floor(c / seconds)
    ranges = steps.select(F.col(step).alias("__step"), F.explode(F.sequence(block(F.col(step) - seconds), block(F.col(step)))).alias("__b"))
    met = gains.withColumn("__b", block(F.col("__t"))).join(ranges, "__b").where((F.col("__t") > F.col("__step") - seconds) & (F.col("__t") <= F.col("__step")))
    total = met.groupBy(*by, F.col("__step").alias(step)).agg(F.sum("__gain").alias("increase"))
    return total.withColumn("per_second", F.col("increase") / F.lit(seconds))


def cumulative_buckets(events: DataFrame, by: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """Labels, ``le``, ``n``: how many values are at most each bound (the last is infinity), as a histogram exposes them."""
    levels = [*bounds, float("inf")]
    at = F.array_min(F.filter(F.array(*(F.lit(float(b)) for b in levels)), lambda b: value <= b))
    counts = events.where(value.isNotNull()).groupBy(*by, at.alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    # one row per label and bound
    each = counts.select(*by, "__n", F.explode(F.filter(F.array(*(F.lit(float(b)) for b in levels)), lambda b: b >= F.col("__at"))).alias("le"))
    return each.groupBy(*by, "le").agg(F.sum("__n").alias("n"))


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Labels, ``quantile`` of cumulative buckets (``le``, ``n``): linear inside the bucket that holds the rank.

    The first bucket begins at 0; a rank in the last one gives the last finite bound.
    """
    told = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", F.col("n").cast("double").alias("n")))).alias("__b"))  # as many as there are bounds
    b = F.col("__b")
    rank = F.element_at(b, -1)["n"] * q
    at = F.array_position(F.transform(b, lambda x: x["n"] >= rank), True).cast("int")
    here = F.element_at(b, at)
    below = F.when(at > 1, F.get(b, at - 2)).otherwise(F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n")))
    inside = below["le"] + (here["le"] - below["le"]) * (rank - below["n"]) / (here["n"] - below["n"])
    return told.where(F.element_at(b, -1)["n"] > 0).select(*by, F.when(here["le"] == float("inf"), below["le"]).when(here["n"] == below["n"], here["le"]).otherwise(inside).alias("quantile"))


def held(series: DataFrame, by: list[str], step: str, breach: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive steps in breach (gaps and islands): labels, ``first_step``, ``last_step``, ``steps``."""
    w = Window.partitionBy(*by).orderBy(step)
    bad = series.where(breach).withColumn("__g", F.col(step) - F.row_number().over(w))
    return bad.groupBy(*by, "__g").agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count(F.lit(1)).alias("steps")).where(F.col("steps") >= least).drop("__g")


def inhibited(alerts: DataFrame, service: str, severity: str) -> DataFrame:
    """Alerts without the warnings of services that have a critical one."""
    critical = alerts.where(F.col(severity) == "critical").select(service).distinct()
    return alerts.where(F.col(severity) == "critical").unionByName(alerts.where(F.col(severity) != "critical").join(critical, service, "left_anti").select(alerts.columns))


def exposition(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """``line``: samples in the text format that metric collectors read; a null label is empty, and special characters are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    told = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), safe(c), F.lit('"')) for c in labels))
    return rows.select(F.concat(F.lit(f"{name}{{"), told, F.lit("} "), F.col(value).cast("string")).alias("line"))
