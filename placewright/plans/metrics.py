"""Queries over the event tables: intake, counters, gauges, rates, alerts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.functions import scalars as S
from placewright.operators import events as E
from placewright.sources.tables import table

QUERIES, SQL = {}, {}
#: One row per message.
MS = "ms as (select * from (select *, row_number() over (partition by topic, partition_id, offset_value order by id) rn from analytics_kafka_events) where rn = 1)"


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def raw(spark, d):
    return table(spark, d, "analytics_kafka_events")


def messages(spark, d, *columns):
    """One row per message, of the wanted columns."""
    return E.deduplicated(raw(spark, d).select("id", *E.KEY, *columns))


@query("event_dedup", f"with {MS} select topic, partition_id, offset_value, id, city from ms")
def event_dedup(spark, d):
    return messages(spark, d, "city").select(*E.KEY, "id", "city")


#: When the target was last read: what was consumed before is known, what came later is new.
LAST_READ = "2025-01-16 00:00:00"


@query("event_new_only", f"select distinct topic, partition_id, offset_value from analytics_kafka_events e where consumed_at >= timestamptz '{LAST_READ}+00' and not exists (select 1 from analytics_kafka_events k where k.consumed_at < timestamptz '{LAST_READ}+00' and k.topic = e.topic and k.partition_id = e.partition_id and k.offset_value = e.offset_value)")
def event_new_only(spark, d):
    late = F.col("consumed_at") >= F.lit(f"{LAST_READ}+00:00").cast("timestamp")
    rows = raw(spark, d).where("consumed_at is not null")
    return E.new_only(rows.where(late).select(*E.KEY), rows.where(~late))


@query("dead_letter_split", "select topic, count(*) filter (where payload is not null and json_valid(payload) and ltrim(payload)[1] = '{') as good, count(*) filter (where payload is null or not json_valid(payload) or ltrim(payload)[1] <> '{') as dead from analytics_kafka_events group by topic")
def dead_letter_split(spark, d):
    good, dead = E.split_payloads(raw(spark, d), "payload")
    both = good.select("topic", F.lit(1).alias("g")).unionByName(dead.select("topic", F.lit(0).alias("g")))
    return both.groupBy("topic").agg(F.sum("g").alias("good"), F.sum(1 - F.col("g")).alias("dead"))


GOOD = "json_valid(payload) and ltrim(payload)[1] = '{'"


@query("json_parse_try", f"select id, case when {GOOD} then coalesce(json_extract_string(payload, '$.city'), '') else '' end as city from analytics_kafka_events")
def json_parse_try(spark, d):
    """The city of every payload; an unreadable one has an empty city."""
    good, dead = E.split_payloads(raw(spark, d), "payload")
    city = F.coalesce(F.get_json_object("payload", "$.city"), F.lit(""))
    return good.select("id", city.alias("city")).unionByName(dead.select("id", F.lit("").alias("city")))


FLAT = {"category_match_rate": "quality_metrics.category_match_rate", "avg_distance_km": "quality_metrics.avg_distance_km", "temperature_2m": "weather.temperature_2m", "rain": "weather.rain", "wind_speed_10m": "weather.wind_speed_10m"}
FLAT_SQL = ", ".join(f"cast(json_extract(payload, '$.{path}') as double) as {name}" for name, path in FLAT.items())


@query("event_flatten", f"select id, event_type, event_time, lower(json_extract_string(payload, '$.city')) as city, cast(json_extract(payload, '$.selected_place_count') as integer) as selected_place_count, {FLAT_SQL} from analytics_kafka_events where {GOOD} and event_time is not null")
def event_flatten(spark, d):
    """Messages, put into their envelopes and flattened again."""
    good, _ = E.split_payloads(raw(spark, d).where("event_time is not null").select("id", "event_type", "event_time", "payload"), "payload")
    at = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    value = F.concat(F.lit('{"event_type": '), F.to_json(F.array("event_type")).substr(F.lit(2), F.length(F.to_json(F.array("event_type"))) - 2), F.lit(', "event_time": "'), at, F.lit('", "payload": '), F.col("payload"), F.lit("}"))
    flat = E.flatten(good.select("id", value.alias("value")), "value")
    return flat.select("id", "event_type", "event_time", "city", "selected_place_count", *FLAT)


@query("event_time", "select event_id, epoch_us(ts) as micros, epoch_us(ts) // 1000000 as seconds from events")
def event_time(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+00:00").otherwise(""))
    at = S.event_instant(text)
    return table(spark, d, "events").select("event_id", F.unix_micros(at).alias("micros"), F.unix_seconds(at).alias("seconds"))


@query("event_envelope", f"with {MS} select lower(city) as key, '{{\"event_type\":' || to_json(event_type) || ',\"event_time\":\"' || strftime(event_time, '%Y-%m-%dT%H:%M:%SZ') || '\",\"payload\":{{' || concat_ws(',', '\"city\":' || to_json(city), '\"categories\":' || to_json(categories), '\"selected_place_count\":' || selected_place_count) || '}}}}' as value from ms where event_type is not null and event_time is not null")
def event_envelope(spark, d):
    body = F.struct("city", "categories", "selected_place_count")
    rows = messages(spark, d, "event_type", "event_time", "city", "categories", "selected_place_count").where("event_type is not null and event_time is not null")
    return rows.select(F.lower("city").alias("key"), E.envelope(F.col("event_type"), F.col("event_time"), body).alias("value"))


@query("metric_counters", f"with {MS} select topic, event_type, city, count(*) as n, cast(coalesce(sum(selected_place_count), 0) as bigint) as selected from ms group by topic, event_type, city")
def metric_counters(spark, d):
    rows = messages(spark, d, "event_type", "city", "selected_place_count")
    return rows.groupBy("topic", "event_type", "city").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("selected_place_count"), F.lit(0)).alias("selected"))


@query("metric_exposition", f"with {MS}, c as (select topic, city, count(*) n from ms group by topic, city) select 'consumed_events_total{{topic=\"' || topic || '\",city=\"' || coalesce(city, '') || '\"}} ' || n as line from c")
def metric_exposition(spark, d):
    """The consumed messages by topic and city as lines for a metric collector."""
    counts = messages(spark, d, "city").groupBy("topic", "city").agg(F.count(F.lit(1)).alias("n"))
    return E.exposition(counts, "consumed_events_total", ["topic", "city"], "n")


@query("metric_gauges", f"with {MS} select city, max_by(temperature_2m, {{t: event_time, i: id}}) as temperature_2m from ms where temperature_2m is not null and city is not null and event_time is not null group by city")
def metric_gauges(spark, d):
    rows = messages(spark, d, "city", "event_time", "temperature_2m").where("city is not null and event_time is not null")
    return E.last_values(rows, ["city"], "temperature_2m", "event_time", "id")


@query("gauge_avg", f"with {MS}, g as (select city, max_by(category_match_rate, {{t: event_time, i: id}}) v from ms where category_match_rate is not null and city is not null and event_time is not null group by city) select round(avg(v) + 1e-9, 6) as avg_match_rate, count(*) as cities from g")
def gauge_avg(spark, d):
    rows = messages(spark, d, "city", "event_time", "category_match_rate").where("city is not null and event_time is not null")
    g = E.last_values(rows, ["city"], "category_match_rate", "event_time", "id")
    return g.agg(F.round(F.avg("category_match_rate") + 1e-9, 6).alias("avg_match_rate"), F.count(F.lit(1)).alias("cities"))


@query("rate_by_window", "select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(count(*) / 86400e0, 9) as per_second from events group by 1, 2")
def rate_by_window(spark, d):
    return E.rates(table(spark, d, "events"), "ts", "1 day", 86400, ["event_type"])


#: A counter per type, sampled every hour; its process begins anew every tenth hour. It is asked for every six hours.
SAMPLES = "hr as (select event_type, epoch_us(date_trunc('hour', ts)) // 1000000 t, count(*) n from events group by 1, 2), sm as (select event_type, t, sum(n) over (partition by event_type, t // 36000 order by t) v from hr), st as (select distinct t - t % 21600 as step from sm)"


def _samples(spark, d):
    hour = F.unix_seconds(F.date_trunc("hour", "ts").cast("timestamp"))
    hourly = table(spark, d, "events").groupBy("event_type", hour.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    since = F.sum("n").over(Window.partitionBy("event_type", F.floor(F.col("t") / 36000)).orderBy("t"))
    return hourly.select("event_type", "t", since.alias("v"))


@query("counter_increase", f"with {SAMPLES}, g as (select event_type, t, case when lag(v) over w is null then 0 when v < lag(v) over w then v else v - lag(v) over w end gain from sm window w as (partition by event_type order by t)) select event_type, step, cast(sum(gain) as bigint) as increase, round(sum(gain) / 86400e0, 9) as per_second from g join st on t > step - 86400 and t <= step group by event_type, step")
def counter_increase(spark, d):
    """Increase and rate of counters over the day before each step, whatever their resets."""
    samples = _samples(spark, d)
    steps = samples.select((F.col("t") - F.col("t") % 21600).alias("step")).distinct()
    return E.increases(samples, ["event_type"], "t", "v", steps, "step", 86400).withColumn("per_second", F.round("per_second", 9))


@query("ratio_of_sums", "select event_type, round(sum(value) / count(*) + 1e-9, 6) as mean_value from events group by event_type")
def ratio_of_sums(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.count(F.lit(1)) + 1e-9, 6).alias("mean_value"))


@query("metric_topk", f"with {MS} select city, count(*) as n from ms where city is not null group by city order by n desc, city limit 10")
def metric_topk(spark, d):
    return messages(spark, d, "city").where("city is not null").groupBy("city").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "city").limit(10)


BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0]
HISTOGRAM = f"le(le) as (values {', '.join(f'({b}e0)' for b in BOUNDS)}, (cast('inf' as double))), hb as (select event_type, le, count(*) filter (where value <= le) n from events cross join le where value is not null group by event_type, le)"


@query("latency_histogram", f"with {HISTOGRAM} select event_type, cast(le as varchar) as le, n from hb where n > 0")
def latency_histogram(spark, d):
    """Cumulative buckets: how many values are at most each bound."""
    found = E.cumulative_buckets(table(spark, d, "events"), ["event_type"], F.col("value"), BOUNDS)
    return found.select("event_type", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"), "n")


@query("latency_p95", f"with {HISTOGRAM}, r as (select *, max(n) over (partition by event_type) * 0.95e0 k, lag(n, 1, 0) over w pn, lag(le, 1, 0e0) over w ple, row_number() over w i from hb where n > 0 window w as (partition by event_type order by le)), h as (select * from r where n >= k qualify row_number() over (partition by event_type order by le) = 1), z as (select h.*, coalesce((select max(b.le) from le b where b.le < h.le), 0e0) lower from h) select event_type, round(case when isinf(le) then lower else lower + (le - lower) * (k - pn) / (n - pn) end + 1e-9, 4) as p95 from z")
def latency_p95(spark, d):
    buckets = E.cumulative_buckets(table(spark, d, "events"), ["event_type"], F.col("value"), BOUNDS)
    return E.histogram_quantile(buckets, ["event_type"], 0.95).select("event_type", F.round(F.col("quantile") + 1e-9, 4).alias("p95"))


@query("error_ratio", "select date_trunc('day', ts) as day, round(count(*) filter (where regexp_matches(event_type, '^err')) / greatest(count(*) * 1e0, 0.001e0) + 1e-9, 6) as ratio from events group by 1 having count(*) filter (where regexp_matches(event_type, '^err')) / greatest(count(*) * 1e0, 0.001e0) > 0.05e0")
def error_ratio(spark, d):
    ratio = F.count_if(F.col("event_type").rlike("^err")) / F.greatest(F.count(F.lit(1)).cast("double"), F.lit(0.001))
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(ratio.alias("r")).where("r > 0.05").select("day", F.round(F.col("r") + 1e-9, 6).alias("ratio"))


@query("event_recency", "select event_type, max(ts) as last_ts, date_diff('second', max(ts), timestamp '2024-02-01 00:00:00') as age_seconds from events group by event_type")
def event_recency(spark, d):
    last = F.max("ts")
    age = F.unix_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.date_trunc("second", F.col("last_ts")).cast("timestamp"))
    return table(spark, d, "events").groupBy("event_type").agg(last.alias("last_ts")).select("event_type", "last_ts", age.alias("age_seconds"))


PUBLISHED = "pw as (select topic, time_bucket(interval 15 minute, event_time) w, count(*) n from analytics_kafka_events where event_time is not null group by 1, 2), cw as (select topic, time_bucket(interval 15 minute, consumed_at) w, count(*) n from analytics_kafka_events where consumed_at is not null group by 1, 2)"


@query("alert_stale", f"with {PUBLISHED} select topic, epoch_us(w) // 1000000 as window_start, n as published from pw where not exists (select 1 from cw where cw.topic = pw.topic and cw.w = pw.w)")
def alert_stale(spark, d):
    """Quarters of an hour in which messages of a topic were published and none was consumed."""
    rows = raw(spark, d)
    count = lambda c, name: rows.where(F.col(c).isNotNull()).groupBy("topic", F.window(c, "15 minutes").start.alias("w")).agg(F.count(F.lit(1)).alias(name))
    both = count("event_time", "published").join(count("consumed_at", "consumed"), ["topic", "w"], "left")
    return both.where("published > 0 and coalesce(consumed, 0) = 0").select("topic", F.unix_seconds("w").alias("window_start"), "published")


DAILY = "dl as (select event_type, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as d, avg(value) v from events group by 1, 2)"


def daily(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    return table(spark, d, "events").groupBy("event_type", day.alias("day")).agg(F.avg("value").alias("v"))


@query("alert_threshold", f"with {DAILY}, b as (select *, d - row_number() over (partition by event_type order by d) g from dl where v > 20) select event_type, min(d) as first_step, max(d) as last_step, count(*) as steps from b group by event_type, g having count(*) >= 2")
def alert_threshold(spark, d):
    return E.held(daily(spark, d), ["event_type"], "day", F.col("v") > 20, 2)


AL = "al as (select user_id, event_type, case when max(value) > 90 then 'critical' else 'warning' end severity from events where value > 60 group by user_id, event_type)"


@query("alert_inhibit", f"with {AL} select * from al where severity = 'critical' union all select * from al where severity <> 'critical' and user_id not in (select user_id from al where severity = 'critical')")
def alert_inhibit(spark, d):
    alerts = table(spark, d, "events").where("value > 60").groupBy("user_id", "event_type").agg(F.when(F.max("value") > 90, "critical").otherwise("warning").alias("severity"))
    return E.inhibited(alerts, "user_id", "severity")
