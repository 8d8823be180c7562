"""Queries of day plans and of the inline sample relation."""

from pyspark.sql import functions as F

from placewright.functions import scalars as S
from placewright.operators import places as P, planner
from placewright.plans.base import OK, PC, PL, avg_to, joined, named_links, places, usable
from placewright.plans.platform import OUTDOOR, SAMPLE_SQL, TX, sample
from placewright.sources.tables import table

QUERIES, SQL = {}, {}
CENTERS = [(44.0, 3.0), (44.8, 5.5), (45.6, 7.0)]
#: Sums of distances are compared in whole metres, with the same nudge on both sides.


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def candidates(spark, d):
    """Usable places with a city in lower case."""
    return places(spark, d).where(usable() & F.col("name").isNotNull() & S.non_blank(F.col("city"))).select("id", "name", F.lower(F.btrim("city")).alias("city"), "lat", "lon")


CA = f"{PL}, ca as (select id, name, lower(trim(city, ' ')) city, lat, lon from pl where {OK} and name is not null and trim(city, ' ') <> '')"
D2 = [f"(pow(lat - {a}e0, 2) + pow(lon - ({o}e0), 2))" for a, o in CENTERS]
ND = f"{CA}, nd as (select *, least({', '.join(D2)}) d2, case least({', '.join(D2)}) when {D2[0]} then 1 when {D2[1]} then 2 else 3 end as day from ca)"
TK = f"{ND}, tk as (select * from (select *, row_number() over (partition by city, day order by d2, name, id) rank from nd) where rank <= 4)"
KM = "12742e0 * asin(sqrt(least(1e0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def stops(spark, d):
    near = planner.nearest_center(candidates(spark, d), CENTERS)
    return P.top_per_group(near, ["city", "day"], [F.col("d2"), F.col("name"), F.col("id")], 4)


@query("haversine", f"with {CA} select id, cast(floor({KM.format(a='', b='').replace('lat - lat', '45e0 - lat').replace('cos(radians(lat)) * cos(radians(lat))', 'cos(radians(lat)) * cos(radians(45e0))').replace('lon - lon', '5e0 - lon')} * 10 + 1e-6) as bigint) as hundred_metres from ca")
def haversine(spark, d):
    km = S.haversine_km(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(5.0))
    return candidates(spark, d).select("id", F.floor(km * 10 + 1e-6).cast("bigint").alias("hundred_metres"))


@query("nearest_center", f"with {ND} select id, day, round(d2 + 1e-9, 6) as d2 from nd")
def nearest_center(spark, d):
    return planner.nearest_center(candidates(spark, d), CENTERS).select("id", "day", F.round(F.col("d2") + 1e-9, 6).alias("d2"))


@query("topk_per_day", f"with {TK} select city, day, cast(rank as integer) as rank, id, name from tk")
def topk_per_day(spark, d):
    return stops(spark, d).select("city", "day", "rank", "id", "name")


@query("schedule_slots", f"with {TK} select city, day, id, strftime(timestamp '2024-01-01 09:00:00' + (rank - 1) * interval 150 minute, '%H:%M') as starts, strftime(timestamp '2024-01-01 11:00:00' + (rank - 1) * interval 150 minute, '%H:%M') as ends from tk")
def schedule_slots(spark, d):
    start, end = planner.schedule(F.col("rank"))
    return stops(spark, d).select("city", "day", "id", start.alias("starts"), end.alias("ends"))


LG = f"{TK}, lg as (select *, lag(lat) over w plat, lag(lon) over w plon from tk window w as (partition by city, day order by rank)), km as (select *, {KM.format(a='p', b='')} km from lg)"


@query("leg_distance", f"with {LG} select city, cast(floor(coalesce(avg(km), 0) * 1000 + 1e-3) as bigint) as avg_leg_m, count(km) as legs from km group by city")
def leg_distance(spark, d):
    found = planner.legs(stops(spark, d), ["city", "day"], "rank")
    return found.groupBy("city").agg(F.floor(F.coalesce(F.avg("leg_km"), F.lit(0.0)) * 1000 + 1e-3).cast("bigint").alias("avg_leg_m"), F.count("leg_km").alias("legs"))


WANTED = ["museum", "Beach"]


@query("interest_filter", f"with {PL}, {PC} select id, count(*) filter (where lower(category) in ('museum', 'beach')) as matches from pl join pc on pc.place_id = pl.id group by id having count(*) filter (where lower(category) in ('museum', 'beach')) > 0")
def interest_filter(spark, d):
    full = P.with_categories(places(spark, d), named_links(spark, d))
    return full.select("id", S.match_count(F.col("categories"), WANTED).cast("bigint").alias("matches")).where("matches > 0")


@query("match_rate", f"with {PL}, {PC}, m as (select id, bool_or(coalesce(lower(category) in ('museum', 'beach'), false)) hit, any_value(city) city from pl left join pc on pc.place_id = pl.id group by id) select city, round(avg(case when hit then 1e0 else 0e0 end) + 1e-9, 6) as match_rate from m where city is not null group by city")
def match_rate(spark, d):
    full = P.with_categories(places(spark, d), named_links(spark, d)).where("city is not null")
    return full.groupBy("city").agg(avg_to((S.match_count(F.col("categories"), WANTED) > 0).cast("double"), 6).alias("match_rate"))


WEATHER = {"rain": "rain", "wind": "wind_speed_10m", "precipitation": "cast(case when json_valid(payload) then json_extract(payload, '$.weather.precipitation') end as double)", "code": "cast(case when json_valid(payload) then json_extract(payload, '$.weather.weather_code') end as double)"}
LATEST = ", ".join(f"max_by({c}, {{t: event_time, i: id}}) filter (where {c} is not null) {n}" for n, c in WEATHER.items())


@query("weather_suitability", f"with {TX}, o as (select lower(city) city, avg(case when regexp_matches(lower(t), '{OUTDOOR}') then 1e0 else 0e0 end) outdoor from tx where city is not null group by lower(city)), w as (select city, {LATEST} from analytics_kafka_events where city is not null group by city) select o.city, round(case when coalesce(rain, 0) > 0 or coalesce(precipitation, 0) > 0 or coalesce(code, 0) >= 51 or coalesce(wind, 0) >= 40 then greatest(0e0, 1 - outdoor) else 1e0 end + 1e-9, 6) as suitability from o left join w on w.city = o.city")
def weather_suitability(spark, d):
    full = P.with_categories(places(spark, d), named_links(spark, d)).where("city is not null")
    outdoor = full.groupBy(F.lower("city").alias("city")).agg(F.avg(F.lower(F.array_join("categories", " ")).rlike(OUTDOOR).cast("double")).alias("outdoor"))
    told = lambda v: S.try_number(F.get_json_object("payload", f"$.weather.{v}"))
    events = table(spark, d, "analytics_kafka_events").where("city is not null").withColumns({"precipitation": told("precipitation"), "code": told("weather_code"), "wind": F.col("wind_speed_10m")})
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("event_time", "id"))).alias(c)
    weather = events.groupBy("city").agg(*(latest(c) for c in WEATHER))
    suits = planner.weather_suits(F.col("outdoor"), F.col("rain"), F.col("precipitation"), F.col("code"), F.col("wind"))
    return outdoor.join(weather, "city", "left").select("city", F.round(suits + 1e-9, 6).alias("suitability"))


@query("quality_metrics", f"with {LG}, {PC}, m as (select tk.id, bool_or(coalesce(lower(category) in ('museum', 'beach'), false)) hit, count(distinct category) n from tk left join pc on pc.place_id = tk.id group by tk.id) select (select round(avg(case when hit then 1e0 else 0e0 end) + 1e-9, 6) from m) as match_rate, (select cast(floor(avg(km) * 1000 + 1e-3) as bigint) from km) as avg_leg_m, (select round(avg(n) + 1e-9, 6) from m) as avg_categories")
def quality_metrics(spark, d):
    day = planner.legs(stops(spark, d), ["city", "day"], "rank")
    full = P.with_categories(day.select("id", "leg_km"), named_links(spark, d))
    return full.agg(avg_to((S.match_count(F.col("categories"), WANTED) > 0).cast("double"), 6).alias("match_rate"), F.floor(F.avg("leg_km") * 1000 + 1e-3).cast("bigint").alias("avg_leg_m"), avg_to(F.size("categories"), 6).alias("avg_categories"))


@query("cluster_itinerary", "with r as (select *, row_number() over (partition by lower(city) order by total_score desc, poi_count desc, h3_index) as d from gold_clusters where city is not null and trim(city, ' ') <> '') select lower(city) as city, cast(d as integer) as \"day\", h3_index, total_score from r where d <= 3")
def cluster_itinerary(spark, d):
    rows = table(spark, d, "gold_clusters").where(S.non_blank(F.col("city"))).withColumn("city", F.lower("city"))
    return P.top_per_group(rows, ["city"], [F.desc("total_score"), F.desc("poi_count"), F.col("h3_index")], 3, "day").select("city", "day", "h3_index", "total_score")


IT = f"{TK}, {PC}, a as (select place_id, array_to_string(list_sort(list(distinct category)), '|') c from pc group by place_id)"


@query("itinerary_enriched", f"with {IT} select city, day, cast(rank as integer) as rank, tk.id, coalesce(c, '') as categories from tk left join a on a.place_id = tk.id")
def itinerary_enriched(spark, d):
    return P.with_categories(stops(spark, d), named_links(spark, d)).select("city", "day", "rank", "id", joined("categories").alias("categories"))


@query("itinerary_fixed_days", f"with {IT} select city, day, array_to_string(list(name || ' ' || strftime(timestamp '2024-01-01 09:00:00' + (rank - 1) * interval 150 minute, '%H:%M') || ' ' || coalesce(nullif(split_part(c, '|', 1), ''), 'Tourism') order by rank), ' / ') as plan from tk left join a on a.place_id = tk.id group by city, day")
def itinerary_fixed_days(spark, d):
    full = P.with_categories(stops(spark, d), named_links(spark, d))
    start, _ = planner.schedule(F.col("rank"))
    text = F.concat_ws(" ", "name", start, F.coalesce(F.get("categories", F.lit(0)), F.lit("Tourism")))
    # at most four stops a day
    return full.groupBy("city", "day").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("x")).select("city", "day", F.array_join(F.col("x.t"), " / ").alias("plan"))


@query("kmeans_days")
def kmeans_days(spark, d):
    return planner.kmeans_days(candidates(spark, d).where("city = 'mailoconair'"), 3).select("id", "day")


@query("kmeans_per_city")
def kmeans_per_city(spark, d):
    return planner.kmeans_per_group(candidates(spark, d), "city", 3)


@query("itinerary")
def itinerary(spark, d):
    day = planner.kmeans_days(candidates(spark, d).where("city = 'mailoconair'"), 3)
    top = P.top_per_group(day, ["day"], [F.col("d2"), F.col("name"), F.col("id")], 4)
    start, end = planner.schedule(F.col("rank"))
    full = P.with_categories(planner.legs(top, ["day"], "rank"), named_links(spark, d)).withColumn("s", start).withColumn("e", end)
    stop = F.struct("rank", "id", "name", F.col("s").alias("starts"), F.col("e").alias("ends"), "leg_km", "categories")
    return full.groupBy("day").agg(F.to_json(F.array_sort(F.collect_list(stop))).alias("stops"))


# --- sample relation ---------------------------------------------------------------------------


@query("demo_places", f"with {SAMPLE_SQL} select id, name from sample where city = 'Valbourg' and list_has_any(categories, ['Heritage', 'Garden'])")
def demo_places(spark, d):
    wanted = F.array(F.lit("Heritage"), F.lit("Garden"))
    return sample(spark).where((F.col("city") == "Valbourg") & F.arrays_overlap("categories", wanted)).select("id", "name")


@query("demo_summary", f"with {SAMPLE_SQL} select count(*) as places, count(distinct city) as cities, (select count(distinct c) from (select unnest(categories) c from sample)) as categories from sample")
def demo_summary(spark, d):
    one = sample(spark).select("id", "city", F.explode("categories").alias("c"))
    return one.agg(F.countDistinct("id").alias("places"), F.countDistinct("city").alias("cities"), F.countDistinct("c").alias("categories"))


@query("demo_categories", f"with {SAMPLE_SQL} select distinct unnest(categories) as category from sample")
def demo_categories(spark, d):
    return sample(spark).select(F.explode("categories").alias("category")).distinct()


@query("demo_related", f"with {SAMPLE_SQL}, r as (select a.id, b.id other, row_number() over (partition by a.id order by b.id) r from sample a join sample b on b.city = a.city and b.id <> a.id) select id, other from r where r <= 2")
def demo_related(spark, d):
    a, b = sample(spark).select("id", "city"), sample(spark).select(F.col("id").alias("other"), "city")
    return P.top_per_group(a.join(b, "city").where("id <> other"), ["id"], [F.col("other")], 2).select("id", "other")


@query("round_robin_days", f"with {CA}, r as (select *, row_number() over (partition by city order by name, id) - 1 r from ca) select city, id, cast(r % 3 + 1 as integer) as day, cast(r // 3 + 1 as integer) as stop from r where r < 12")
def round_robin_days(spark, d):
    return planner.round_robin(candidates(spark, d), ["city"], [F.col("name"), F.col("id")], 3, 4).select("city", "id", F.col("day").cast("int").alias("day"), "stop")


FOUND = "list_has_any(categories, ['Market', 'Garden'])"


@query("demo_itinerary", f"with {SAMPLE_SQL}, f as (select *, {FOUND} hit, bool_or({FOUND}) over (partition by city) any_hit from sample), r as (select *, row_number() over (partition by city order by id) - 1 r from f where hit or not any_hit) select city, cast(r % 2 + 1 as integer) as day, cast(r // 2 + 1 as integer) as stop, id from r where r < 6")
def demo_itinerary(spark, d):
    """Days of the sample's cities by interest; a city without a match is planned with all its places."""
    hit = F.arrays_overlap("categories", F.array(F.lit("Market"), F.lit("Garden")))
    found = planner.wanted_or_all(sample(spark), ["city"], hit)
    return planner.round_robin(found, ["city"], [F.col("id")], 2, 3).select("city", F.col("day").cast("int").alias("day"), "stop", "id")
