"""Queries over places: staging, cleaning, change capture, marts, searches, quality."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from placewright.functions import scalars as S
from placewright.functions.text import clean_text, latest
from placewright.operators import changes, places as P, quality
from placewright.plans.base import OK, PC, PL, avg_to, categories, joined, links, named_links, places, usable
from placewright.plans.cut import scratch
from placewright.sources import models
from placewright.sources.tables import path_exists, table, views

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# --- sources -----------------------------------------------------------------------------------


@query("scan_parquet", "select city, count(*) as n, count(lat) as with_lat from silver_places where country is not null group by city")
def scan_parquet(spark, d):
    return table(spark, d, "silver_places").where("country is not null").groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.count("lat").alias("with_lat"))


@query("param_query", "select id, name, city from silver_places where city = 'Mailoconair' and lat > 44e0 group by id, name, city")
def param_query(spark, d):
    return spark.sql("select id, name, city from {p} where city = :city and lat > :lat group by id, name, city", args={"city": "Mailoconair", "lat": 44.0}, p=table(spark, d, "silver_places"))


#: Invented sample relation.
SAMPLE = [
    ("m1", "Musée des Rouets", "Valbourg", ["Museum", "Heritage"], 45.01, 3.02),
    ("m2", "Halle aux Toiles", "Valbourg", ["Market"], 45.02, 3.04),
    ("m3", "Jardin des Sources", "Valbourg", ["Park", "Garden"], 45.03, 3.01),
    ("m4", "Tour du Guet", "Valbourg", ["Heritage"], 45.00, 3.05),
    ("m5", "Bains de l’Orme", "Valbourg", ["Thermal", "Park"], 45.04, 3.03),
    ("m6", "Moulin Vieux", "Sarmont", ["Heritage", "Museum"], 45.51, 3.52),
    ("m7", "Auberge du Lac", "Sarmont", ["Restaurant"], 45.53, 3.55),
]
SAMPLE_SQL = "sample(id, name, city, categories, lat, lon) as (values " + ", ".join(f"('{i}', '{n}', '{c}', {list(k)!r}, {a}e0, {o}e0)" for i, n, c, k, a, o in SAMPLE) + ")"


def sample(spark):
    return spark.createDataFrame(SAMPLE, "id string, name string, city string, categories array<string>, lat double, lon double")


@query("values_relation", f"with {SAMPLE_SQL} select id, name, city, array_to_string(categories, '|') as categories, lat, lon from sample")
def values_relation(spark, d):
    return sample(spark).withColumn("categories", joined("categories"))


# --- staging and cleaning ----------------------------------------------------------------------


@query("stg_places", "select id as place_id, name as place_name, city, region, cast(nullif(cast(lat as varchar), 'nan') as double) as lat, cast(nullif(cast(lon as varchar), 'nan') as double) as lon, updated_at from silver_places where id is not null and name is not null and lat is not null and lon is not null")
def stg_places(spark, d):
    """Renamed columns of the usable rows; what is no number (NaN) is null in the result."""
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rows = table(spark, d, "silver_places").where("id is not null and name is not null and lat is not null and lon is not null")
    return rows.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"), "city", "region", number("lat"), number("lon"), "updated_at")


@query("stg_categories", "select id as category_id, name as category_name from silver_categories where id is not null")
def stg_categories(spark, d):
    return categories(spark, d).where("id is not null").selectExpr("id as category_id", "name as category_name")


@query("stg_place_categories", "select place_id, category_id from silver_place_categories where place_id is not null and category_id is not null")
def stg_place_categories(spark, d):
    return table(spark, d, "silver_place_categories").where("place_id is not null and category_id is not null")


@query("quality_filter", f"select id, name, lat, lon from silver_places where id is not null and name is not null and {OK}")
def quality_filter(spark, d):
    return quality.valid_places(table(spark, d, "silver_places")).select("id", "name", "lat", "lon")


STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _cleaned(c):
    return f"case when {STRIP.format(c)} not in ('', 'None', 'nan') then {STRIP.format(c)} end"


@query("clean_text", f"select id, {_cleaned('city')} as city, {_cleaned('postal_code')} as postal_code from silver_places group by all")
def clean_text_q(spark, d):
    return table(spark, d, "silver_places").select("id", clean_text(F.col("city")).alias("city"), clean_text(F.col("postal_code")).alias("postal_code")).distinct()


NUM = "case when regexp_matches({0}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast({0} as double) end"


@query("try_numeric", f"with t as (select doc_id, unnest(string_split(regexp_replace(text, '[^0-9.,eE+-]+', ' ', 'g'), ' ')) w from documents) select w, count(*) as n, max({NUM.format('w')}) as number from t where w <> '' group by w")
def try_numeric(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.split(F.regexp_replace("text", "[^0-9.,eE+-]+", " "), " ")).alias("w")).where("w <> ''")
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.max(S.try_number(F.col("w"))).alias("number"))


WRITTEN = "wr as (select id, 'updated' source, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') w from silver_places union all select id, 'swapped', strftime(updated_at, '%Y-%d-%m') from silver_places union all select id, 'clock', strftime(updated_at, '%H:%M') from silver_places union all select id, 'seconds', strftime(updated_at, '%H:%M:%S') from silver_places union all select id, 'postal', postal_code from silver_places)"


def _written(spark, d):
    """Times in several writings, and postal codes, as texts."""
    forms = {"updated": "yyyy-MM-dd'T'HH:mm:ss", "swapped": "yyyy-dd-MM", "clock": "HH:mm", "seconds": "HH:mm:ss"}
    pairs = F.array(*(F.struct(F.lit(k).alias("source"), F.date_format("updated_at", f).alias("w")) for k, f in forms.items()), F.struct(F.lit("postal").alias("source"), F.col("postal_code").alias("w")))
    return table(spark, d, "silver_places").select("id", F.explode(pairs).alias("x")).select("id", "x.*").distinct()


@query("try_date", f"with {WRITTEN} select distinct id, source, w, case when regexp_matches(trim(w, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(T.*)?$') then try_cast(substr(trim(w, ' '), 1, 10) as date) end as day from wr")
def try_date(spark, d):
    return _written(spark, d).select("id", "source", "w", S.try_iso_date(F.col("w")).alias("day"))


@query("try_time", f"with {WRITTEN} select distinct id, source, w, case source when 'updated' then substr(w, 12, 8) when 'clock' then w || ':00' when 'seconds' then w end as clock from wr")
def try_time(spark, d):
    return _written(spark, d).select("id", "source", "w", S.try_clock(F.col("w")).alias("clock"))


@query("default_projection", f"with {PL} select id, coalesce(nullif(name, ''), 'Unknown POI') as name, coalesce(nullif(city, ''), 'Unknown City') as city from pl")
def default_projection(spark, d):
    return places(spark, d).select("id", S.or_default(F.col("name"), "Unknown POI").alias("name"), S.or_default(F.col("city"), "Unknown City").alias("city"))


@query("dedup_keep_last", f"with {PL} select id, name, updated_at from pl")
def dedup_keep_last(spark, d):
    return places(spark, d).select("id", "name", "updated_at")


@query("dedup_subset", "select distinct place_id, min_price, max_price, upper(currency) as currency from silver_prices")
def dedup_subset(spark, d):
    return table(spark, d, "silver_prices").withColumn("currency", F.upper("currency")).select("place_id", "min_price", "max_price", "currency").dropDuplicates(["place_id", "min_price", "max_price", "currency"])


@query("dropna_all", "select place_id, min_price, max_price, currency from silver_prices where not (min_price is null and currency is null)")
def dropna_all(spark, d):
    return table(spark, d, "silver_prices").dropna(how="all", subset=["min_price", "currency"]).select("place_id", "min_price", "max_price", "currency")


@query("price_rollup", "select place_id, currency, min(min_price) as min_price, max(coalesce(max_price, min_price)) as max_price from silver_prices where min_price is not null or max_price is not null or currency is not null group by place_id, currency")
def price_rollup(spark, d):
    return P.price_rollup(table(spark, d, "silver_prices"))


@query("content_hash", "select id, sha256(concat_ws('|', coalesce(name, ''), coalesce(address, ''), coalesce(city, ''), coalesce(website, ''))) as hash from silver_places")
def content_hash(spark, d):
    text = F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in ("name", "address", "city", "website")))
    return table(spark, d, "silver_places").select("id", F.sha2(text, 256).alias("hash"))


@query("array_distinct", "with w as (select doc_id, string_split(lower(title), ' ') l from documents where title is not null) select doc_id, array_to_string(list_filter(l, lambda x, i: not list_contains(l[1:i-1], x)), '|') as parts from w")
def array_distinct(spark, d):
    """The distinct words of a title, in the order of their first occurrence."""
    return table(spark, d, "documents").where("title is not null").select("doc_id", joined(F.array_distinct(F.split(F.lower("title"), " "))).alias("parts"))


@query("normalize_terms", "with t as (select id, list_filter(list_transform(string_split(coalesce(city, '') || ',' || upper(coalesce(city, '')) || ', ,' || coalesce(region, ''), ','), lambda x: trim(x, ' ')), lambda x: x <> '') l from silver_places group by all) select id, array_to_string(list_filter(l, lambda x, i: not list_contains(list_transform(l[1:i-1], lambda y: lower(y)), lower(x))), '|') as terms from t")
def normalize_terms(spark, d):
    city, region = F.coalesce("city", F.lit("")), F.coalesce("region", F.lit(""))
    raw = F.split(F.concat(city, F.lit(","), F.upper(city), F.lit(", ,"), region), ",")
    return table(spark, d, "silver_places").select("id", joined(S.normalized_terms(raw)).alias("terms"), "city", "region").distinct().select("id", "terms")


@query("split_list", "select distinct id, array_to_string(list_filter(list_transform(string_split(address, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') as parts from silver_places where address is not null")
def split_list(spark, d):
    return table(spark, d, "silver_places").where("address is not null").select("id", joined(S.split_terms(F.col("address"))).alias("parts")).distinct()


# --- change capture ----------------------------------------------------------------------------

BR = "cur as (select snapshot_no s, id, lower(content_hash) h from (select *, row_number() over (partition by snapshot_no, id order by ingested_at desc nulls last, content_hash desc nulls last) rn from bronze_raw_poi where id is not null) where rn = 1), st as (select n.s, n.id, n.h, case when o.id is null then 'inserted' when o.h is not distinct from n.h then 'unchanged' else 'updated' end status from cur n left join cur o on o.id = n.id and o.s = n.s - 1 where n.s > 1)"
#: The merged state: what each delivery brought is compared with the last row of the same id before it.
MG = f"{BR}, lg as (select *, lag(s) over w ps, lag(h) over w ph from cur window w as (partition by id order by s))"


def _deliveries(spark, d):
    """``s``, ``id``, ``h``: the row that counts for each id of each delivery."""
    cur = table(spark, d, "bronze_raw_poi").where("id is not null").select("snapshot_no", "id", "content_hash", "ingested_at")
    cur = latest(cur, ["snapshot_no", "id"], [F.desc_nulls_last("ingested_at"), F.desc_nulls_last("content_hash")])
    return cur.select(F.col("snapshot_no").alias("s"), "id", F.lower("content_hash").alias("h"))


def _before_and_after(spark, d):
    """Every delivery but the first, and under its number the one before it."""
    cur = _deliveries(spark, d)
    return cur.withColumn("s", F.col("s") + 1), cur.where("s > 1")


@query("cdc_classify", f"with {BR} select s, id, h, status from st")
def cdc_classify(spark, d):
    return changes.classify(*_before_and_after(spark, d), ["s", "id"], "h").select("s", "id", "h", "status")


@query("cdc_counts", f"with {BR} select s, count(*) as total, count(*) filter (where status = 'inserted') as inserted, count(*) filter (where status = 'updated') as updated, count(*) filter (where status = 'unchanged') as unchanged from st group by s")
def cdc_counts(spark, d):
    s = changes.classify(*_before_and_after(spark, d), ["s", "id"], "h")
    return s.groupBy("s").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == x).alias(x) for x in ("inserted", "updated", "unchanged")))


@query("cdc_merge", f"with {MG} select id, max_by(h, s) as h, max(s) filter (where ps is null or h is distinct from ph) as touched from lg group by id")
def cdc_merge(spark, d):
    """The table after all four deliveries, with the number of the delivery that last changed a row."""
    one = lambda n: _deliveries(spark, d).where(F.col("s") == n).select("id", "h", F.col("s").alias("touched"))
    state = one(1)
    for n in (2, 3, 4):
        state = changes.merge(state, one(n), "id", "h", "touched", F.lit(n))
    return state


@query("changed_rows", f"with {BR} select s, id, h from st where status <> 'unchanged'")
def changed_rows(spark, d):
    return changes.changed_only(*_before_and_after(spark, d), ["s", "id"], "h").select("s", "id", "h")


@query("upsert_anti_union", f"with {BR} select id, max_by(h, s) as h from cur group by id")
def upsert_anti_union(spark, d):
    one = lambda n: _deliveries(spark, d).where(F.col("s") == n).select("id", "h")
    state = one(1)
    for n in (2, 3, 4):
        state = changes.upsert(state, one(n), "id")
    return state


@query("replace_children", "with fresh as (select distinct place_id, 1 as category_id from silver_place_categories where category_id = 2) select place_id, category_id from silver_place_categories where place_id not in (select place_id from fresh) union select place_id, category_id from fresh")
def replace_children(spark, d):
    rows = table(spark, d, "silver_place_categories")
    fresh = rows.where("category_id = 2").select("place_id", F.lit(1).alias("category_id")).distinct()
    return changes.replace_children(rows, fresh, fresh, "place_id")


@query("delete_rejected", f"with {PL} select id, name from pl where id not in (select id from pl where not coalesce({OK}, false))")
def delete_rejected(spark, d):
    p = places(spark, d)
    rejected = p.select("id").exceptAll(quality.valid_places(p.where(F.col("name").isNotNull())).select("id").unionByName(p.where(F.col("name").isNull() & usable()).select("id")))
    return changes.without(p, rejected, "id").select("id", "name")


@query("orphan_semi", "select id, name from silver_categories c where exists (select 1 from silver_place_categories l where l.category_id = c.id)")
def orphan_semi(spark, d):
    c = categories(spark, d)
    return c.join(links(spark, d).select(F.col("category_id").alias("id")), "id", "left_semi").select("id", "name")


@query("orphan_anti", f"with {PL} select id, name from pl where not exists (select 1 from silver_place_categories l where l.place_id = pl.id)")
def orphan_anti(spark, d):
    return places(spark, d).join(links(spark, d).select(F.col("place_id").alias("id")), "id", "left_anti").select("id", "name")


@query("changed_since_sync", f"with {PL} select id, updated_at, gold_pg_synced_at from pl where gold_pg_synced_at is null or updated_at > gold_pg_synced_at")
def changed_since_sync(spark, d):
    return changes.stale(places(spark, d), "updated_at", "gold_pg_synced_at").select("id", "updated_at", "gold_pg_synced_at")


# --- joins and lists ---------------------------------------------------------------------------


@query("place_categories_agg", f"with {PL}, {PC}, a as (select place_id, array_to_string(list_sort(list(distinct category)), '|') c from pc group by place_id) select id, name, coalesce(a.c, '') as categories from pl left join a on a.place_id = pl.id")
def place_categories_agg(spark, d):
    return P.with_categories(places(spark, d), named_links(spark, d)).select("id", "name", joined("categories").alias("categories"))


@query("explode_categories", f"with {PL}, {PC} select id, category from pl join pc on pc.place_id = pl.id")
def explode_categories(spark, d):
    return P.with_categories(places(spark, d), named_links(spark, d)).select("id", F.explode("categories").alias("category"))


@query("explode_struct", "select place_id, min_price, max_price, currency, min_price * 2 as doubled from silver_prices where min_price is not null")
def explode_struct(spark, d):
    x = F.array(F.struct("min_price", "max_price", "currency", (F.col("min_price") * 2).alias("doubled")))
    return table(spark, d, "silver_prices").where("min_price is not null").select("place_id", F.explode(x).alias("x")).select("place_id", "x.*")


@query("place_snapshot", f"with {PL}, {PC}, a as (select place_id, array_to_string(list_sort(list(distinct category)), '|') c from pc group by place_id), r as (select place_id, min(min_price) lo, max(max_price) hi, max(currency) cur from silver_prices group by place_id), t as (select place_id, min(cast(published_at as date)) f, max(cast(published_at as date)) l from documents group by place_id) select id, name, city, coalesce(a.c, '') as categories, lo as min_price, hi as max_price, cur as currency, f as start_date, l as end_date from pl left join a on a.place_id = id left join r on r.place_id = id left join t on t.place_id = id")
def place_snapshot(spark, d):
    dates = table(spark, d, "documents").select("place_id", F.to_date("published_at").alias("day"))
    full = P.snapshot(places(spark, d), named_links(spark, d), table(spark, d, "silver_prices"), dates)
    return full.select("id", "name", "city", joined("categories").alias("categories"), "min_price", "max_price", "currency", "start_date", "end_date")


@query("dim_key_lookup", f"with {PC}, k as (select name, dense_rank() over (order by name) key from (select distinct name from silver_categories)) select place_id, category, cast(key as bigint) as category_key from pc join k on k.name = pc.category")
def dim_key_lookup(spark, d):
    keys = categories(spark, d).select(F.col("name").alias("category")).distinct().withColumn("category_key", F.dense_rank().over(Window.orderBy("category")).cast("bigint"))
    return named_links(spark, d).join(keys, "category").select("place_id", "category", "category_key")


@query("city_features", f"with {PL} select city, count(*) as place_count, count(distinct region) as region_count, round(avg(case when {OK} then lat end) + 1e-9, 4) as avg_lat, round(avg(case when {OK} then lon end) + 1e-9, 4) as avg_lon from pl where city is not null group by city")
def city_features(spark, d):
    lat, lon = F.when(usable(), F.col("lat")), F.when(usable(), F.col("lon"))
    return places(spark, d).where("city is not null").groupBy("city").agg(F.count(F.lit(1)).alias("place_count"), F.countDistinct("region").alias("region_count"), avg_to(lat, 4).alias("avg_lat"), avg_to(lon, 4).alias("avg_lon"))


@query("city_summary", f"with {PL} select city, count(*) as place_count, count(distinct region) as region_count, max(updated_at) as last_update from pl where city is not null and trim(city, ' ') <> '' group by city")
def city_summary(spark, d):
    return places(spark, d).where(S.non_blank(F.col("city"))).groupBy("city").agg(F.count(F.lit(1)).alias("place_count"), F.countDistinct("region").alias("region_count"), F.max("updated_at").alias("last_update"))


@query("city_category_summary", f"with {PL}, {PC} select city, category as category_name, count(distinct id) as place_count, round(avg(case when {OK} then lat end) + 1e-9, 5) as avg_lat from pl join pc on pc.place_id = pl.id where city is not null group by city, category")
def city_category_summary(spark, d):
    rows = places(spark, d).where("city is not null").join(named_links(spark, d), F.col("id") == F.col("place_id"))
    return rows.groupBy("city", F.col("category").alias("category_name")).agg(F.countDistinct("id").alias("place_count"), avg_to(F.when(usable(), F.col("lat")), 5).alias("avg_lat"))


@query("city_counts", f"with {PL} select city, count(*) as n from pl where city is not null and trim(city, ' ') <> '' group by city")
def city_counts(spark, d):
    return places(spark, d).where(S.non_blank(F.col("city"))).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


@query("city_counts_topk", f"with {PL} select city, count(*) as n from pl where city is not null and city <> '' group by city order by n desc, city limit 20")
def city_counts_topk(spark, d):
    return places(spark, d).where("city is not null and city <> ''").groupBy("city").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "city").limit(20)


@query("city_categories_topk", f"with {PL}, {PC} select category, count(*) as n from pl join pc on pc.place_id = pl.id where lower(city) = 'mailoconair' group by category order by n desc, category limit 10")
def city_categories_topk(spark, d):
    rows = places(spark, d).where(F.lower("city") == "mailoconair").join(named_links(spark, d), F.col("id") == F.col("place_id"))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(10)


@query("platform_summary", f"with {PL}, c as (select city, count(*) n from pl where city is not null and trim(city, ' ') <> '' group by city) select (select count(*) from pl) as places, (select count(*) from c) as cities, (select count(*) from c where n >= 10) as large_cities, (select count(*) from silver_categories) as categories, (select count(*) from gold_clusters) as clusters")
def platform_summary(spark, d):
    views(spark, d, "silver_categories", "gold_clusters")
    places(spark, d).createOrReplaceTempView("pl")
    return spark.sql(
        "with c as (select city, count(*) n from pl where city is not null and btrim(city) <> '' group by city) "
        "select (select count(*) from pl) as places, (select count(*) from c) as cities, (select count(*) from c where n >= 10) as large_cities, (select count(*) from silver_categories) as categories, (select count(*) from gold_clusters) as clusters"
    )


@query("city_centroid", f"with {PL} select round(avg(lat) + 1e-9, 4) as lat, round(avg(lon) + 1e-9, 4) as lon, count(*) as n from pl where lower(city) = 'vrabriziboul' and {OK}")
def city_centroid(spark, d):
    return places(spark, d).where((F.lower("city") == "vrabriziboul") & usable()).agg(avg_to(F.col("lat"), 4).alias("lat"), avg_to(F.col("lon"), 4).alias("lon"), F.count(F.lit(1)).alias("n"))


@query("places_by_city", f"with {PL}, {PC}, f as (select id, name from pl where lower(city) = 'mailoconair' order by name, id limit 50), a as (select place_id, array_to_string(list_sort(list(distinct category)), '|') c from pc group by place_id) select id, name, coalesce(c, '') as categories from f left join a on a.place_id = f.id")
def places_by_city(spark, d):
    first = P.search(places(spark, d), named_links(spark, d), "Mailoconair").select("id", "name").orderBy("name", "id").limit(50)
    return P.with_categories(first, named_links(spark, d)).select("id", "name", joined("categories").alias("categories"))


@query("places_filtered", f"with {PL}, {PC} select id, name, city from pl where lower(city) = 'jonoucitas' and exists (select 1 from pc where pc.place_id = pl.id and lower(category) in ('museum', 'restaurant', 'beach'))")
def places_filtered(spark, d):
    return P.search(places(spark, d), named_links(spark, d), "JONOUCITAS", ["Museum", "restaurant", "Beach"]).select("id", "name", "city")


@query("sorted_limit", f"with {PL} select id, name, updated_at from pl order by updated_at desc nulls last, id limit 100")
def sorted_limit(spark, d):
    return places(spark, d).select("id", "name", "updated_at").orderBy(F.desc_nulls_last("updated_at"), "id").limit(100)


@query("candidate_limit", f"with {PL}, {PC}, c as (select id from pl where city is not null order by name nulls last, id limit 500) select id from c where exists (select 1 from pc where pc.place_id = c.id and category = 'Museum')")
def candidate_limit(spark, d):
    days, most = 2, 3
    bound = min(max(days * most * 50, 500), 2000)
    first = places(spark, d).where("city is not null").orderBy(F.asc_nulls_last("name"), "id").limit(bound).select("id")
    return P.search(first, named_links(spark, d), None, ["museum"])


@query("display_projection", f"with {PL} select name, city, address, website from pl where website is not null")
def display_projection(spark, d):
    return places(spark, d).where("website is not null").select("name", "city", "address", "website")


@query("json_records", f"with {PL} select id, json_extract_string(j, '$.city') as city, cast(json_extract_string(j, '$.lat') as double) as lat from (select id, to_json({{city: city, lat: case when isnan(lat) then null else lat end}}) j from pl)")
def json_records(spark, d):
    record = F.to_json(F.struct("city", F.when(~F.isnan("lat"), F.col("lat")).alias("lat")), {"ignoreNullFields": "false"})
    return places(spark, d).select("id", record.alias("j")).select("id", F.get_json_object("j", "$.city").alias("city"), F.get_json_object("j", "$.lat").cast("double").alias("lat"))


ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
LABEL = ESCAPED.format("array_to_string(coalesce(c, [])[1:3], ', ')")


@query("map_points", f"with {PL}, {PC}, a as (select place_id, list_sort(list(distinct category)) c from pc group by place_id) select id, lat, lon, {ESCAPED.format('name')} as name, {ESCAPED.format('address')} as address, {LABEL} as label from pl left join a on a.place_id = pl.id where lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
def map_points(spark, d):
    """The places that a map can show, with texts for HTML: at most three categories each."""
    rows = P.with_categories(places(spark, d), named_links(spark, d)).dropna(subset=["lat", "lon"])
    label = F.array_join(F.slice("categories", 1, 3), ", ")
    return rows.select("id", "lat", "lon", S.html_escaped(F.col("name")).alias("name"), S.html_escaped(F.col("address")).alias("address"), S.html_escaped(label).alias("label"))


@query("map_center", f"with {PL} select city, round(avg(lat) + 1e-9, 4) as lat, round(avg(lon) + 1e-9, 4) as lon, count(*) as points from pl where city is not null and {OK} group by city")
def map_center(spark, d):
    """The centre of each city's map: the mean of its usable coordinates; a city without any has no map."""
    rows = places(spark, d).where(F.col("city").isNotNull() & usable())
    return rows.groupBy("city").agg(avg_to(F.col("lat"), 4).alias("lat"), avg_to(F.col("lon"), 4).alias("lon"), F.count(F.lit(1)).alias("points"))


# --- scores, cells, graph ----------------------------------------------------------------------

# Weights of category terms, and terms of places in the open.
WEIGHTS = {"museum": 3, "park": 2, "restaurant": 1, "heritage": 2, "cultural": 2}
SCORE = "1 + " + " + ".join(f"case when contains(lower(t), '{k}') then {w} else 0 end" for k, w in WEIGHTS.items())
OUTDOOR = "beach|garden|hiking|lake|natural|nature|outdoor|park|trail|viewpoint|walk"


def _texts(spark, d):
    full = P.with_categories(places(spark, d), named_links(spark, d))
    return full.withColumn("t", F.array_join("categories", " "))


TX = f"{PL}, {PC}, a as (select place_id, array_to_string(list_sort(list(distinct category)), ' ') t from pc group by place_id), tx as (select pl.*, coalesce(a.t, '') t from pl left join a on a.place_id = pl.id)"


@query("category_score", f"with {TX} select id, t as category_text, cast({SCORE} as integer) as score from tx")
def category_score(spark, d):
    return _texts(spark, d).select("id", F.col("t").alias("category_text"), S.contains_score(F.col("t"), WEIGHTS).alias("score"))


@query("outdoor_flag", f"with {TX} select id, regexp_matches(lower(t), '{OUTDOOR}') as outdoor from tx")
def outdoor_flag(spark, d):
    return _texts(spark, d).select("id", F.lower("t").rlike(OUTDOOR).alias("outdoor"))


CELL = f"{TX}, sc as (select id, name, city, {SCORE} score, cast(cast(floor((lat + 90) / 0.05e0) as bigint) as varchar) || ':' || cast(cast(floor((lon + 180) / 0.05e0) as bigint) as varchar) cell from tx where {OK})"


def _scored(spark, d):
    rows = _texts(spark, d).where(usable())
    return rows.select("id", "name", "city", S.contains_score(F.col("t"), WEIGHTS).alias("score"), S.grid_cell(F.col("lat"), F.col("lon"), 0.05).alias("cell"))


@query("cell_clusters", f"with {CELL} select cell, cast(sum(score) as bigint) as total_score, count(distinct id) as poi_count, min_by(city, id) filter (where city is not null and city <> '') as city from sc group by cell having count(distinct id) >= 2")
def cell_clusters(spark, d):
    return P.cells(_scored(spark, d)).select("cell", "total_score", "poi_count", "city")


@query("cell_sample_names", f"with {CELL}, g as (select cell from sc group by cell having count(distinct id) >= 2), f as (select cell, name, min(id) i from sc where name is not null group by cell, name), r as (select *, row_number() over (partition by cell order by i, name) r from f) select g.cell, array_to_string(list(name order by r), '|') as names from g join r on r.cell = g.cell and r <= 5 group by g.cell")
def cell_sample_names(spark, d):
    return P.cells(_scored(spark, d)).where("sample_names is not null").select("cell", joined("sample_names").alias("names"))


@query("graph_nodes", f"with {PL} select 'poi' as kind, id as key from pl where id is not null union all select distinct 'city', city from pl where city is not null union all select distinct 'category', name from silver_categories")
def graph_nodes(spark, d):
    p = places(spark, d)
    node = lambda df, kind, c: df.where(F.col(c).isNotNull()).select(F.lit(kind).alias("kind"), F.col(c).alias("key"))
    return node(p, "poi", "id").unionByName(node(p, "city", "city").distinct()).unionByName(node(categories(spark, d), "category", "name").distinct())


@query("graph_edges", f"with {PL}, {PC} select 'LOCATED_IN' as kind, id as source, city as target from pl where city is not null union all select 'HAS_CATEGORY', place_id, category from pc")
def graph_edges(spark, d):
    located = places(spark, d).where("city is not null").select(F.lit("LOCATED_IN").alias("kind"), F.col("id").alias("source"), F.col("city").alias("target"))
    return located.unionByName(named_links(spark, d).select(F.lit("HAS_CATEGORY").alias("kind"), F.col("place_id").alias("source"), F.col("category").alias("target")))


@query("graph_merge", f"with {PL}, st as (select id from pl where neo4j_synced_at is null or updated_at > neo4j_synced_at) select 'LOCATED_IN' as kind, id as source, case when id in (select id from st) then city else region end as target from pl where case when id in (select id from st) then city else region end is not null")
def graph_merge(spark, d):
    """An older graph, in which places lie in regions, after the places that changed since it was written lie in their cities."""
    p = places(spark, d)
    edge = lambda df, c: df.where(F.col(c).isNotNull()).select(F.lit("LOCATED_IN").alias("kind"), F.col("id").alias("source"), F.col(c).alias("target"))
    changed = changes.stale(p, "updated_at", "neo4j_synced_at")
    return changes.replace_children(edge(p, "region"), edge(changed, "city"), changed.select(F.col("id").alias("source")), "source")


@query("sync_marked", f"with {PL} select id, case when gold_pg_synced_at is null or updated_at > gold_pg_synced_at then timestamp '2025-06-01 00:00:00' else gold_pg_synced_at end as gold_pg_synced_at from pl")
def sync_marked(spark, d):
    now = F.lit("2025-06-01 00:00:00").cast("timestamp_ntz")
    return changes.marked(places(spark, d), "updated_at", "gold_pg_synced_at", now).select("id", "gold_pg_synced_at")


REL = "{PL}, sd as (select * from pl where lower(city) = 'mailoconair'), l as (select distinct place_id, category_id from silver_place_categories), f as (select distinct sd.id, o.name from sd join l a on a.place_id = sd.id join l b on b.category_id = a.category_id and b.place_id <> a.place_id join pl o on o.id = b.place_id{city} where o.name is not null), r as (select *, row_number() over (partition by id order by name) r from f), g as (select id, array_to_string(list(name order by name), '|') x from r where r <= 3 group by id) select sd.id, coalesce(x, '') as related from sd left join g on g.id = sd.id"


@query("related_places", "with " + REL.format(PL=PL, city=" and o.city = sd.city"))
def related_places(spark, d):
    p = places(spark, d)
    return P.related(p, links(spark, d), p.where(F.lower("city") == "mailoconair"), 3, True).select("id", joined("related").alias("related"))


@query("related_places_any_city", "with " + REL.format(PL=PL, city=""))
def related_places_any_city(spark, d):
    p = places(spark, d)
    return P.related(p, links(spark, d), p.where(F.lower("city") == "mailoconair"), 3, False).select("id", joined("related").alias("related"))


@query("avg_related", "with q as (" + "with " + REL.format(PL=PL, city=" and o.city = sd.city") + ") select coalesce(round(avg(case when related = '' then 0 else len(string_split(related, '|')) end), 6), 0) as avg_related from q")
def avg_related(spark, d):
    p = places(spark, d)
    r = P.related(p, links(spark, d), p.where(F.lower("city") == "mailoconair"), 3, True)
    return r.agg(F.coalesce(F.round(F.avg(F.size("related")), 6), F.lit(0.0)).alias("avg_related"))


# --- models ------------------------------------------------------------------------------------

#: Staging views and two stored marts.
MODELS = {
    "stg_place": "select id as place_id, city, region from {places} where id is not null",
    "stg_link": "select distinct place_id, category_id from {links} where place_id is not null and category_id is not null",
    "stg_category": "select id as category_id, name as category from {categories}",
    "mart_category": "select category, count(*) as places from {stg_link} join {stg_category} using (category_id) group by category",
    "mart_city": "select city, count(distinct p.place_id) as places, count(distinct category) as categories from {stg_place} p left join {stg_link} l on l.place_id = p.place_id left join {stg_category} c on c.category_id = l.category_id where city is not null group by city",
}


def _built(spark, d):
    sources = {"places": places(spark, d), "links": table(spark, d, "silver_place_categories"), "categories": categories(spark, d)}
    return models.build(spark, sources, MODELS, {"mart_category", "mart_city"}, scratch(spark, "models"))


@query("mart_city", f"with {PL}, {PC} select city, count(distinct id) as places, count(distinct category) as categories from pl left join pc on pc.place_id = id where city is not null group by city")
def mart_city(spark, d):
    return _built(spark, d)["mart_city"]


@query("mart_category", f"with {PC} select category, count(*) as places from pc group by category")
def mart_category(spark, d):
    return _built(spark, d)["mart_category"]


# --- data quality ------------------------------------------------------------------------------

NN = ("id", "name", "lat", "lon", "city", "address", "postal_code", "website", "updated_at", "description")


@query("dq_not_null", " union all ".join(f"select '{c}' as column_name, count(*) filter (where {c} is null) as nulls from silver_places" for c in NN))
def dq_not_null(spark, d):
    return quality.null_counts(table(spark, d, "silver_places"), list(NN))


@query("dq_unique", "select id as place_id, count(*) as n from silver_places where id is not null group by id having count(*) > 1")
def dq_unique(spark, d):
    return quality.repeated_keys(table(spark, d, "silver_places"), F.col("id"), "place_id")


@query("dq_unique_marts", f"with {PL}, m as (select city from pl where city is not null and trim(city, ' ') <> '' group by city), k as (select 'category_id' k, cast(id as varchar) v from silver_categories union all select 'city', city from m) select k as key_name, count(*) as keys, count(*) - count(distinct v) as repeated from k group by k")
def dq_unique_marts(spark, d):
    """The keys of the category table and of the city mart, and how many of them are repeated."""
    mart = places(spark, d).where(S.non_blank(F.col("city"))).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    count = lambda name, df, key: df.agg(F.lit(name).alias("key_name"), F.count(F.lit(1)).alias("keys"), (F.count(F.lit(1)) - F.countDistinct(key)).alias("repeated"))
    return count("category_id", categories(spark, d), "id").unionByName(count("city", mart, "city"))


@query("exists_probe", "select exists (select 1 from bronze_raw_poi where snapshot_no = 4) as delivered, exists (select 1 from bronze_raw_poi where snapshot_no = 5) as next_delivered, exists (select 1 from gold_clusters) as gold_there")
def exists_probe(spark, d):
    bronze = table(spark, d, "bronze_raw_poi")
    probes = {"delivered": bronze.where("snapshot_no = 4"), "next_delivered": bronze.where("snapshot_no = 5"), "gold_there": table(spark, d, "gold_clusters")}
    return spark.createDataFrame([tuple(not df.isEmpty() for df in probes.values())], ", ".join(f"{k} boolean" for k in probes))


GOLD_ROWS = "gp as (select cell, cast(sum(score) as bigint) as total_score, count(distinct id) as poi_count, min_by(city, id) filter (where city is not null and city <> '') as city from sc group by cell having count(distinct id) >= 2)"


@query("gold_rebuild", f"with {CELL}, {GOLD_ROWS} select cell, total_score, poi_count, city, true as marked from gp")
def gold_rebuild(spark, d):
    """The gold table after two runs: one that rebuilds it, and one that finds no usable rows and leaves it as it is."""
    out, marked = scratch(spark, "gold") + "/clusters", False
    if changes.rebuild_needed(places(spark, d), "updated_at", "gold_pg_synced_at", path_exists(spark, out)):
        fresh = P.cells(_scored(spark, d)).select("cell", "total_score", "poi_count", "city")
        marked = changes.replace_unless_empty(fresh, out)
        changes.replace_unless_empty(fresh.limit(0), out)
    return spark.read.parquet(out).withColumn("marked", F.lit(marked))


@query("dq_fk", "select 'place' as reference, count(*) as missing from silver_place_categories l where place_id is not null and not exists (select 1 from silver_places p where p.id = l.place_id) union all select 'category', count(*) from silver_place_categories l where category_id is not null and not exists (select 1 from silver_categories c where c.id = l.category_id)")
def dq_fk(spark, d):
    l = table(spark, d, "silver_place_categories")  # noqa: E741
    one = lambda name, key, parent: quality.orphans(l, key, parent, "id").agg(F.lit(name).alias("reference"), F.count(F.lit(1)).alias("missing"))
    return one("place", "place_id", table(spark, d, "silver_places")).unionByName(one("category", "category_id", categories(spark, d)))


#: Types of the trusted tables.
CONTRACT = {"id": "string", "name": "string", "lat": "double", "lon": "double", "city": "string", "updated_at": "timestamp_ntz", "rating": "double"}


@query("schema_contract", "with e(column_name, expected) as (values ('id', 'string'), ('name', 'string'), ('lat', 'double'), ('lon', 'double'), ('city', 'string'), ('updated_at', 'timestamp_ntz'), ('rating', 'double')), a as (select column_name, case data_type when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end actual from information_schema.columns where table_name = 'silver_places') select e.column_name, expected, actual from e left join a using (column_name) where actual is distinct from expected")
def schema_contract(spark, d):
    return quality.contract_breaks(table(spark, d, "silver_places"), CONTRACT)
