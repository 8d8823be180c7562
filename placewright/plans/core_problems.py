"""Queries of the general large-scale problems: skewed keys, nested records, snapshots, nearby points."""

from pyspark.sql import functions as F

from placewright.functions.text import city_key, latest
from placewright.operators import eager, nested, slabs, snapshots
from placewright.sources.tables import table

OFFER = "offers[]"
PRICE = f"{OFFER}/schema:priceSpecification[]"
AUDIENCE = f"{PRICE}/hasAudience[]"
LOCATION = "isLocatedAt[]"
ADDRESS = f"{LOCATION}/schema:address[]"
PERIOD = "takesPlaceAt[]"
ENTITIES = {PRICE: "price", AUDIENCE: "audience", ADDRESS: "address", PERIOD: "period"}
TABLES = [OFFER, PRICE, AUDIENCE, LOCATION, ADDRESS, PERIOD]
LAST_SNAPSHOT = 4


def delivered(spark, d, snapshot=LAST_SNAPSHOT):
    """The row that counts for each id of a snapshot: the latest arrival, ties by hash and payload."""
    rows = table(spark, d, "bronze_raw_poi").where((F.col("snapshot_no") == snapshot) & F.col("id").isNotNull()).select("id", "ingested_at", "content_hash", "raw_payload")
    return latest(rows, ["id"], [F.desc_nulls_last("ingested_at"), F.desc_nulls_last("content_hash"), F.desc_nulls_last("raw_payload")]).select("id", "raw_payload")


def _path(c):
    return F.array_join(F.col(c).cast("array<string>"), ".")


def p2_found(spark, d):
    found = nested.triples(delivered(spark, d), {"id": F.col("id")}, F.col("raw_payload"), TABLES, only=list(ENTITIES))
    entity = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))[F.col("ancestor")]
    return nested.pivot_groups(found, ["id"]).select("id", entity.alias("entity"), _path("pos").alias("pos_path"))


def _spelled(v: str) -> str:
    """SQL for what a value stands for: a text that is JSON of an object or list is read."""
    inner = f"json_extract_string({v}, '$')"
    return f"case when json_type({v}) = 'VARCHAR' and json_valid({inner}) and json_type(case when json_valid({inner}) then {inner} end) in ('OBJECT', 'ARRAY') then cast({inner} as json) else {v} end"


def _listed(v: str) -> str:
    return f"case json_type({v}) when 'ARRAY' then json_extract({v}, '$[*]') when 'OBJECT' then [{v}] else [] end"


def _child(name: str, source: str, key: str, keep: str) -> str:
    """SQL tables that give the objects at ``key`` of the objects ``o`` of ``source``, with their place in the list."""
    return (
        f"{name}_s as (select {keep}, {_spelled('x')} l from (select {keep}, json_extract(o, '$.\"{key}\"') x from {source})), "
        f"{name}_m as (select {keep}, unnest({_listed('l')}) m, generate_subscripts({_listed('l')}, 1) - 1 i from {name}_s), "
        f"{name} as (select {keep}, i, o from (select {keep}, i, {_spelled('m')} o from {name}_m) where json_type(o) = 'OBJECT')"
    )


P2_FOUND_SQL = ", ".join([
    "with dl as (select id, raw_payload from (select *, row_number() over (partition by id order by ingested_at desc nulls last, content_hash desc nulls last, raw_payload desc nulls last) rn from bronze_raw_poi where snapshot_no = 4 and id is not null) where rn = 1)",
    f"dc as (select id, o from (select id, {_spelled('v')} o from (select id, cast(raw_payload as json) v from dl where json_valid(raw_payload))) where json_type(o) = 'OBJECT')",
    _child("offer", "dc", "offers", "id"),
    _child("price", "(select id, i a, o from offer)", "schema:priceSpecification", "id, a"),
    _child("audience", "(select id, a, i b, o from price)", "hasAudience", "id, a, b"),
    _child("location", "dc", "isLocatedAt", "id"),
    _child("address", "(select id, i a, o from location)", "schema:address", "id, a"),
    _child("period", "dc", "takesPlaceAt", "id"),
]) + " select id, 'price' as entity, a || '.' || i as pos_path from price union all select id, 'audience', a || '.' || b || '.' || i from audience union all select id, 'address', a || '.' || i from address union all select id, 'period', cast(i as varchar) from period"


def p2_tables(spark, d):
    """All tables that the payloads hold, their repeated names found in the data: rows, records, leaf paths, values."""
    found = nested.triples(delivered(spark, d), {"id": F.col("id")}, F.col("raw_payload"))
    rows = nested.pivot_groups(found, ["id"])
    leaves = F.map_keys("leaves")
    paths = rows.select("ancestor", F.explode(leaves).alias("leaf")).groupBy("ancestor").agg(F.countDistinct("leaf").alias("paths"), F.count(F.lit(1)).alias("values"))
    return rows.groupBy("ancestor").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("id").alias("records")).join(paths, "ancestor", "left").select("ancestor", "objects", "records", F.coalesce("paths", F.lit(0)).alias("paths"), F.coalesce("values", F.lit(0)).alias("values"))


def _flat(spark, d, ancestor, columns):
    """A table of the last snapshot's objects: leaves named in ``columns``, and all others by path in ``other``."""
    found = nested.triples(delivered(spark, d), {"id": F.col("id")}, F.col("raw_payload"), TABLES, only=[ancestor])
    flat = nested.pivot_group(found, ["id"], ancestor, columns, "other")
    return flat.select("id", _path("parent_pos").alias("parent_path"), _path("pos").alias("pos_path"), *columns, "other")


def p2_offers(spark, d):
    return _flat(spark, d, OFFER, {"label": "rdfs:label", "label_fr": "rdfs:label/fr"})


def p2_prices(spark, d):
    return _flat(spark, d, PRICE, {"min_price": "schema:minPrice", "max_price": "schema:maxPrice", "currency": "schema:priceCurrency", "currency_fr": "schema:priceCurrency/fr"})


def p2_audiences(spark, d):
    return _flat(spark, d, AUDIENCE, {"label_fr": "rdfs:label/fr", "label": "rdfs:label"})


def p2_locations(spark, d):
    return _flat(spark, d, LOCATION, {"lat": "schema:geo/schema:latitude", "lon": "schema:geo/schema:longitude"})


def p2_addresses(spark, d):
    city = "hasAddressCity/rdfs:label/fr"
    region = "hasAddressCity/isPartOfDepartment/isPartOfRegion/rdfs:label/fr"
    return _flat(spark, d, ADDRESS, {"street": "schema:streetAddress", "postal_code": "schema:postalCode", "locality": "schema:addressLocality", "city_fr": city, "region_fr": region})


def p2_periods(spark, d):
    return _flat(spark, d, PERIOD, {"start_date": "startDate", "end_date": "endDate", "start_time": "startTime", "end_time": "endTime"})


def p3_found(spark, d):
    places, clusters = table(spark, d, "silver_places"), table(spark, d, "gold_clusters")
    key = city_key(F.col("city"))
    return eager.heavy_keys(places, clusters, key, key, ("silver_places", "gold_clusters"), 0.03).select("table_name", F.col("k").alias("city"))


def p3_city_join(spark, d):
    places, clusters = table(spark, d, "silver_places"), table(spark, d, "gold_clusters")
    key = city_key(F.col("city"))
    j = eager.eager_join_aggregate(places, clusters, key, key, {"lat": F.when(F.col("lat").between(-90, 90), F.col("lat"))}, {"score": F.col("total_score"), "pois": F.col("poi_count").cast("bigint")})
    return j.select(F.col("k").alias("city"), F.col("join_rows").cast("bigint").alias("join_rows"), "left_rows", "right_rows", F.round(F.col("avg_lat") + 1e-9, 4).alias("avg_lat"), F.round("sum_score", 3).alias("sum_score"), F.col("sum_pois").cast("bigint").alias("sum_pois"), "max_score")


P3_CITY = r"nullif(lower(regexp_replace(city, '^[\s\p{Z}\x1c-\x1f]+|[\s\p{Z}\x1c-\x1f]+$', '', 'g')), '')"

P3_FOUND_SQL = f"""
with p as (select {P3_CITY} k from silver_places), g as (select {P3_CITY} k from gold_clusters)
select 'silver_places' as table_name, k as city from p where k is not null group by k
having count(*) >= 0.03 * (select count(*) from p)
union all
select 'gold_clusters', k from g where k is not null group by k having count(*) >= 0.03 * (select count(*) from g)
"""

P3_CITY_JOIN_SQL = f"""
with p as (select {P3_CITY} k, case when lat between -90 and 90 then lat end lat from silver_places),
     g as (select {P3_CITY} k, total_score s, poi_count c from gold_clusters),
     a as (select k, count(*) n from p group by k), b as (select k, count(*) n from g group by k)
select p.k as city, count(*) as join_rows, any_value(a.n) as left_rows, any_value(b.n) as right_rows,
       round(avg(p.lat) + 1e-9, 4) as avg_lat, round(sum(g.s), 3) as sum_score, cast(sum(g.c) as bigint) as sum_pois, max(g.s) as max_score
from p join g on p.k = g.k join a on a.k = p.k join b on b.k = p.k group by p.k
"""


def p5_found(spark, d):
    changes = snapshots.snapshot_changes(table(spark, d, "bronze_raw_poi"), "snapshot_no", "id", snapshots.hex_number(F.col("content_hash")), "ingested_at")
    return changes.select(F.col("s").alias("snapshot_no"), F.col("k").alias("id"), "change_kind")


P5_FOUND_SQL = """
with r as (select snapshot_no s, id, coalesce(nullif(ltrim(lower(content_hash), '0'), ''), '0') h, content_hash,
                  row_number() over (partition by snapshot_no, id order by ingested_at desc nulls last, lower(content_hash) desc) rn
           from bronze_raw_poi where id is not null),
     w as (select s, id, case when content_hash is not null then h end h from r where rn = 1),
     n as (select * from w where s > (select min(s) from w)),
     o as (select s + 1 s, id, h from w where s < (select max(s) from w)),
     j as (select coalesce(n.s, o.s) s, coalesce(n.id, o.id) id, n.id nid, o.id oid, n.h nh, o.h oh
           from n full outer join o on n.s = o.s and n.id = o.id)
select s as snapshot_no, id, case when oid is null then 'added' when nid is null then 'removed' else 'changed' end as change_kind
from j where oid is null or nid is null or nh is distinct from oh
"""


def p6_found(spark, d):
    return slabs.near_pairs(table(spark, d, "silver_places"), "id", "lat", "lon", 30.0)


P6_FOUND_SQL = """
with p as (select distinct id, lat, lon from silver_places where id is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0))
select distinct a.id as id_a, b.id as id_b from p a join p b on a.id < b.id and abs(a.lat - b.lat) < 0.0003e0
where 2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2)
      + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30
"""

def p6_links(spark, d):
    """The linear form: one row per listing and point, instead of pairs."""
    return slabs.near_links(table(spark, d, "silver_places"), "id", "lat", "lon", 30.0)


P6_LINKS_SQL = """
with p as (select distinct id, lat, case when lon = 180 then -180e0 else lon end lon from silver_places where id is not null and lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)),
     c as (select lat, lon, count(*) n from p group by lat, lon),
     l as (select a.lat, a.lon, count(*) n from c a join c b on (a.lat <> b.lat or a.lon <> b.lon) and abs(a.lat - b.lat) < 0.0003e0
           where 2 * 6371008.8e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2)
                 + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30 group by a.lat, a.lon)
select p.id, p.lat, p.lon, c.n as copies, coalesce(l.n, 0) as links from p join c on c.lat = p.lat and c.lon = p.lon left join l on l.lat = p.lat and l.lon = p.lon
"""

#: Three invented rings (latitude, longitude), one concave, two overlapping.
RINGS = {
    "north": ((45.2, 0.5), (47.5, 1.0), (47.0, 4.0), (46.1, 2.4), (45.4, 4.5)),
    "south": ((43.0, 1.0), (45.6, 2.0), (45.1, 6.2), (44.0, 5.0), (42.6, 6.5)),
    "east": ((44.0, 5.5), (46.8, 5.2), (46.3, 9.0), (43.5, 8.5)),
}


def p6_regions(spark, d):
    rings = spark.createDataFrame([(k, [{"lat": a, "lon": o} for a, o in v]) for k, v in RINGS.items()], "region_id string, ring array<struct<lat:double,lon:double>>")
    points = table(spark, d, "silver_places").select("id", "lat", "lon").distinct()
    return slabs.locate(points, rings).groupBy("region_id").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("id").alias("ids"))


def _ring_sql():
    rows = [f"('{k}', {a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for k, v in RINGS.items() for a, b in zip(v, (*v[1:], v[0]), strict=True)]
    return ", ".join(rows)


P6_REGIONS_SQL = f"""
with e(region_id, y1, x1, y2, x2) as (values {_ring_sql()}),
     p as (select distinct id, lat, lon from silver_places where lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)),
     hit as (select region_id, id, lat, lon from p join e on (y1 <= lat) <> (y2 <= lat) and x1 + (lat - y1) * (x2 - x1) / (y2 - y1) <= lon
             group by region_id, id, lat, lon having count(*) % 2 = 1)
select region_id, count(*) as places, count(distinct id) as ids from hit group by region_id
"""

QUERIES = {"p2_found": p2_found, "p2_tables": p2_tables, "p2_offers": p2_offers, "p2_prices": p2_prices, "p2_audiences": p2_audiences, "p2_locations": p2_locations, "p2_addresses": p2_addresses, "p2_periods": p2_periods, "p3_found": p3_found, "p3_city_join": p3_city_join, "p5_found": p5_found, "p6_found": p6_found, "p6_links": p6_links, "p6_regions": p6_regions}
SQL = {"p2_found": P2_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_links": P6_LINKS_SQL, "p3_found": P3_FOUND_SQL, "p3_city_join": P3_CITY_JOIN_SQL, "p5_found": P5_FOUND_SQL, "p6_regions": P6_REGIONS_SQL}
