"""The general problems against brute force and hand-written cases."""

import json
import math
import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from placewright.functions import text
from placewright.operators import eager, nested, slabs, snapshots
from placewright.plans import core_problems as core


def _metres(a, b):
    la, lb, dl = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(dl / 2) ** 2
    return 2 * slabs.EARTH_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("metres", [30.0, 200.0, 9_000_000.0])
def test_near_pairs_equal_brute_force(spark, metres):
    random.seed(1)
    rows = []
    for lat, lon, n, step in ((45, 3, 60, 6e-4), (0, 0, 30, 4e-4), (89.9999, 0, 30, 180), (-89.99995, 90, 20, 180), (-16.9, 180, 40, 5e-4), (60, -0.25, 40, 8e-4), (44.0005, 2, 40, 4e-4)):
        for _ in range(n):
            o = lon + random.uniform(-step, step)
            rows.append((f"i{len(rows)}", max(-90.0, min(90.0, lat + random.uniform(-4e-4, 4e-4))), (o + 180) % 360 - 180))
    rows += [("i5", rows[5][1], rows[5][2]), ("same", rows[7][1], rows[7][2]), ("east", -16.9, 180.0), ("west", -16.9, -180.0), ("pole1", 90.0, 10.0), ("pole2", 90.0, -100.0)]
    bad = [("n1", None, 3.0), ("n2", float("nan"), 3.0), ("n3", 0.0, 0.0), ("n4", 45.0, 181.0), ("n5", 45.0, float("inf")), (None, 45.0, 3.0), ("n6", 0.0, 0.0)]
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] != b[0] and _metres(a[1:], b[1:]) <= metres}
    df = spark.createDataFrame(rows + bad, "id string, lat double, lon double").withColumn("slab", F.lit(1))
    got = [tuple(r) for r in slabs.near_pairs(df, "id", "lat", "lon", metres).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    spots = {(y, -180.0 if x == 180 else x) for _, y, x in rows}
    near = {a: sum(a != b and _metres(a, b) <= metres for b in spots) for a in spots}
    links = slabs.near_links(df, "id", "lat", "lon", metres).collect()
    assert {(r.lat, r.lon): r.links for r in links} == near and len(links) == len({(i, y, -180.0 if x == 180 else x) for i, y, x in rows})
    assert slabs.near_pairs(spark.createDataFrame([], "id string, lat double, lon double"), "id", "lat", "lon", 30.0).count() == 0


def test_near_pairs_on_table(spark, root):
    rows = [(r.id, r.lat, r.lon) for r in spark.read.parquet(f"{root}/silver_places.parquet").select("id", "lat", "lon").where("lat is not null and lon is not null").distinct().collect()]
    rows = [r for r in rows if abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1], r[2]) != (0, 0)]
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[0] != b[0] and abs(a[1] - b[1]) < 0.001 and _metres(a[1:], b[1:]) <= 30}
    assert {tuple(r) for r in core.p6_found(spark, root).collect()} == want


def _cast(rings, points):
    """Ray casting over all rings of all regions."""
    found = set()
    for name in {k for k, _ in rings}:
        for i, y, x in points:
            hits = 0
            for turn in (-360, 0, 360):
                for k, ring in rings:
                    if k != name:
                        continue
                    lons = [ring[0][1]]
                    for _, o in ring[1:]:
                        lons.append(lons[-1] + (o - lons[-1] + 180) % 360 - 180)
                    r = [(a[0], o + turn) for a, o in zip(ring, lons, strict=True)]
                    hits += sum((a[0] <= y) != (b[0] <= y) and a[1] + (y - a[0]) * (b[1] - a[1]) / (b[0] - a[0]) <= x for a, b in zip(r, (*r[1:], r[0]), strict=True)) % 2
            if hits % 2:
                found.add((i, name))
    return found


@pytest.mark.parametrize(("group_rows", "slab", "strip"), [(200_000, 0.5, 1.0), (20, 0.5, 30.0), (100, 20.0, 0.3)])
def test_locate_equals_ray_casting(spark, group_rows, slab, strip):
    random.seed(2)
    pts = [(str(i), random.uniform(42, 48), random.uniform(0, 10)) for i in range(300)] + [(f"f{i}", random.uniform(-20, -10), random.uniform(170, 190)) for i in range(200)]
    pts = [(i, y, (x + 180) % 360 - 180) for i, y, x in pts]
    star = [(45 + (2 if k % 2 else 0.7) * math.sin(k * math.pi / 7), 5 + (4 if k % 2 else 1) * math.cos(k * math.pi / 7)) for k in range(14)]
    rings = [*core.RINGS.items(), ("star", star), ("star", [(45, 4.8), (45.3, 5), (45, 5.2), (44.8, 5)]), ("over", [(-18, 175), (-12, 178), (-11, -174), (-17, -172)]), ("far", [(-16, 188.5), (-13, 172), (-19, 180.0)]), ("bow", [(43, 1), (47, 9), (43, 9), (47, 1)])]
    rings += [("flat", [(1, 1), (1, 2)]), ("torn", [(40, 0), (50, 0), (float("nan"), 10), (40, 10)]), *((f"box{k}", [(43 + k / 10, 2), (43 + k / 10, 3), (43.1 + k / 10, 3), (43.1 + k / 10, 2)]) for k in range(20))]
    want = _cast([r for r in rings if len(r[1]) > 2 and r[0] != "torn"], pts)
    df = spark.createDataFrame([(k, [{"lat": float(a), "lon": float(o)} for a, o in v]) for k, v in [*rings, rings[0]]], "region_id string, ring array<struct<lat:double,lon:double>>")
    got = [tuple(r) for r in slabs.locate(spark.createDataFrame([*pts, ("n", None, 1.0)], "id string, lat double, lon double"), df, slab, strip, group_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {k for _, k in want} >= {"north", "south", "east", "star", "over", "far", "bow", "box3"}
    assert slabs.locate(spark.createDataFrame(pts, "id string, lat double, lon double"), df.limit(0)).count() == 0


def test_shred_cases():
    one = nested.Shredder(nested.names_of(core.TABLES), set(core.ENTITIES), False)
    shred = lambda doc: sorted((core.ENTITIES[a], p) for a, p, *_ in one(doc if isinstance(doc, str | None) else json.dumps(doc)))
    assert shred(None) == shred("") == shred("{") == shred("[1]") == shred("3") == shred("[" * 100_000) == shred('{"a":' * 100_000) == []
    doc = {"offers": [0, {"schema:priceSpecification": [None, {}, [{}], {"hasAudience": {}}]}, {"schema:priceSpecification": {"hasAudience": ["x", {"a": 1}]}}]}
    want = sorted([("price", [1, 1]), ("price", [1, 3]), ("audience", [1, 3, 0]), ("price", [2, 0]), ("audience", [2, 0, 1])])
    assert shred(doc) == want
    wrapped = json.dumps(doc)
    for _ in range(12):
        wrapped = json.dumps(wrapped)
        assert shred(wrapped) == want
    assert shred({"offers": json.dumps(doc["offers"])}) == want
    assert shred({"takesPlaceAt": {}, "isLocatedAt": {"schema:address": ['{"a": 1}', "x"]}}) == [("address", [0, 0]), ("period", [0])]
    assert shred('{"takesPlaceAt": [{}, {}], "takesPlaceAt": {"takesPlaceAt": [{}]}}') == [("period", [0])]
    assert shred({"takesPlaceAt": '[{"a": 1}, {"b": '}) == shred({"takesPlaceAt": "{"}) == []
    deep = {"takesPlaceAt": [json.loads('{"a":' * 400 + "1" + "}" * 400)]}
    assert shred(deep) == [("period", [0])] and shred('{"takesPlaceAt": [' + '{"a":' * 50_000 + "1" + "}" * 50_000 + "]}") == [("period", [0])]


def test_lists_where_an_object_was_expected_lose_nothing():
    shred = nested.Shredder(nested.names_of(["a/b[]"]))
    assert shred(json.dumps({"a": [{"b": {"x": 1}}, {"b": [{"x": 2}, {"x": 3}]}]})) == [
        ("", [], "", None), ("a[]", [0], "", None), ("a[]/b[]", [0, 0], "", None), ("a[]/b[]", [0, 0], "x", "1"),
        ("a[]", [1], "", None), ("a[]/b[]", [1, 0], "", None), ("a[]/b[]", [1, 0], "x", "2"), ("a[]/b[]", [1, 1], "", None), ("a[]/b[]", [1, 1], "x", "3"),
    ]
    assert shred('{"k": [1, [{"z": 1}], "q"], "s/t": "v"}') == [("", [], "", None), ("", [], "k", '[1, [{"z": 1}], "q"]'), ("", [], "s~1t", "v")]


def test_events_accept_what_the_library_accepts():
    random.seed(4)

    def value(depth=0):
        k = random.random()
        if depth > 4 or k < 0.4:
            return random.choice([1, -2.5, 1e30, True, None, "x", "", "é\n\"", float("nan"), float("-inf")])
        return {random.choice("abc"): value(depth + 1) for _ in range(random.randint(0, 4))} if k < 0.7 else [value(depth + 1) for _ in range(random.randint(0, 4))]

    def accepted(read, t):
        try:
            read(t)
        except ValueError:
            return False
        return True

    seen = set()
    for _ in range(3000):
        t = json.dumps(value(), indent=random.choice([None, 1]))
        if random.random() < 0.6:
            i = random.randrange(len(t))
            t = t[:i] + random.choice(["", ",", "]", "}", '"', " ", "1", "tru", ":"]) + t[i + random.randint(0, 1) :]
        seen.add(accepted(json.loads, t))
        assert accepted(json.loads, t) == accepted(lambda x: list(nested.events(x)), t), t
    assert seen == {True, False}


def test_nested_tables(spark):
    doc = {"offers": [{"schema:priceSpecification": [{"schema:minPrice": 3, "schema:priceCurrency": {"fr": ["EUR"]}}, {}]}]}
    df = spark.createDataFrame([("a", json.dumps(doc)), ("b", "nope"), ("c", None)], "pos string, value string")
    rec = df.withColumnRenamed("pos", "rec")
    found = nested.triples(rec, {"rec": F.col("rec")}, F.col("value"), [core.PRICE])
    with pytest.raises(ValueError, match="pos"):
        nested.triples(df, {"pos": F.col("pos")}, F.col("value"), [core.PRICE])
    flat = nested.pivot_group(found, ["rec"], core.PRICE, {"low": "schema:minPrice", "cur": "schema:priceCurrency/fr"}).orderBy("pos").collect()
    assert [(r.rec, r.pos, r.parent_pos, r.low, r.cur) for r in flat] == [("a", [0, 0], [0], "3", '["EUR"]'), ("a", [0, 1], [0], None, None)]
    assert nested.triples(rec.limit(0), {"rec": F.col("rec")}, F.col("value")).count() == 0


def test_records_with_one_key(spark):
    df = spark.createDataFrame([(None, '{"a": [{"x": 1}]}'), (None, '{"a": [{"x": 2, "y": 3}]}'), (1, '{"a": {"x": 1}}'), (1, '{"a": {"x": 1}}')], "id int, t string")
    found = nested.triples(df, {"id": F.col("id")}, F.col("t"), ["a[]"])
    assert {(r.id, *r.leaves.items()) for r in nested.pivot_groups(found, ["id"]).collect()} == {(None, ("x", "2"), ("y", "3")), (1, ("x", "1"))}
    assert {(r.id, r.x, *r.other.items()) for r in nested.pivot_group(found, ["id"], "a[]", {"x": "x"}, "other").collect()} == {(None, "2", ("y", "3")), (1, "1")}


def test_repeated_names_are_found(spark, monkeypatch):
    docs = [{"a": {"b": {"x": 1}}, "n": {"m": {"y": 2}}}, {"a": [{"b": {"x": 3}}]}, {"a": {"b": [{"x": 4}, {"x": 5}]}}, {"l": [1]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, t string")
    assert nested.repeated_names(df, F.col("t")) == {"a", "a/b"}
    rows = nested.pivot_groups(nested.triples(df, {"id": F.col("id")}, F.col("t")), ["id"]).collect()
    assert sorted((r.ancestor, r.id, r.pos, r.parent_pos, r.leaves) for r in rows) == [
        ("", 0, [], [], {"n/m/y": "2"}), ("", 1, [], [], {}), ("", 2, [], [], {}), ("", 3, [], [], {"l": "[1]"}),
        ("a[]", 0, [0], [], {}), ("a[]", 1, [0], [], {}), ("a[]", 2, [0], [], {}),
        ("a[]/b[]", 0, [0, 0], [0], {"x": "1"}), ("a[]/b[]", 1, [0, 0], [0], {"x": "3"}), ("a[]/b[]", 2, [0, 0], [0], {"x": "4"}), ("a[]/b[]", 2, [0, 1], [0], {"x": "5"}),
    ]
    monkeypatch.setattr(nested, "MAX_PATHS", 1)
    with pytest.raises(ValueError, match="look like data"):
        nested.repeated_names(df, F.col("t"))


def test_eager_equals_plain_join(spark):
    random.seed(3)
    a = spark.createDataFrame([(random.choice(["x"] * 9 + ["y", None, "z"]), random.choice([None, 1.0, 2.5, -3.0])) for _ in range(200)], "k string, v double")
    b = spark.createDataFrame([(random.choice(["x", "x", "y", None, "w"]), random.randint(0, 9)) for _ in range(60)], "k string, v int")
    got = eager.eager_join_aggregate(a, b, F.col("k"), F.col("k"), {"lv": F.col("v")}, {"rv": F.col("v")}).select("k", "join_rows", "sum_lv", "avg_lv", "sum_rv", "min_lv", "max_rv")
    a.createOrReplaceTempView("ta")
    b.createOrReplaceTempView("tb")
    want = spark.sql("select ta.k, count(*), sum(ta.v), avg(ta.v), sum(tb.v), min(ta.v), max(tb.v) from ta join tb on ta.k = tb.k group by ta.k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert eager.eager_join_aggregate(a.limit(0), b, F.col("k"), F.col("k"), {}, {}).count() == 0
    full = eager.eager_join_aggregate(a, b, F.col("k"), F.col("k"), {"lv": F.col("v")}, {"rv": F.col("v")}, "full_outer")
    total = eager.roll_up(full).first()
    assert (total.left_total, total.right_total, total.join_total) == (200, 60, sum(w[1] for w in want.collect())) and full.where("k is null").count() == 2


def test_products_of_hot_counts_fit(spark):
    n = 3_500_000_000
    rows = spark.createDataFrame([("x", n, n, 2 * n)], "k string, l_n long, r_n long, l_sum_v long")
    wide = F.col("l_n").cast("decimal(19,0)") * F.col("r_n").cast("decimal(19,0)")
    got = rows.select(wide.cast(eager.WIDE).alias("a"), eager._times(F.col("l_sum_v"), F.col("r_n"), "bigint").alias("b")).first()
    assert (got.a, got.b) == (n * n, 2 * n * n)


def test_heavy_keys(spark):
    a = spark.createDataFrame([(" Paris ",)] * 3 + [("PARIS",), (None,), (" ",), ("lyon",)] + [(f"c{i}",) for i in range(93)], "city string")
    got = eager.heavy_keys(a, a.limit(0), text.city_key(F.col("city")), text.city_key(F.col("city")), ("a", "b"), 0.04)
    assert [(r.table_name, r.k, r.n, r.total, r.join_rows) for r in got.collect()] == [("a", "paris", 4, 100, 0)]
    both = eager.heavy_keys(a, a, text.city_key(F.col("city")), text.city_key(F.col("city")), ("a", "b"), 0.04).collect()
    assert sorted((r.table_name, r.k, r.n, r.join_rows) for r in both) == [("a", "paris", 4, 16), ("b", "paris", 4, 16)]


def test_snapshot_changes(spark):
    t = lambda s: dt.datetime(2025, 1, s, tzinfo=dt.timezone.utc)
    rows = [(1, "a", "0f", t(1)), (1, "b", "1", t(1)), (1, "c", None, t(1)), (1, "d", "5", t(1)), (1, "d", "6", t(2)), (1, None, "9", t(1))]
    rows += [(2, "a", "0x0F", t(1)), (2, "b", "2", t(1)), (2, "c", None, t(1)), (2, "e", "7", t(1)), (2, "d", "006", None)]
    rows += [(4, "a", "F", t(1)), (4, "a", "F", t(1)), (4, "c", "3", t(1))]
    df = spark.createDataFrame(rows, "n int, id string, hash string, at timestamp").withColumn("leaf", F.lit("extra"))
    for bits, fan in ((12, 6), (3, 2), (1, 1), (None, 6), (13, 5)):
        got = {tuple(r) for r in snapshots.snapshot_changes(df, "n", "id", snapshots.hex_number(F.col("hash")), "at", bits, fan).collect()}
        assert got == {(2, "b", "changed"), (2, "e", "added"), (4, "b", "removed"), (4, "c", "changed"), (4, "d", "removed"), (4, "e", "removed")}
    assert snapshots.snapshot_changes(df.limit(0), "n", "id", F.col("hash"), "at").count() == 0


def test_tree_prunes(spark):
    one = spark.range(20_000).select(F.lit(1).alias("n"), F.col("id").cast("string").alias("id"), F.lit("a").alias("h"), F.lit(None).cast("timestamp").alias("at"))
    two = one.withColumn("n", F.lit(2)).withColumn("h", F.when(F.col("id").cast("int") % 400 == 0, "b").otherwise("a"))
    got = {r.level: (r.compared, r.differing) for r in snapshots.pruned_shares(one.unionByName(two), "n", "id", F.col("h"), "at").collect()}
    assert sorted(got) == [6, 12, 13] and got[6][0] == 64 and got[13][0] > 7000 and 45 <= got[13][1] <= 50 >= got[12][1]
    assert {r.change_kind for r in snapshots.snapshot_changes(one.unionByName(two), "n", "id", F.col("h"), "at").collect()} == {"changed"}


def _direct(text):
    """The entities of one payload, read straight from the statement of the problem."""

    def spelled(v):
        if isinstance(v, str):
            try:
                inner = json.loads(v)
            except ValueError:
                return v
            return spelled(inner) if isinstance(inner, dict | list | str) else v
        return v

    def listed(v):
        v = spelled(v)
        return [] if v is None else [spelled(m) for m in v] if isinstance(v, list) else [v]

    try:
        doc = spelled(json.loads(text))
    except (ValueError, TypeError):
        return set()
    out = set()
    if not isinstance(doc, dict):
        return out
    for i, o in enumerate(listed(doc.get("offers"))):
        for j, p in enumerate(listed(o.get("schema:priceSpecification")) if isinstance(o, dict) else []):
            if isinstance(p, dict):
                out.add(("price", f"{i}.{j}"))
                out |= {("audience", f"{i}.{j}.{k}") for k, a in enumerate(listed(p.get("hasAudience"))) if isinstance(a, dict)}
    for i, o in enumerate(listed(doc.get("isLocatedAt"))):
        out |= {("address", f"{i}.{j}") for j, a in enumerate(listed(o.get("schema:address")) if isinstance(o, dict) else []) if isinstance(a, dict)}
    return out | {("period", str(i)) for i, o in enumerate(listed(doc.get("takesPlaceAt"))) if isinstance(o, dict)}


@pytest.mark.parametrize("where", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_nested_equals_direct_reading(spark, where):
    rows = spark.read.parquet(f"{where}/bronze_raw_poi.parquet").where("snapshot_no = 4 and id is not null").collect()
    last = {}
    for r in rows:
        mark = (r.ingested_at is not None, r.ingested_at, r.content_hash or "", r.raw_payload or "")
        if r.id not in last or mark > last[r.id][0]:
            last[r.id] = mark, r.raw_payload
    want = {(i, *e) for i, (_, t) in last.items() for e in _direct(t)}
    got = [tuple(r) for r in core.p2_found(spark, where).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


TABLES = {core.OFFER: "p2_offers", core.PRICE: "p2_prices", core.AUDIENCE: "p2_audiences", core.LOCATION: "p2_locations", core.ADDRESS: "p2_addresses", core.PERIOD: "p2_periods"}


def test_nested_tables_keep_every_leaf(spark, tmp_path):
    doc = {
        "offers": [{"rdfs:label": "Menu"}, 3, {"schema:priceSpecification": {"schema:priceCurrency": {"fr": ["EUR"]}, "note": 1, "hasAudience": [{"a/b": 1, "a": {"b": 2}, "": 3}]}}],
        "isLocatedAt": {"schema:geo": {"schema:latitude": "4.5", "schema:longitude": 6}, "schema:address": [{"hasAddressCity": {"rdfs:label": {"fr": ["V"]}, "insee": "1"}}]},
        "takesPlaceAt": [{"startDate": "2025-01-01", "startTime": "09:00:00", "endTime": "10:00:00", "n": 7}, {}],
    }
    columns = "snapshot_no int, id string, ingested_at timestamp, content_hash string, raw_payload string"
    spark.createDataFrame([(4, "r", None, "0", json.dumps(doc))], columns).write.parquet(f"{tmp_path}/bronze_raw_poi.parquet")
    got = {t: {(r.parent_path, r.pos_path): {k: v for k, v in r.asDict().items() if v and k not in ("id", "parent_path", "pos_path")} for r in core.QUERIES[t](spark, str(tmp_path)).collect()} for t in TABLES.values()}
    assert got == {
        "p2_offers": {("", "0"): {"label": "Menu"}, ("", "2"): {}},
        "p2_prices": {("2", "2.0"): {"currency_fr": '["EUR"]', "other": {"note": "1"}}},
        "p2_audiences": {("2.0", "2.0.0"): {"other": {"a~1b": "1", "a/b": "2", "": "3"}}},
        "p2_locations": {("", "0"): {"lat": "4.5", "lon": "6"}},
        "p2_addresses": {("0", "0.0"): {"city_fr": '["V"]', "other": {"hasAddressCity/insee": "1"}}},
        "p2_periods": {("", "0"): {"start_date": "2025-01-01", "start_time": "09:00:00", "end_time": "10:00:00", "other": {"n": "7"}}, ("", "1"): {}},
    }


def test_nested_tables_hold_all_leaves_and_parents(spark, root):
    shred = nested.Shredder(nested.names_of(list(TABLES)), set(TABLES))
    want = dict.fromkeys(TABLES, 0)
    for r in core.delivered(spark, root).collect():
        for a, _, _, value in shred(r.raw_payload):
            want[a] += value is not None
    rows = {a: [r.asDict() for r in core.QUERIES[t](spark, root).collect()] for a, t in TABLES.items()}
    assert {a: sum(len(r["other"]) + sum(v is not None for k, v in r.items() if k not in ("id", "parent_path", "pos_path", "other")) for r in rs) for a, rs in rows.items()} == want
    at = {a: {(r["id"], r["pos_path"]) for r in rs} for a, rs in rows.items()}
    for child, parent in ((core.PRICE, core.OFFER), (core.AUDIENCE, core.PRICE), (core.ADDRESS, core.LOCATION)):
        assert {(r["id"], r["parent_path"]) for r in rows[child]} <= at[parent] and rows[child]


def test_a_third_of_all_rows_in_one_group(spark):
    n = 6000
    hot = F.col("id") % 3 == 0
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(hot, "Paris ").otherwise(F.concat(F.lit("c"), F.col("id") % 100)).alias("city"), F.when(hot, 45.0).otherwise(40 + F.col("id") / 1000).alias("lat"), F.when(hot, 3.0).otherwise(2 + F.col("id") / 1000).alias("lon"))
    key = text.city_key(F.col("city"))
    found = eager.heavy_keys(rows, rows, key, key, ("a", "b"), 0.03).collect()
    assert sorted((r.table_name, r.k, r.n, r.join_rows) for r in found) == [("a", "paris", 2000, 4_000_000), ("b", "paris", 2000, 4_000_000)]
    links = slabs.near_links(rows, "id", "lat", "lon", 30.0)
    assert {(r.copies, r.links, r.n) for r in links.groupBy("copies", "links").agg(F.count("*").alias("n")).collect()} == {(2000, 0, 2000), (1, 0, 4000)}
    # one key delivered again and again, with other arrivals
    twice = spark.range(n).select((F.col("id") % 2 + 1).cast("int").alias("s"), F.when(hot, "k").otherwise(F.col("id").cast("string")).alias("id"), (F.col("id") % 7).cast("string").alias("h"), F.timestamp_seconds("id").alias("at"))
    kinds = snapshots.snapshot_changes(twice, "s", "id", F.col("h"), "at").groupBy("change_kind").count().collect()
    last = [max(i for i in range(n) if i % 3 == 0 and i % 2 == odd) % 7 for odd in (0, 1)]
    assert {r.change_kind: r["count"] for r in kinds} == {"added": 2000, "removed": 2000, **({"changed": 1} if last[0] != last[1] else {})}
    box = spark.createDataFrame([("r", [{"lat": a, "lon": o} for a, o in ((44.0, 2.0), (46.0, 2.0), (46.0, 4.0), (44.0, 4.0))])], "region_id string, ring array<struct<lat:double,lon:double>>")
    want = sum(1 for i in range(n) if i % 3 == 0 or (44 <= 40 + i / 1000 < 46 and 2 <= 2 + i / 1000 < 4))
    assert slabs.locate(rows, box, group_rows=300).count() == want
