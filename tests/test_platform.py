"""Rules of the place platform on hand-written rows."""

import datetime as dt
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from placewright.functions import jsonpath as J
from placewright.functions import scalars as S
from placewright.functions.text import clean_text, fold, strip
from placewright.operators import changes, documents, events, places, planner, quality
from placewright.plans import cut, raw_documents
from placewright.sources import archives, config, models, weather
from placewright.streaming import intake


def values(spark, expr, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("rule", "given", "want"),
    [
        (clean_text, [" a ", "", " \t", "None", "nan", "Nan", None], ["a", None, None, None, None, "Nan", None]),
        (strip, [" x y \n"], ["x y"]),
        (fold, ["ÉTÉ œuf Straße é", "ĐŁ ñ", None], ["ete œuf straße e", "đł n", None]),
        (S.try_number, ["1e3", " 2.5 ", "-.5", "0x10", "1_000", "1,5", "1.5f", "1d", "NaN", "", None], [1000.0, 2.5, -0.5] + [None] * 8),
        (S.try_iso_date, ["2024-02-29", "2023-02-29", "2024-01-02T10:00:00Z", "01/02/2024", None], [dt.date(2024, 2, 29), None, dt.date(2024, 1, 2), None, None]),
        (S.try_clock, ["09:30:00", "09:30", "24:00", "9:30", "9:30 pm", "2024-01-02T10:20:30", "2024-01-02 10:20", "xx", "930", None], ["09:30:00", "09:30:00", None, "09:30:00", "21:30:00", "10:20:30", "10:20:00", None, None, None]),
        (S.html_escaped, ["<a & 'b'>", '"', None], ["&lt;a &amp; &#x27;b&#x27;&gt;", "&quot;", None]),
        (S.megabytes, ["1048576", "x", "2621440", None], ["1.0 MB", None, "2.5 MB", None]),
        (lambda c: S.or_default(c, "?"), ["a", "", None], ["a", "?", "?"]),
        (S.split_terms, ["a, b ,,c", "", None], [["a", "b", "c"], [], None]),
        (S.file_name_of, ['attachment; FileName="a b.zip"', "none", None], ["a b.zip", None, None]),
        (lambda c: S.contains_score(c, {"museum": 3, "park": 2}), ["Museum Parking", "x"], [6, 1]),
    ],
)
def test_scalars(spark, rule, given, want):
    assert values(spark, rule, given) == want


def test_terms_and_instants(spark):
    assert values(spark, S.normalized_terms, [[" A", "a", "", "B "], [], None], "array<string>") == [["A", "B"], [], None]
    assert values(spark, lambda c: S.match_count(c, ["MUSEUM", "x"]), [["Museum", "y"], None], "array<string>") == [1, 0]
    got = values(spark, lambda c: F.unix_seconds(S.event_instant(c)), ["1970-01-01T00:00:10Z", "1970-01-01T01:00:10+01:00", "1970-01-01T00:00:10", "bad", None])
    assert got == [10, 10, 10, None, None]
    assert values(spark, lambda c: S.grid_cell(c, c, 0.5), [1.2], "double") == ["182:362"]


DOC = {
    "@id": "x", "@type": ["Museum", 3, "Park"], "rdfs:label": {"en": "E", "fr": ["", "F2"]}, "schema:startDate": "2024-01-01", "schema:endDate": "2024-01-09",
    "isLocatedAt": [{"schema:address": [{"schema:streetAddress": "1 r A", "schema:postalCode": 123}], "schema:geo": {"schema:latitude": "90", "schema:longitude": "abc"}}],
    "takesPlaceAt": [{"startDate": "2024-01-05", "startTime": "10:00"}, {}, 7],
    "offers": [{"schema:priceSpecification": [{"schema:minPrice": [1, "2"], "schema:maxPrice": [5, 6], "schema:priceCurrency": "EUR"}, {"schema:minPrice": "3"}, {"schema:priceCurrency": {"fr": ["CHF"]}}, 4]}, "x"],
}


def test_documents(spark):
    rows = [("a", json.dumps(DOC)), ("b", "{}"), ("c", "nope"), ("d", "[1]"), ("e", None), ("f", json.dumps({"rdfs:label": 5, "offers": None, "schema:endDate": "2024-03-03"}))]
    df = spark.createDataFrame(rows, "id string, p string")
    got = {r.id: r for r in documents.extract_fields(df, "id", "p").collect()}
    assert (got["a"].name, got["a"].address, got["a"].postal_code, got["a"].lat, got["a"].lon) == ("E", "1 r A", None, 90.0, None)
    assert all(got[k].name is None for k in "bcdef")
    v = df.select("id", J.document(F.col("p")).alias("v"))
    one = {r.id: r for r in v.select("id", documents.extract_categories(F.col("v")).alias("c"), documents.extract_timings(F.col("v")).alias("t"), documents.extract_prices(F.col("v")).alias("p"), J.at(F.col("v"), "offers.0.schema:priceSpecification.1.schema:minPrice").try_cast("string").alias("m")).collect()}
    assert one["a"].c == ["Museum", "Park"] and one["b"].c == [] and one["a"].m == "3"
    assert [tuple(map(str, t)) for t in one["a"].t] == [("2024-01-05", "2024-01-09", "10:00:00", "None"), ("2024-01-01", "2024-01-09", "None", "None")]
    assert [(t.start_date, str(t.end_date)) for t in one["f"].t] == [(None, "2024-03-03")] and one["b"].t == []
    want = [(1.0, 5.0, "EUR"), (1.0, 6.0, "EUR"), (2.0, 5.0, "EUR"), (2.0, 6.0, "EUR"), (3.0, 3.0, None), (None, None, "CHF")]
    assert [tuple(p) for p in one["a"].p] == want and one["f"].p == one["c"].p == []


def test_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "id string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", None), ("d", None)], "id string, h string")
    assert sorted((r.id, r.status) for r in changes.classify(old, new, "id", "h").collect()) == [("a", "unchanged"), ("b", "updated"), ("c", "unchanged"), ("d", "inserted")]
    t = lambda df: df.withColumn("t", F.lit(0))
    assert sorted(map(tuple, changes.merge(t(old), t(new), "id", "h", "t", F.lit(1)).select("id", "t").collect())) == [("a", 0), ("b", 1), ("c", 0), ("d", 1)]
    kids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "id string, c int")
    fresh = spark.createDataFrame([("a", 9)], "id string, c int")
    assert sorted(map(tuple, changes.replace_children(kids, fresh, fresh, "id").collect())) == [("a", 9), ("b", 1)]
    marks = spark.createDataFrame([(1, 5, None), (2, 5, 4), (3, 5, 5)], "id int, u int, m int")
    assert sorted(r.id for r in changes.stale(marks, "u", "m").collect()) == [1, 2]
    assert sorted(r.m for r in changes.marked(marks, "u", "m", F.lit(9)).collect()) == [5, 9, 9]


def test_quality(spark):
    rows = [("a", "n", 90.0, -180.0), ("b", "n", 91.0, 0.0), ("c", "n", float("nan"), 0.0), ("d", None, 1.0, 1.0), (None, "n", 1.0, 1.0), ("e", "n", 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "id string, name string, lat double, lon double")
    assert [r.id for r in quality.valid_places(df).collect()] == ["a"]
    assert {r.column_name: r.nulls for r in quality.null_counts(df, ["id", "name"]).collect()} == {"id": 1, "name": 1}
    assert quality.contract_breaks(df, {"id": "string", "lat": "float", "x": "int"}).count() == 2
    assert quality.orphans(df, "id", df.where("id <> 'a'").withColumnRenamed("id", "k"), "k").count() == 1


def test_cells_and_related(spark):
    rows = [("1", "B", None, 1, "x"), ("2", "A", "", 2, "x"), ("3", "B", "Ville", 3, "x"), ("4", "Z", "Autre", 1, "x"), ("5", "Q", "V", 1, "y")]
    df = spark.createDataFrame(rows, "id string, name string, city string, score int, cell string")
    got = places.cells(df, 2, 2).collect()
    assert [(r.cell, r.total_score, r.poi_count, r.city, r.sample_names) for r in got] == [("x", 7, 4, "Ville", ["B", "A"])]
    p = spark.createDataFrame([("1", "n1", "v"), ("2", "n2", "v"), ("3", "n3", "w"), ("4", "n1", "w"), ("5", None, "v")], "id string, name string, city string")
    links = spark.createDataFrame([("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 1), ("3", 2)], "place_id string, category_id int")
    seeds = p.where("id in ('1', '5')")
    same = {r.id: r.related for r in places.related(p, links, seeds, 2, True).collect()}
    anyc = {r.id: r.related for r in places.related(p, links, seeds, 2, False).collect()}
    assert same == {"1": ["n2"], "5": ["n1", "n2"]} and anyc == {"1": ["n1", "n2"], "5": ["n1", "n2"]}


def test_planner(spark):
    df = spark.createDataFrame([(str(i), f"n{i}", 45.0 + i % 3, 3.0) for i in range(9)], "id string, name string, lat double, lon double").withColumn("city", F.lit("c"))
    assert {r.id: r.day for r in planner.nearest_center(df, [(45.0, 3.0), (46.0, 3.0), (47.0, 3.0)]).collect()} == {str(i): i % 3 + 1 for i in range(9)}
    days = planner.kmeans_days(df, 3, 2).groupBy("day").count().collect()
    assert sorted((r.day, r["count"]) for r in days) == [(1, 3), (2, 3), (3, 3)]
    groups = planner.kmeans_per_group(df, "city", 3, 5).groupBy("day").count().collect()
    assert sorted((r.day, r["count"]) for r in groups) == [(1, 3), (2, 3), (3, 3)]
    assert planner.kmeans_days(df.limit(0), 3).count() == 0
    start, end = planner.schedule(F.col("i"))
    assert [tuple(r) for r in spark.createDataFrame([(1,), (7,)], "i int").select(start, end).collect()] == [("09:00", "11:00"), ("00:00", "02:00")]
    dealt = planner.round_robin(df, ["city"], [F.col("id")], 3, 2).collect()
    assert sorted((r.id, r.day, r.stop) for r in dealt) == [("0", 1, 1), ("1", 2, 1), ("2", 3, 1), ("3", 1, 2), ("4", 2, 2), ("5", 3, 2)]


def test_kmeans_of_a_group_counts_every_row(spark):
    # 30,000 rows at one point of each of two clusters, and one row far from them: any sample of 2,000 rows misses it
    rows = [(f"{i:05d}", 45.0 + i % 2, 3.0) for i in range(30_000)] + [("far", 10.0, 3.0)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double").withColumn("city", F.lit("c")).unionByName(spark.createDataFrame([("x", 1.0, 1.0, "one"), ("y", 1.0, 1.0, "one")], "id string, lat double, lon double, city string"))
    got = {(r.city, r.day): r["count"] for r in planner.kmeans_per_group(df, "city", 3).groupBy("city", "day").count().collect()}
    assert got == {("c", 1): 1, ("c", 2): 15_000, ("c", 3): 15_000, ("one", 1): 2}


def test_kmeans_of_groups_ends_at_means(spark):
    rng = random.Random(5)
    rows = [(f"{g}{i}", g, rng.gauss(rng.choice((44, 45, 47)), 0.3), rng.gauss(rng.choice((2, 5)), 0.3)) for g in "ab" for i in range(6_000)]
    df = spark.createDataFrame(rows, "id string, city string, lat double, lon double")
    got = {r.id: r.day for r in planner.kmeans_per_group(df, "city", 3).collect()}
    assert len(got) == len(rows)
    for g in "ab":
        mine = [r for r in rows if r[1] == g]
        days = [[r for r in mine if got[r[0]] == day] for day in (1, 2, 3)]
        means = [(sum(r[2] for r in x) / len(x), sum(r[3] for r in x) / len(x)) for x in days]
        assert means == sorted(means)
        nearest = [min((1, 2, 3), key=lambda day: (r[2] - means[day - 1][0]) ** 2 + (r[3] - means[day - 1][1]) ** 2) for r in mine]
        assert sum(n != got[r[0]] for n, r in zip(nearest, mine, strict=True)) <= 0.002 * len(mine)


def test_events(spark):
    steps = spark.createDataFrame([("a", s, v) for s, v in enumerate([9, 9, 1, 9, 9, 9])], "k string, s bigint, v int")
    assert [tuple(r) for r in events.held(steps, ["k"], "s", F.col("v") > 5, 3).collect()] == [("a", 3, 5, 3)]
    alerts = spark.createDataFrame([("x", "critical"), ("x", "warning"), ("y", "warning")], "s string, v string")
    assert sorted(map(tuple, events.inhibited(alerts, "s", "v").collect())) == [("x", "critical"), ("y", "warning")]
    raw = spark.createDataFrame([('{"event_type": "t", "event_time": "1970-01-01T00:00:01Z", "payload": {"city": "PARIS", "weather": {"rain": "x"}}}',), ("{}",), ("[1]",), ("{",), (None,)], "value string")
    good, bad = events.split_payloads(raw, "value")
    assert bad.count() == 3
    got = sorted(events.flatten(good, "value").select("event_type", "city", "rain", F.unix_seconds("event_time").alias("t")).collect(), key=str)
    assert got == [Row(event_type="t", city="paris", rain=None, t=1), Row(event_type="unknown", city=None, rain=None, t=None)]


def test_archives(spark, tmp_path):
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/a.zip", "w") as z:
        z.writestr("objects/1.json", '[{"a": 1}, 2, {"a": 2}]')
        z.writestr("objects/2.json", '{"a": 3}')
        z.writestr("objects/bad.json", "{")
        z.writestr("other/3.json", '{"a": 4}')
    (tmp_path / "z/b.zip").write_bytes(b"no archive")
    got = archives.scan_zip(spark, str(tmp_path / "z")).select(F.get_json_object("document", "$.a").alias("a")).collect()
    assert sorted(r.a for r in got) == ["1", "2", "3"]
    (tmp_path / "one.json").write_text('[{"a": 5}]')
    assert archives.scan_json(spark, str(tmp_path / "one.json")).count() == 1
    known = spark.createDataFrame([("a", "t1", "e1", "m1", "t1"), ("b", "t1", "e1", "m1", None), ("c", "t1", "e1", "m1", "t1")], "archive string, token string, etag string, modified string, ingested_token string")
    remote = spark.createDataFrame([("a", "t2", "e1", "m2"), ("b", "t1", "e1", "m1"), ("c", "t2", "e2", "m2"), ("d", "t", "e", "m")], "archive string, token string, etag string, modified string")
    assert sorted(map(tuple, archives.unchanged(remote, known).collect())) == [("a", True, "etag"), ("b", False, "token"), ("c", False, "new"), ("d", False, "new")]
    merged = archives.merged_metadata(known.select("archive", "etag"), spark.createDataFrame([("a", None, "x"), ("n", "e9", "y")], "archive string, etag string, size string"), "archive")
    assert sorted(map(tuple, merged.select("archive", "etag", "size").collect()), key=str) == [("a", "e1", "x"), ("b", "e1", None), ("c", "e1", None), ("n", "e9", "y")]
    assert io and isinstance(archives.documents_of("x", b"[" * 100_000), list)


def test_files_and_archives_of_documents(spark, tmp_path):
    one = {"@id": "a", "dc:identifier": 5, "x": [{"y": "l1\nl2 é"}]}
    texts = [json.dumps(one), json.dumps(one, indent=2), json.dumps(one, indent=1).replace("\n", "\r\n"), json.dumps([one, 3, one]), '{"@id": "\\ud800"}', "{", "", '{"@id": "t"} tail']
    rows = spark.createDataFrame([(f"f{i}.json", t) for i, t in enumerate(texts)], "name string, text string")
    archives.write_files(rows, f"{tmp_path}/files")
    got = [json.loads(r.document) for r in archives.scan_json(spark, f"{tmp_path}/files").collect()]
    assert sum(d == one for d in got) == 5 and len(got) == 6
    packed = rows.select(F.lit("a.zip").alias("archive"), F.concat(F.lit("objects/"), "name").alias("member"), "text").unionByName(spark.createDataFrame([("b.zip", "objects/x.json", '{"@id": "z"}'), ("b.zip", "else.json", "{}")], "archive string, member string, text string"))
    archives.write_zips(packed, f"{tmp_path}/zips")
    (tmp_path / "zips/c.zip").write_bytes(b"no archive")
    for size in (64 << 20, 1):
        got = sorted((r.archive.rsplit("/", 1)[1], json.loads(r.document)["@id"]) for r in archives.scan_zip(spark, f"{tmp_path}/zips", bytes_per_part=size).collect())
        assert got == sorted([("a.zip", "a")] * 5 + [("a.zip", "\ud800"), ("b.zip", "z")])
    whole = (tmp_path / "zips/b.zip").read_bytes()
    at = whole.index(b"objects/x.json") + 14
    (tmp_path / "zips/b.zip").write_bytes(whole[:at] + bytes(8) + whole[at + 8 :])  # a member is damaged
    assert {r.archive.rsplit("/", 1)[1] for r in archives.scan_zip(spark, f"{tmp_path}/zips").collect()} == {"a.zip"}


def test_scan_json_docs_on_table(spark):
    where = "/root/testdata/sf0.01"
    texts = [r.raw_payload for r in raw_documents.delivered(spark, where).collect()]
    want = sorted(json.loads(d)["@id"] for t in texts for d in archives.documents_of("", t or ""))
    got = sorted(r.id for r in raw_documents.scan_json_docs(spark, where).collect() for _ in range(r.documents))
    assert got == want and any("\n" in (t or "").strip() for t in texts)
    cut.clear_scratch(spark)
    assert not cut._SCRATCH


def test_canonical_hash(spark):
    import hashlib

    a = '{"b": {"y": 1, "x": "é"}, "a": [1.5, null]}'
    want = hashlib.sha256(rb'{"a": [1.5, null], "b": {"x": "\u00e9", "y": 1}}').hexdigest()
    assert values(spark, documents.canonical_hash, [a, '{ "a":[1.5,null],"b":{"x":"\\u00E9","y":1} }', "{", None, "[" * 100_000]) == [want, want, None, None, None]


def test_config_and_parameters(tmp_path):
    (tmp_path / "c.toml").write_text('[fields.texts]\nname = "rdfs:label"\n[fields.numbers]\nlat = ["a.b", "c"]\n')
    assert config.field_paths(config.load_config(str(tmp_path / "c.toml"))) == ({"name": ["rdfs:label"]}, {"lat": ["a.b", "c"]})
    (tmp_path / "c.json").write_text('{"fields": {"texts": {}}}')
    with pytest.raises(ValueError, match="numbers"):
        config.field_paths(config.load_config(str(tmp_path / "c.json")))
    assert quality.within("days", 50, 1, 50) == 50 and quality.given("city", "x") == "x"
    for bad in (0, 51, True, "3", 2.0):
        with pytest.raises(ValueError, match="days"):
            quality.within("days", bad, 1, 50)
    with pytest.raises(ValueError, match="city"):
        quality.given("city", " ")


def test_weather(spark):
    def get(url, timeout):
        if "latitude=9.0" in url:
            raise OSError("no answer")
        return b'{"current": {"temperature_2m": 12, "rain": 0.5, "weather_code": null}}' if "latitude=1.5" in url and timeout == 10 else b"[]"

    points = spark.createDataFrame([("a", 1.5, 2.0), ("b", 9.0, 2.0), ("c", None, 2.0), ("d", 3.0, 3.0)], "city string, lat double, lon double")
    got = {r.city: (r.temperature_2m, r.rain, r.weather_code, r.failed) for r in weather.current_weather(points, "http://w", get).collect()}
    assert got == {"a": (12.0, 0.5, None, False), "b": (None, None, None, True), "c": (None, None, None, True), "d": (None, None, None, True)}


def test_counters_and_histograms(spark):
    samples = spark.createDataFrame([("a", 0, 5), ("a", 10, 8), ("a", 20, 2), ("a", 30, 2), ("b", 10, 7), ("b", 25, 9)], "k string, t bigint, v bigint")
    steps = spark.createDataFrame([(10,), (25,), (31,), (99,)], "at bigint")
    got = {(r.k, r["at"]): r.increase for r in events.increases(samples, ["k"], "t", "v", steps, "at", 15).collect()}
    assert got == {("a", 10): 3, ("a", 25): 2, ("a", 31): 2, ("b", 10): 0, ("b", 25): 2, ("b", 31): 2}
    rows = spark.createDataFrame([("a", v) for v in (0.5, 1.0, 3.0, 4.0)] + [("b", 99.0), ("b", None), ("c", -1.0)], "k string, v double")
    buckets = events.cumulative_buckets(rows, ["k"], F.col("v"), [1, 5])
    assert sorted(map(tuple, buckets.collect())) == [("a", 1.0, 2), ("a", 5.0, 4), ("a", float("inf"), 4), ("b", float("inf"), 1), ("c", 1.0, 1), ("c", 5.0, 1), ("c", float("inf"), 1)]
    full = buckets.unionByName(spark.createDataFrame([("b", 1.0, 0), ("b", 5.0, 0)], "k string, le double, n bigint"))
    assert {r.k: r.quantile for r in events.histogram_quantile(full, ["k"], 0.75).collect()} == {"a": 3.0, "b": 5.0, "c": 0.75}


def test_gold_keeps_what_it_has(spark, tmp_path):
    out = f"{tmp_path}/gold"
    rows = spark.createDataFrame([(1, 1, 2), (2, 3, None)], "id int, u int, m int")
    assert changes.rebuild_needed(rows.where("id = 1"), "u", "m", False) and not changes.rebuild_needed(rows.where("id = 1"), "u", "m", True) and changes.rebuild_needed(rows, "u", "m", True)
    assert changes.replace_unless_empty(rows, out) and not changes.replace_unless_empty(rows.limit(0), out) and spark.read.parquet(out).count() == 2
    assert changes.replace_unless_empty(rows.limit(1), out) and spark.read.parquet(out).count() == 1


def test_models(spark, tmp_path):
    src = {"rows": spark.range(4)}
    got = models.build(spark, src, {"b": "select sum(id) as s from {a}", "a": "select id from {rows} where id > 1"}, {"b"}, str(tmp_path))
    assert got["b"].collect()[0].s == 5 and (tmp_path / "b").exists() and not (tmp_path / "a").exists()
    for bad in ({"a": "select * from {nope}"}, {"a": "select * from {b}", "b": "select * from {a}"}, {"rows": "select 1"}):
        with pytest.raises(ValueError, match="circle|unknown"):
            models.build(spark, src, bad, set(), str(tmp_path))


def test_exposition(spark):
    df = spark.createDataFrame([("a\\b", 'x"y\nz', 3), (None, "", 4)], "k string, l string, n int")
    assert [r.line for r in events.exposition(df, "m", ["k", "l"], "n").collect()] == ['m{k="a\\\\b",l="x\\"y\\nz"} 3', 'm{k="",l=""} 4']


def test_an_empty_table_keeps_its_schema(spark, tmp_path):
    df = spark.createDataFrame([], "id string, n int")
    df.write.parquet(f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").dtypes == df.dtypes


def test_wanted_or_all(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "city string, id int")
    assert sorted(r.id for r in planner.wanted_or_all(df, ["city"], F.col("id") == 2).collect()) == [2, 3, 4]


def test_counts_of_a_stream_and_its_end(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("t", 0, o, json.dumps({"event_type": "a", "event_time": "2024-01-01T00:00:00Z"})) for o in (1, 1, 2)] + [("t", 0, 3, "broken")]
    spark.createDataFrame(rows, intake.SCHEMA).write.parquet(src)
    intake.running_counts(intake.read_messages(spark, "parquet", src), f"{out}/n", f"{out}/c").awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{out}/n").collect()] == [("t", "a", 2)]
    query = intake.read_messages(spark, "parquet", src).writeStream.format("noop").option("checkpointLocation", f"{out}/c2").start()
    intake.stop(query, 20)
    assert not query.isActive


def test_stream_takes_each_message_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    message = lambda o, v: ("t", 0, o, v)
    first = [message(1, '{"event_type": "a"}'), message(1, '{"event_type": "a"}'), message(2, "broken")]
    second = [message(1, '{"event_type": "a"}'), message(3, '{"event_type": "b"}')]
    for rows in (first, second):
        spark.createDataFrame(rows, intake.SCHEMA).write.mode("append").parquet(src)
        intake.intake(intake.read_messages(spark, "parquet", src), f"{out}/e", f"{out}/d", f"{out}/c").awaitTermination()
    assert sorted((r.offset_value, r.event_type) for r in spark.read.parquet(f"{out}/e").collect()) == [(1, "a"), (3, "b")]
    assert spark.read.parquet(f"{out}/d").count() == 1
