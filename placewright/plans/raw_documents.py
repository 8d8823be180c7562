"""Queries over raw documents, files and streams."""

from pyspark.sql import functions as F

from placewright.functions import jsonpath as J
from placewright.functions.scalars import file_name_of, try_number
from placewright.operators import documents as D, events as E
from placewright.plans.cut import scratch
from placewright.plans.core_problems import delivered
from placewright.sources import archives
from placewright.sources.tables import table
from placewright.streaming import intake

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


#: The readable documents of the last delivery, for SQL: each id's latest row, unwrapped where the payload is a text that is JSON.
DELIVERED = "dl as (select id, raw_payload from (select *, row_number() over (partition by id order by ingested_at desc nulls last, content_hash desc nulls last, raw_payload desc nulls last) rn from bronze_raw_poi where snapshot_no = 4 and id is not null) where rn = 1), dc as (select id, cast(raw_payload as json) v from dl where json_valid(raw_payload) and json_type(raw_payload) = 'OBJECT')"



def _step(v: str, step: str) -> str:
    """SQL for one step of a path: a name on a list takes the list's first element."""
    key = f"$.\"{step}\""
    first, second = (f"$[{step}]", key) if step.isdigit() else (key, f"$[0].\"{step}\"")
    return f"coalesce(json_extract({v}, '{first}'), json_extract({v}, '{second}'))"


def _at(column: str, path: str, name: str) -> str:
    """SQL columns for a path, a step each; the last is ``name`` (JSON null counts as missing)."""
    out, v = [], column
    for k, step in enumerate(path.split(".")):
        out.append(f"{_step(v, step)} as {name}_{k}")
        v = f"{name}_{k}"
    return ", ".join([*out, f"case when json_type({v}) <> 'NULL' then {v} end as {name}"])


def _text(v: str) -> str:
    """SQL for the preferred text of a value."""
    plain = lambda x: f"case when json_type({x}) = 'VARCHAR' then json_extract_string({x}, '$') end"
    flat = lambda x: f"coalesce({plain(x)}, {plain(f'json_extract({x}, {chr(39)}$[0]{chr(39)})')})"
    spoken = lambda x: "coalesce(" + ", ".join("nullif(" + flat(f"json_extract({x}, '$.{lang}')") + ", '')" for lang in J.LANGUAGES) + ")"
    one = f"coalesce(json_extract({v}, '$[0]'), {v})"
    return f"case when json_type({one}) = 'OBJECT' then {spoken(one)} else {flat(one)} end"


def _first_text(column: str, paths: list[str], name: str) -> tuple[str, str]:
    """SQL columns, and the expression of the first text over the paths that isn't empty."""
    columns = [_at(column, p, f"{name}_{k}_") for k, p in enumerate(paths)]
    return ", ".join(columns), "coalesce(" + ", ".join(f"nullif({_text(f'{name}_{k}_')}, '')" for k in range(len(paths))) + ")"


NUMBER = r"case when regexp_matches(trim({0}, ' '), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim({0}, ' ') as double) end"


def _fields_sql() -> str:
    columns, told = [], []
    for name, paths in D.TEXT_PATHS.items():
        c, e = _first_text("v", paths, f"t_{name}")
        columns.append(c)
        told.append(f"{e} as {name}")
    for name, paths in D.NUMBER_PATHS.items():
        columns += [_at("v", p, f"n_{name}_{k}") for k, p in enumerate(paths)]
        value = "coalesce(" + ", ".join(f"json_extract_string(n_{name}_{k}, '$')" for k in range(len(paths))) + ")"
        told.append(f"{NUMBER.format(value)} as {name}")
    return f"with {DELIVERED}, x as (select id, {', '.join(columns)} from (select dl.id, dc.v from dl left join dc on dc.id = dl.id)) select id, {', '.join(told)} from x"


def _members(v: str) -> str:
    """SQL for a list's members; a lone value is a list of one, null has none."""
    return f"case when json_type({v}) = 'ARRAY' then json_extract({v}, '$[*]') when json_type({v}) <> 'NULL' then [{v}] else [] end"


def docs(spark, d):
    """``id`` and the parsed document of the last snapshot."""
    return delivered(spark, d).select("id", J.document(F.col("raw_payload")).alias("v")).where("v is not null")


TEXT_A = "json_extract_string(a, '$')"


@query("json_path", f"with {DELIVERED}, x as (select id, {_at('v', 'isLocatedAt.schema:geo.schema:latitude', 'a')}, {_at('v', 'isLocatedAt.0.schema:address.schema:postalCode', 'b')}, {_at('v', '@type.0', 'c')} from dc) select id, {NUMBER.format(TEXT_A)} as lat, json_extract_string(b, '$') as postal, json_extract_string(c, '$') as first_type from x")
def json_path(spark, d):
    at = lambda p: J.at(F.col("v"), p).try_cast("string")
    return docs(spark, d).select("id", try_number(at("isLocatedAt.schema:geo.schema:latitude")).alias("lat"), at("isLocatedAt.0.schema:address.schema:postalCode").alias("postal"), at("@type.0").alias("first_type"))


@query("lang_text", f"with {DELIVERED}, x as (select id, {_at('v', 'rdfs:label', 'a')}, {_at('v', 'hasDescription.dc:description', 'b')} from dc) select id, {_text('a')} as label, {_text('b')} as description from x")
def lang_text(spark, d):
    return docs(spark, d).select("id", J.text_of(J.at(F.col("v"), "rdfs:label")).alias("label"), J.text_of(J.at(F.col("v"), "hasDescription.dc:description")).alias("description"))


@query("extract_fields", _fields_sql())
def extract_fields(spark, d):
    return D.extract_fields(delivered(spark, d), "id", "raw_payload")


@query("extract_categories", f"with {DELIVERED}, x as (select id, {_at('v', '@type', 'a')} from dc), m as (select id, unnest({_members('a')}) t from x) select id, json_extract_string(t, '$') as category from m where json_type(t) = 'VARCHAR'")
def extract_categories(spark, d):
    return docs(spark, d).select("id", F.explode(D.extract_categories(F.col("v"))).alias("category"))


def _date(v: str) -> str:
    return f"case when regexp_matches(trim({v}, ' '), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') then try_cast(substr(trim({v}, ' '), 1, 10) as date) end"


def _clock(v: str) -> str:
    return f"case when regexp_matches(trim({v}, ' '), '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$') then trim({v}, ' ') when regexp_matches(trim({v}, ' '), '^([01][0-9]|2[0-3]):[0-5][0-9]$') then trim({v}, ' ') || ':00' end"


def _timings_sql() -> str:
    names = {"sd": "startDate", "ed": "endDate", "st": "startTime", "et": "endTime"}
    picks = ", ".join(f"{_at('p', n, k + 'a')}, {_at('p', 'schema:' + n, k + 'b')}" for k, n in names.items())
    value = lambda k: f"coalesce(json_extract_string({k}a, '$'), json_extract_string({k}b, '$'))"
    steps = [
        DELIVERED,
        f"a0 as (select id, {_at('v', 'takesPlaceAt', 't')}, {_at('v', 'schema:startDate', 'ds')}, {_at('v', 'schema:endDate', 'de')} from dc)",
        f"a1 as (select id, t, {_date(DOC_S)} s, {_date(DOC_E)} e from a0)",
        f"a2 as (select id, s, e, unnest({_members('t')}) p from a1)",
        f"a3 as (select id, s, e, {picks} from a2 where json_type(p) = 'OBJECT')",
        f"a4 as (select id, coalesce({_date(value('sd'))}, s) start_date, coalesce({_date(value('ed'))}, e) end_date, {_clock(value('st'))} start_time, {_clock(value('et'))} end_time from a3)",
        "a5 as (select * from a4 where start_date is not null or end_date is not null or start_time is not null or end_time is not null)",
    ]
    alone = "select id, s, e, null, null from a1 where (s is not null or e is not null) and id not in (select id from a5)"
    return f"with {', '.join(steps)} select distinct id, start_date, end_date, start_time, end_time from a5 union all {alone}"


DOC_S, DOC_E = "json_extract_string(ds, '$')", "json_extract_string(de, '$')"


@query("extract_timings", _timings_sql())
def extract_timings(spark, d):
    return docs(spark, d).select("id", F.explode(D.extract_timings(F.col("v"))).alias("t")).select("id", "t.*")


def _prices_sql() -> str:
    steps = [
        DELIVERED,
        f"a0 as (select id, {_at('v', 'offers', 'o')} from dc)",
        f"a1 as (select id, unnest({_members('o')}) o1 from a0)",
        f"a2 as (select id, {_at('o1', 'schema:priceSpecification', 'p')} from a1 where json_type(o1) = 'OBJECT')",
        f"a3 as (select id, unnest({_members('p')}) p1 from a2)",
        f"a4 as (select id, {_at('p1', 'schema:minPrice', 'lo')}, {_at('p1', 'schema:maxPrice', 'hi')}, {_at('p1', 'schema:priceCurrency', 'cu')} from a3 where json_type(p1) = 'OBJECT')",
        f"a5 as (select id, hi, {_text('cu')} currency, unnest(case when len({_members('lo')}) > 0 then {_members('lo')} else [null] end) l from a4)",
        f"a6 as (select id, currency, l, unnest(case when len({_members('hi')}) > 0 then {_members('hi')} else [null] end) h from a5)",
        f"a7 as (select id, {NUMBER.format(JSON_L)} min_price, {NUMBER.format(JSON_H)} hi, currency from a6)",
    ]
    return f"with {', '.join(steps)} select distinct id, min_price, coalesce(hi, min_price) as max_price, currency from a7 where min_price is not null or hi is not null or currency is not null"


JSON_L, JSON_H = "json_extract_string(l, '$')", "json_extract_string(h, '$')"


@query("extract_prices", _prices_sql())
def extract_prices(spark, d):
    return docs(spark, d).select("id", F.explode(D.extract_prices(F.col("v"))).alias("p")).select("id", "p.*")


@query("scan_json_docs", f"with {DELIVERED} select json_extract_string(v, '$.\"@id\"') as id, json_extract_string(v, '$.\"dc:identifier\"') as identifier, count(*) as documents from dc group by 1, 2")
def scan_json_docs(spark, d):
    """Files of a hundred documents each, written and read again: some a list, some broken, which give nothing."""
    out = scratch(spark, "json")
    rows = delivered(spark, d).where(J.document(F.col("raw_payload")).isNotNull()).select("id", "raw_payload")
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    files = rows.groupBy(part.alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("raw_payload"), ","), F.lit("]")).alias("text"))
    archives.write_files(files.select(F.concat(F.lit("objects/"), F.col("part").cast("string"), F.lit(".json")).alias("name"), "text").unionByName(spark.createDataFrame([("objects/broken.json", '[{"@id": 1}')], "name string, text string")), out)
    value = lambda k: F.get_json_object("document", f"$['{k}']")
    return archives.scan_json(spark, out).select(value("@id").alias("id"), value("dc:identifier").alias("identifier")).groupBy("id", "identifier").agg(F.count(F.lit(1)).alias("documents"))


@query("scan_zip_json", f"with {DELIVERED} select count(*) as members, count(distinct json_extract_string(v, '$.\"@id\"')) as ids from dc")
def scan_zip_json(spark, d):
    """Archives of many members, written and read again; members outside the folder don't count."""
    out = scratch(spark, "zip")
    rows = delivered(spark, d).where(J.document(F.col("raw_payload")).isNotNull())
    part = F.pmod(F.xxhash64("id"), F.lit(8)).cast("string")
    archives.write_zips(rows.select(F.concat(F.lit("a"), part, F.lit(".zip")).alias("archive"), F.concat(F.lit("objects/"), F.md5("id"), F.lit(".json")).alias("member"), F.col("raw_payload").alias("text")), out)
    return archives.scan_zip(spark, out).agg(F.count(F.lit(1)).alias("members"), F.countDistinct(F.get_json_object("document", "$['@id']")).alias("ids"))


@query("parquet_roundtrip", "select id, name, city from silver_places where city is not null")
def parquet_roundtrip(spark, d):
    out = scratch(spark, "places")
    table(spark, d, "silver_places").where("city is not null").select("id", "name", "city").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@query("snapshot_skip", "with f as (select snapshot_no s, source_file archive, string_agg(coalesce(id, '') || '#' || coalesce(lower(content_hash), ''), ',' order by coalesce(id, '') || '#' || coalesce(lower(content_hash), '')) etag from bronze_raw_poi group by 1, 2) select r.archive, coalesce(k.etag = r.etag, false) as skip, case when k.etag = r.etag then 'etag' else 'new' end as reason from f r left join f k on k.archive = r.archive and k.s = 3 where r.s = 4")
def snapshot_skip(spark, d):
    files = table(spark, d, "bronze_raw_poi").groupBy("snapshot_no", F.col("source_file").alias("archive")).agg(F.sum(F.xxhash64("id", F.lower("content_hash")).cast("decimal(20,0)")).cast("string").alias("etag"))
    known = files.where("snapshot_no = 3").select("archive", F.lit("s3").alias("token"), "etag", F.lit(None).cast("string").alias("modified"), F.lit("s3").alias("ingested_token"))
    remote = files.where("snapshot_no = 4").select("archive", F.lit("s4").alias("token"), "etag", F.lit(None).cast("string").alias("modified"))
    return archives.unchanged(remote, known)


@query("metadata_merge", "with f as (select snapshot_no s, source_file archive, count(*) n, max(content_hash) h from bronze_raw_poi where source_file is not null group by 1, 2), o as (select archive, n as lines, h as etag from f where s = 3), w as (select archive, n as lines, case when n % 2 = 0 then h end as etag from f where s = 4) select archive, coalesce(w.lines, o.lines) as lines, coalesce(w.etag, o.etag) as etag from o full join w using (archive)")
def metadata_merge(spark, d):
    """The notes of the archives: what a delivery says, and what it doesn't say from the one before."""
    files = table(spark, d, "bronze_raw_poi").where("source_file is not null").groupBy("snapshot_no", F.col("source_file").alias("archive")).agg(F.count(F.lit(1)).alias("lines"), F.max("content_hash").alias("etag"))
    new = files.where("snapshot_no = 4").select("archive", "lines", F.when(F.col("lines") % 2 == 0, F.col("etag")).alias("etag"))
    return archives.merged_metadata(files.where("snapshot_no = 3").select("archive", "lines", "etag"), new, "archive").select("archive", "lines", "etag")


@query("header_file_name", "select distinct source_file as header, nullif(regexp_extract(source_file, '([^/]+)$', 1), '') as file_name from bronze_raw_poi where source_file is not null")
def header_file_name(spark, d):
    """The file name that a Content-Disposition header tells."""
    files = table(spark, d, "bronze_raw_poi").where("source_file is not null").select("source_file").distinct()
    header = F.concat(F.lit('attachment; FileName="'), F.substring_index("source_file", "/", -1), F.lit('"'))
    return files.select(F.col("source_file").alias("header"), file_name_of(header).alias("file_name"))


@query("list_sizes", f"with {DELIVERED}, x as (select id, {_at('v', 'offers', 'a')}, {_at('v', '@type', 'b')} from dc) select id, coalesce(len({_members('a')}), 0) as offers, coalesce(len({_members('b')}), 0) as types from x")
def list_sizes(spark, d):
    """How many members each list has; a lone value is a list of one, and what is missing has none."""
    size = lambda p: F.greatest(F.size(F.coalesce(J.members(J.at(F.col("v"), p)), F.array().cast("array<variant>"))), F.lit(0)).cast("bigint")
    return docs(spark, d).select("id", size("offers").alias("offers"), size("@type").alias("types"))


def _messages(spark, d):
    """The event table as messages in files, for streams to read."""
    out = scratch(spark, "messages")
    rows = table(spark, d, "analytics_kafka_events")
    body = E.envelope(F.col("event_type"), F.col("event_time"), F.struct("city", "selected_place_count"))
    value = F.when(F.try_parse_json("payload").isNull(), F.col("payload")).otherwise(body)
    rows.select("topic", "partition_id", "offset_value", value.alias("value")).write.parquet(out)
    return out


TAKEN = "select topic, count(*) as n from (select distinct topic, partition_id, offset_value from analytics_kafka_events where json_valid(payload)) group by topic"


@query("stream_ingest", TAKEN)
def stream_ingest(spark, d):
    out = scratch(spark, "intake")
    stream = intake.read_messages(spark, "parquet", _messages(spark, d))
    intake.intake(stream, f"{out}/events", f"{out}/dead", f"{out}/offsets").awaitTermination()
    return spark.read.parquet(f"{out}/events").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("stream_counts", "select topic, event_type, count(*) as \"count\" from (select distinct topic, partition_id, offset_value, event_type from analytics_kafka_events where json_valid(payload) and event_time is not null) group by topic, event_type")
def stream_counts(spark, d):
    out = scratch(spark, "counts")
    intake.running_counts(intake.read_messages(spark, "parquet", _messages(spark, d)), f"{out}/counts", f"{out}/offsets", "60 days").awaitTermination()
    return spark.read.parquet(f"{out}/counts")


@query("canonical_hash")
def canonical_hash(spark, d):
    """SHA-256 of each document's canonical writing: its names in order, only ASCII."""
    return delivered(spark, d).select("id", D.canonical_hash(F.col("raw_payload")).alias("hash")).where("hash is not null")
