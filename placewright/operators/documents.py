"""Trusted columns and child rows from raw place documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions import jsonpath as J
from placewright.functions.scalars import try_clock, try_iso_date, try_number

# Where each field may stand, best first. A name on a list takes its first element.
TEXT_PATHS = {
    "source_identifier": ["dc:identifier"],
    "name": ["rdfs:label"],
    "description": ["hasDescription.dc:description", "hasDescription.shortDescription", "hasDescription.rdfs:comment", "rdfs:comment"],
    "address": ["isLocatedAt.schema:address.schema:streetAddress"],
    "postal_code": ["isLocatedAt.schema:address.schema:postalCode"],
    "city": ["isLocatedAt.schema:address.hasAddressCity.rdfs:label", "isLocatedAt.schema:address.schema:addressLocality"],
    "region": ["isLocatedAt.schema:address.hasAddressCity.isPartOfDepartment.isPartOfRegion.rdfs:label"],
    "country": ["isLocatedAt.schema:address.schema:addressCountry", "isLocatedAt.schema:address.hasAddressCity.isPartOfDepartment.isPartOfRegion.isPartOfCountry.rdfs:label"],
    "contact_email": ["hasContact.schema:email", "hasBeenPublishedBy.schema:email", "hasBeenCreatedBy.schema:email"],
    "contact_phone": ["hasContact.schema:telephone", "hasBeenPublishedBy.schema:telephone", "hasBeenCreatedBy.schema:telephone"],
    "website": ["hasContact.foaf:homepage", "hasBeenPublishedBy.foaf:homepage", "hasBeenCreatedBy.foaf:homepage"],
}
NUMBER_PATHS = {"lat": ["isLocatedAt.schema:geo.schema:latitude"], "lon": ["isLocatedAt.schema:geo.schema:longitude"]}


def extract_fields(df: DataFrame, key: str, payload: str, texts: dict[str, list[str]] | None = None, numbers: dict[str, list[str]] | None = None) -> DataFrame:
    """``key`` and one column per configured field; null where a document is unreadable."""
    v = F.col("__v")
    rows = df.select(key, J.document(F.col(payload)).alias("__v"))
    return rows.select(
        key,
        *(J.first_text(v, p).alias(n) for n, p in (texts or TEXT_PATHS).items()),
        *(try_number(J.first_value(v, p)).alias(n) for n, p in (numbers or NUMBER_PATHS).items()),
    )


def extract_categories(v: Column) -> Column:
    """The texts of ``@type``."""
    return J.strings(J.at(v, "@type"))


def extract_timings(v: Column) -> Column:
    """Distinct periods with dates and clocks; a period's missing date is the document's; a document with dates but no period has one."""

    def pick(x, *names):
        return F.coalesce(*(J.first_value(x, [n]) for n in names))

    def period(x, start, end):
        return F.struct(
            F.coalesce(try_iso_date(pick(x, "startDate", "schema:startDate")), start).alias("start_date"),
            F.coalesce(try_iso_date(pick(x, "endDate", "schema:endDate")), end).alias("end_date"),
            try_clock(pick(x, "startTime", "schema:startTime")).alias("start_time"),
            try_clock(pick(x, "endTime", "schema:endTime")).alias("end_time"),
        )

    start, end = (try_iso_date(J.first_value(v, [n])) for n in ("schema:startDate", "schema:endDate"))
    kind = "array<struct<start_date:date,end_date:date,start_time:string,end_time:string>>"
    told = F.filter(F.transform(F.filter(J.members(J.at(v, "takesPlaceAt")), lambda x: J.kind(x) == "OBJECT"), lambda x: period(x, start, end)), lambda p: F.coalesce(p["start_date"].cast("string"), p["end_date"].cast("string"), p["start_time"], p["end_time"]).isNotNull())
    told = F.coalesce(told, F.array().cast(kind))
    alone = F.array(F.struct(start.alias("start_date"), end.alias("end_date"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("end_time")))
    return F.array_distinct(F.when((F.size(told) == 0) & (start.isNotNull() | end.isNotNull()), alone).otherwise(told))


def extract_prices(v: Column) -> Column:
    """Distinct (minimum, maximum, currency) of all price specifications: every minimum with every maximum."""
    none = F.array(F.lit(None).cast("string"))
    values = lambda x, n: F.transform(J.members(J.at(x, n)), lambda y: y.try_cast("string"))
    some = lambda a: F.when(F.size(a) > 0, a).otherwise(none)

    def spec(x):
        low, high, currency = values(x, "schema:minPrice"), values(x, "schema:maxPrice"), J.text_of(J.at(x, "schema:priceCurrency"))
        pairs = F.transform(some(low), lambda a: F.transform(some(high), lambda b: F.struct(try_number(a).alias("min_price"), F.coalesce(try_number(b), try_number(a)).alias("max_price"), currency.alias("currency"))))
        return F.flatten(pairs)

    offers = F.filter(J.members(J.at(v, "offers")), lambda x: J.kind(x) == "OBJECT")
    specs = F.flatten(F.transform(offers, lambda o: F.filter(F.coalesce(J.members(J.at(o, "schema:priceSpecification")), F.array().cast("array<variant>")), lambda x: J.kind(x) == "OBJECT")))
    rows = F.flatten(F.transform(specs, spec))
    return F.array_distinct(F.filter(F.coalesce(rows, F.array().cast("array<struct<min_price:double,max_price:double,currency:string>>")), lambda p: p["min_price"].isNotNull() | p["max_price"].isNotNull() | p["currency"].isNotNull()))


def canonical_hash(payload: Column) -> Column:
    """SHA-256 (hexadecimal) of a document's canonical JSON: names in order, blanks after commas and colons, only ASCII; null for what isn't readable.

    Two writings of one document have one hash. It runs in Arrow batches, since sorting names at every depth isn't an expression.
    """

    @F.pandas_udf("string")
    def hashed(texts):
        import hashlib
        import json

        import pandas as pd

        def one(t):
            try:
                return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=True).encode()).hexdigest()
            except (TypeError, ValueError, RecursionError):
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return hashed(payload)
