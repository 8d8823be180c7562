"""Scalar rules as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from placewright.functions.text import strip

EARTH_KM = 6371.0


def non_blank(c: Column) -> Column:
    """Not null and more than spaces (spaces only, as SQL's ``BTRIM`` has it)."""
    return c.isNotNull() & (F.btrim(c) != "")


def or_default(c: Column, default: str) -> Column:
    """The default for null and empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def try_number(c: Column) -> Column:
    """Text as a double; null for anything but plain decimal or scientific notation."""
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def try_iso_date(c: Column) -> Column:
    """An ISO date, or the date of an ISO timestamp; else null."""
    s = strip(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(s, 1, 10).try_cast("date"))


def try_clock(c: Column) -> Column:
    """``HH:mm:ss`` from ``HH:mm:ss`` or ``HH:mm``, else from looser writings (``9:05``, ``9:05 PM``, a whole timestamp); else null."""
    s = strip(c)
    full = F.when(s.rlike(r"^\d{2}:\d{2}$"), F.concat(s, F.lit(":00"))).when(s.rlike(r"^\d{2}:\d{2}:\d{2}$"), s)
    strict = F.when(full.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), full)
    loose = F.coalesce(*(F.try_to_timestamp(F.upper(s), F.lit(p)) for p in ("H:m", "H:m:s", "h:m a", "h:m:s a", "yyyy-MM-dd'T'HH:mm[:ss]", "yyyy-MM-dd HH:mm[:ss]")))
    return F.coalesce(strict, F.when(s.rlike(r"[0-9]:[0-9]"), F.date_format(loose, "HH:mm:ss")))


def html_escaped(c: Column) -> Column:
    """Text for HTML: the five special characters as entities."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def megabytes(c: Column) -> Column:
    """A number of bytes, as text or number, as megabytes with one digit; null for anything else."""
    n = c.try_cast("bigint")
    return F.when(n.isNotNull(), F.format_string("%.1f MB", n / F.lit(1024.0 * 1024)))


def event_instant(c: Column) -> Column:
    """An ISO instant with ``Z``, an offset or none (then UTC); else null."""
    s = strip(c)
    return F.try_to_timestamp(F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z"))))


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def contains_score(text: Column, weights: dict[str, int], base: int = 1) -> Column:
    """``base`` plus the weight of every term that the lower-case text contains."""
    t = F.lower(text)
    return sum((F.when(t.contains(k), w).otherwise(0) for k, w in weights.items()), F.lit(base)).cast("int")


def grid_cell(lat: Column, lon: Column, step: float) -> Column:
    """Key of a cell of the degree grid. Not an H3 id; ``h3_cell`` needs the h3 package on the executors."""
    return F.concat_ws(":", F.floor((lat + 90) / step).cast("string"), F.floor((lon + 180) / step).cast("string"))


def h3_cell(lat: Column, lon: Column, resolution: int = 8) -> Column:
    """H3 cell ids by an Arrow batch UDF, where the h3 package is installed."""
    import importlib.util

    if importlib.util.find_spec("h3") is None:
        raise RuntimeError("the h3 package isn't installed; use grid_cell")

    @F.pandas_udf("string")
    def cells(a, b):
        import h3
        import pandas as pd

        return pd.Series([None if x != x or y != y else h3.latlng_to_cell(x, y, resolution) for x, y in zip(a, b, strict=True)])

    return cells(lat, lon)


def normalized_terms(c: Column) -> Column:
    """Trimmed terms without blanks; of one term in several cases the first spelling stays."""
    trimmed = F.filter(F.transform(c, lambda x: F.btrim(x)), lambda x: x != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


def split_terms(c: Column) -> Column:
    """Comma-separated text as a list of trimmed terms without blanks."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.btrim(x)), lambda x: x != "")


def match_count(terms: Column, wanted: list[str]) -> Column:
    """How many of the terms are wanted, in any case."""
    lower = F.array(*(F.lit(w.lower()) for w in wanted)) if wanted else F.array().cast("array<string>")
    return F.size(F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.array_contains(lower, F.lower(x))))


def file_name_of(header: Column) -> Column:
    """The file name of a Content-Disposition header, or null."""
    return F.nullif(F.regexp_extract(header, r'(?i)filename="([^"]+)"', 1), F.lit(""))
