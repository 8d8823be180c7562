"""Values out of documents whose shape varies, as expressions on VARIANT.

A path is names and positions joined by dots. A name on a list takes the list's
first element; JSON null counts as missing. Each step binds its value once, so a
path of n steps is an expression of size n.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("fr", "en")


def document(text: Column) -> Column:
    """The parsed document, null where the text isn't readable or isn't an object."""
    v = F.try_parse_json(text)
    return F.when(kind(v) == "OBJECT", v)


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, …: the outermost type."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _bound(v: Column, f) -> Column:
    """``f(v)`` with ``v`` computed once."""
    return F.element_at(F.transform(F.array(v), f), 1)


def _quoted(name: str) -> str:
    return "['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _either(first: str, second: str):
    return lambda x: F.coalesce(F.try_variant_get(x, first, "variant"), F.try_variant_get(x, second, "variant"))


def at(v: Column, path: str) -> Column:
    """The value at a path, as VARIANT; null if missing."""
    for step in path.split("."):
        key = f"${_quoted(step)}"
        first, second = (f"$[{step}]", key) if step.isdigit() else (key, f"$[0]{_quoted(step)}")
        v = _bound(v, _either(first, second))
    return _bound(v, lambda x: F.when(~F.is_variant_null(x), x))


def text_of(v: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The preferred text: a text is itself, a list its first element's text, an object that of its first known language; numbers have none."""

    def plain(x):
        k = kind(x)
        return F.when(k == "STRING", F.try_variant_get(x, "$", "string"))

    def flat(x):
        return F.coalesce(plain(x), plain(F.try_variant_get(x, "$[0]", "variant")))

    def read(x):
        spoken = F.coalesce(*(F.nullif(_bound(F.try_variant_get(x, f"$.{lang}", "variant"), flat), F.lit("")) for lang in languages))
        return F.when(kind(x) == "OBJECT", spoken).otherwise(flat(x))

    # a list stands for its first element
    return _bound(F.coalesce(F.try_variant_get(v, "$[0]", "variant"), v), read)


def first_text(v: Column, paths: list[str], languages: tuple[str, ...] = LANGUAGES) -> Column:
    """The first text over the paths that isn't empty."""
    return F.coalesce(*(F.nullif(text_of(at(v, p), languages), F.lit("")) for p in paths))


def first_value(v: Column, paths: list[str]) -> Column:
    """The first value over the paths, as text."""
    return F.coalesce(*(at(v, p).try_cast("string") for p in paths))


def members(v: Column) -> Column:
    """A list's elements; a lone value is a list of one; none for null."""
    return _bound(v, lambda x: F.when(kind(x) == "ARRAY", F.try_variant_get(x, "$", "array<variant>")).when(x.isNotNull() & ~F.is_variant_null(x), F.array(x)).otherwise(F.array().cast("array<variant>")))


def strings(v: Column) -> Column:
    """A text as a list of one, a list's texts, else nothing."""
    return F.transform(F.filter(F.coalesce(members(v), F.array().cast("array<variant>")), lambda x: kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
