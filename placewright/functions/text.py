"""Text expressions that stay inside the JVM."""

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the sense of Unicode, and the four separators that ``str.strip`` drops too.
BLANK = r"[\p{IsWhite_Space}\x{1c}-\x{1f}]"


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind; Spark's ``trim`` knows only the space."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """Letters that canonically decompose to a base letter and marks, and these base letters, both lower case.

    The table follows from Unicode's own decompositions, so it isn't written out.
    """
    source, target = [], []
    for n in range(0xC0, sys.maxunicode + 1):
        ch = chr(n)
        if ch != ch.lower() or 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3:
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch and base.isalpha():
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """Lower case, without accents, whether composed or not."""
    source, target = accent_map()
    return F.regexp_replace(F.translate(F.lower(c), source, target), r"\p{M}+", "")


def clean_text(c: Column) -> Column:
    """Stripped text; blanks and the spelled-out missing values ``None`` and ``nan`` become null."""
    s = strip(c)
    return F.when(s.isin("", "None", "nan"), F.lit(None).cast("string")).otherwise(s)


def city_key(c: Column) -> Column:
    """A city in lower case without surrounding white space; null for null and blank."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def latest(df, keys: list[str], order: list[Column]):
    """Of several rows with the same keys, the first by ``order``."""
    from pyspark.sql import Window

    n = "__latest_rank"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)
