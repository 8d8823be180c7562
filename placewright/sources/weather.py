"""Current weather of places from an HTTP provider, one request a row, spread over the tasks."""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the provider is asked for.
VARIABLES = ["temperature_2m", "relative_humidity_2m", "precipitation", "rain", "weather_code", "wind_speed_10m", "wind_direction_10m"]


def _get(url: str, timeout: float) -> bytes:
    import urllib.request

    with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
        return r.read()


def current_weather(points: DataFrame, endpoint: str, get: Callable[[str, float], bytes] = _get, timeout: float = 10) -> DataFrame:
    """``city``, the variables as doubles, ``failed``: of each row of ``city``, ``lat``, ``lon``.

    A request that fails, or answers with something else than numbers, gives nulls and ``failed``; a row without coordinates isn't asked for.
    Cities are a short list (one row each), so a request a row is what it takes.
    """

    def ask(batches: Iterator) -> Iterator:
        import json
        import urllib.parse

        import pyarrow as pa

        for batch in batches:
            rows = []
            for city, lat, lon in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                told, failed = {}, lat is None or lon is None
                if not failed:
                    query = urllib.parse.urlencode({"latitude": lat, "longitude": lon, "current": ",".join(VARIABLES), "timezone": "auto"})
                    try:
                        told = json.loads(get(f"{endpoint}?{query}", timeout)).get("current") or {}
                        told = {v: float(told[v]) for v in VARIABLES if told.get(v) is not None}
                    except (OSError, ValueError, TypeError, AttributeError):
                        told, failed = {}, True
                rows.append((city, *(told.get(v) for v in VARIABLES), failed))
            kinds = [pa.string(), *[pa.float64()] * len(VARIABLES), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["city", *VARIABLES, "failed"])

    return points.select(F.col("city").cast("string").alias("city"), "lat", "lon").mapInArrow(ask, "city string, " + ", ".join(f"{v} double" for v in VARIABLES) + ", failed boolean")
