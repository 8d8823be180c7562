"""Points near points or in regions, by slabs of latitude.

The plane is cut into slabs by parallels, and slabs into strips by meridians, so
that neither a dense parallel nor a slab round the globe is one task. What bounds
a region inside a slab is a list of edges in order of longitude, so the slab falls into
trapezoids, and a point is located by a binary search among the slab's edges. A
region that lies between two of its edges holds the points whose trapezoids lie between them.

``near_pairs`` takes the disc around each location as a region: within a slab
a disc lies between two meridians, its left and its right edge. All discs of a slab are equally
wide, so both kinds of edges are in the same order, and the discs around a point are those between the
two places that binary search finds. Slabs are higher than the distance, so a disc
reaches no further than the slab above and the one below.

``locate`` takes polygons. A slab is cut further at the edges' ends and crossings, so that edges inside a
cut never cross; polygons may be concave, overlap, have holes and several parts, and lie across the antimeridian.

Defined results: coordinates that are null, NaN, infinite or out of range don't
count, nor does the point 0/0; locations that coincide are searched once and
their ids joined to the result; repeated rows give one pair; an empty table
gives no rows; the poles and the antimeridian are ordinary places; any distance may be asked for.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Slabs and strips are at least this high and wide (strips: at the equator); they grow with the distance.
SLAB_DEG = 0.001
STRIP_DEG = 0.02


def valid_point(lat: Column, lon: Column) -> Column:
    """Finite, in range (both ends count) and not 0/0."""
    return lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance in metres on the sphere of ``EARTH_M``."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


POINT, OWN, REPLICA = 0, 1, 2


def disc_edges(points: DataFrame, metres: float) -> DataFrame:
    """Each point where it is (kind ``POINT``), and the edges of its disc wherever the disc reaches: ``OWN`` in the point's own slab and strip, else ``REPLICA``.

    ``x`` is the centre's longitude in the frame of the strip, ``half`` the half width in degrees of a disc anywhere in or
    beside the slab, so the edges are ``x - half`` and ``x + half``; ``at`` is where a sweep from west to east meets the row.
    A disc goes to its own strip and those to the east, and to all that it reaches in the slab above: each pair once.
    """
    import math

    rad = min(metres / EARTH_M, math.pi)
    deg = math.degrees(rad) * (1 + 1e-9) + 1e-9
    slab_deg, strip_deg = max(SLAB_DEG, deg * 1.001), max(STRIP_DEG, deg * 20)
    slab = F.floor((F.col("lat") + 90) / slab_deg).cast("int")

    def frame(s: Column) -> tuple[Column, Column]:
        top = F.least(F.lit(90.0), F.greatest(F.abs(s * slab_deg - 90 - slab_deg), F.abs(s * slab_deg - 90 + 2 * slab_deg)))
        q = F.lit(math.sin(min(rad, math.pi / 2))) / F.greatest(F.cos(F.radians(top)), F.lit(1e-12))
        half = F.when(q >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(q, F.lit(1.0)))) * (1 + 1e-9) + 1e-7)
        strips = F.greatest(F.lit(1), F.floor(F.cos(F.radians(top)) * 360 / strip_deg)).cast("int")
        return half, strips

    def row(s: Column, strip: Column, x: Column, half: Column, kind: int) -> Column:
        return F.struct(s.alias("slab"), strip.alias("strip"), (x if kind == POINT else x - half).alias("at"), x.alias("x"), half.alias("half"), F.lit(kind).cast("tinyint").alias("kind"))

    def reached(s: Column, east: bool) -> Column:
        half, strips = frame(s)
        strip_of = lambda x: F.floor((x + 180) * strips / 360).cast("int")
        first, last = strip_of(F.col("lon")) + 1 if east else strip_of(F.col("lon") - half), strip_of(F.col("lon") + half)
        there = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(there, lambda t: row(s, F.pmod(t, strips), F.col("lon") - 360 * F.floor(t / strips), half, REPLICA))

    half, strips = frame(slab)
    home = F.floor((F.col("lon") + 180) * strips / 360).cast("int")
    here = F.array(row(slab, home, F.col("lon"), half, POINT), row(slab, home, F.col("lon"), half, OWN))
    none = F.array().cast("array<struct<slab:int,strip:int,at:double,x:double,half:double,kind:tinyint>>")
    above = F.when(F.col("lat") + deg >= (slab + 1) * slab_deg - 90 - 1e-9, reached(slab + 1, False)).otherwise(none)
    return points.select("lat", "lon", F.explode(F.concat(here, reached(slab, True), above)).alias("e")).select("e.*", "lat", "lon")


def _search(metres: float):
    """Of rows sorted by slab, strip and ``at``, the pairs of a point and a disc's centre within the distance; edges that a later point may lie between are carried on."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ("slab", "strip", "x", "half", "kind", "lat", "lon")
        carry: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            d = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
            new = len(d["x"])
            if carry:
                d = {n: np.concatenate([carry[n], d[n]]) for n in names}
            change = np.ones(len(d["x"]), dtype=bool)
            change[1:] = (d["slab"][1:] != d["slab"][:-1]) | (d["strip"][1:] != d["strip"][:-1])
            group = np.cumsum(change) - 1
            place = group * 4000.0 + (d["x"] + 1000.0)
            discs = np.flatnonzero(d["kind"] != POINT)
            points = np.flatnonzero(d["kind"] == POINT)
            points = points[points >= len(d["x"]) - new]
            # the slab's edges, west to east; the discs around a point begin before it and end behind it
            left, right = (place + sign * (d["half"] + 1e-7) for sign in (-1, 1))
            floor = group * 4000.0
            left, right = np.maximum(left, floor)[discs], np.minimum(right, floor + 3999.0)[discs]
            begin, end = np.searchsorted(right, place[points], "left"), np.searchsorted(left, place[points], "right")
            width = np.maximum(end - begin, 0)
            ends, at = np.cumsum(width), 0
            while at < len(points):
                base = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
                w = width[at:stop]
                total = int(w.sum())
                if total:
                    i = np.repeat(points[at:stop], w)
                    j = discs[np.arange(total) - np.repeat(np.cumsum(w) - w, w) + np.repeat(begin[at:stop], w)]
                    # of two discs at home here, the western one's counts
                    ok = (d["kind"][j] != OWN) | (d["x"][j] < d["x"][i]) | ((d["x"][j] == d["x"][i]) & (d["lat"][j] < d["lat"][i]))
                    i, j = i[ok], j[ok]
                    la, lb = np.radians(d["lat"][i]), np.radians(d["lat"][j])
                    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(d["lon"][j] - d["lon"][i]) / 2) ** 2
                    near = 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= metres
                    i, j = i[near], j[near]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(d[c][k]) for c, k in (("lat", i), ("lon", i), ("lat", j), ("lon", j))], names=["lat_a", "lon_a", "lat_b", "lon_b"])
                at = stop
            last_at = d["x"][-1] if d["kind"][-1] == POINT else d["x"][-1] - d["half"][-1]
            keep = (group == group[-1]) & (d["kind"] != POINT) & (d["x"] + d["half"] >= last_at - 1e-6)
            carry = {c: v[keep] for c, v in d.items()}

    return run


def near_coordinates(points: DataFrame, metres: float) -> DataFrame:
    """Pairs of different coordinates (``lat``, ``lon`` distinct in ``points``) within ``metres``: ``lat_a lon_a lat_b lon_b``."""
    placed = disc_edges(points, metres).repartition("slab", "strip").sortWithinPartitions("slab", "strip", "at")
    return placed.mapInArrow(_search(metres), "lat_a double, lon_a double, lat_b double, lon_b double")


def _rows(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """``id``, ``lat``, ``lon``, each once; the two writings of the antimeridian are one."""
    x = F.when(F.col(lon) == 180, -180.0).otherwise(F.col(lon) + 0.0)
    return df.where(F.col(key).isNotNull() & valid_point(F.col(lat), F.col(lon))).select(F.col(key).alias("id"), (F.col(lat) + 0.0).alias("lat"), x.alias("lon")).distinct()


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, metres: float) -> DataFrame:
    """``id_a``, ``id_b`` (smaller first): distinct keys of which some rows lie within ``metres``."""
    rows = _rows(df, key, lat, lon)
    found = near_coordinates(rows.select("lat", "lon").distinct(), metres)
    side = lambda s: rows.select(F.col("id").alias(f"id_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    apart = found.join(side("a"), ["lat_a", "lon_a"]).select("id_a", "lat_b", "lon_b").join(side("b"), ["lat_b", "lon_b"]).select("id_a", "id_b")
    same = rows.select(F.col("id").alias("id_a"), "lat", "lon").join(rows.select(F.col("id").alias("id_b"), "lat", "lon"), ["lat", "lon"]).where("id_a < id_b").select("id_a", "id_b")
    pairs = apart.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a < id_b")
    return pairs.unionByName(same).distinct()


def near_links(df: DataFrame, key: str, lat: str, lon: str, metres: float) -> DataFrame:
    """The linear form: ``id``, ``lat``, ``lon``, ``copies`` (ids at this very point), ``links`` (other points within ``metres``).

    Its size follows the input, however many ids coincide.
    """
    rows = _rows(df, key, lat, lon)
    spots = rows.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("copies"))
    found = near_coordinates(spots.select("lat", "lon"), metres).distinct()
    ends = found.select(F.explode(F.array(*(F.struct(F.col(f"lat_{s}").alias("lat"), F.col(f"lon_{s}").alias("lon")) for s in "ab"))).alias("e")).groupBy("e.lat", "e.lon").agg(F.count(F.lit(1)).alias("links"))
    return rows.join(spots.join(ends, ["lat", "lon"], "left"), ["lat", "lon"]).select("id", "lat", "lon", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def inside(edges: dict, lat, lon):
    """Which points lie in which regions: (numbers of points, edges' regions), of one slab's ``edges`` (arrays ``region``, ``x1``, ``y1``, ``x2``, ``y2``).

    Inside a cut of the slab the edges keep their order; a point's trapezoid is the number of edges to the west
    of it, by binary search. A region's edges, taken in pairs, bound intervals of trapezoids, and the points of each are a
    stretch of the points in order of trapezoid.
    """
    import numpy as np

    region, x1, y1, x2, y2 = (edges[c] for c in ("region", "x1", "y1", "x2", "y2"))
    low, high = np.minimum(y1, y2), np.maximum(y1, y2)
    slope = (x2 - x1) / (y2 - y1)
    x_at = lambda e, y: x1[e] + (y - y1[e]) * slope[e]
    points, regions = [], []

    def settle(bottom, top, mine, here):
        """The points ``here`` of one cut, whose edges ``mine`` don't cross."""
        mine = mine[np.lexsort((region[mine], x_at(mine, (bottom + top) / 2)))]
        a, b = np.zeros(len(here), dtype=np.int64), np.full(len(here), len(mine))
        while (live := a < b).any():  # all points of the cut search at once
            m = (a + b) // 2
            west = x_at(mine[np.minimum(m, len(mine) - 1)], lat[here]) <= lon[here]
            a, b = np.where(live & west, m + 1, a), np.where(live & ~west, m, b)
        order = np.argsort(a, kind="stable")
        trapezoid = a[order]
        own = np.argsort(region[mine], kind="stable")  # a region's edges, west to east
        code = region[mine[own]]
        first = np.r_[True, code[1:] != code[:-1]]
        rank = np.arange(len(own)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        closes = np.r_[np.where(first[1:], len(own), own[1:]), len(own)]  # beyond the strip where the next edge is further east
        opens = own[rank % 2 == 0]
        begin, end = np.searchsorted(trapezoid, opens, "right"), np.searchsorted(trapezoid, closes[rank % 2 == 0], "right")
        width = end - begin
        total = int(width.sum())
        if total:
            points.append(here[order[np.arange(total) - np.repeat(np.cumsum(width) - width, width) + np.repeat(begin, width)]])
            regions.append(np.repeat(region[mine[opens]], width))

    cuts = np.unique(np.concatenate([low, high]))
    row = np.searchsorted(cuts, lat, "right") - 1
    for r in np.unique(row[(row >= 0) & (row < len(cuts) - 1)]):
        bottom, top = cuts[r], cuts[r + 1]
        here, mine = np.flatnonzero(row == r), np.flatnonzero((low <= bottom) & (high >= top))
        if not len(mine):
            continue
        below, above = x_at(mine, bottom), x_at(mine, top)
        order = np.lexsort((above, below))
        below, above = below[order], above[order]
        if (np.diff(above) >= 0).all():
            settle(bottom, top, mine, here)
            continue
        crossings = []
        for k in range(len(order) - 1):  # edges that change places with this one
            o = k + 1 + np.flatnonzero((above[k + 1 :] < above[k]) & (below[k + 1 :] > below[k]))
            gap, gain = below[o] - below[k], above[k] - above[o]
            crossings.append(bottom + (top - bottom) * gap / (gap + gain))
        finer = np.unique(np.concatenate([[bottom, top], *crossings]))
        part = np.clip(np.searchsorted(finer, lat[here], "right") - 1, 0, len(finer) - 2)
        for q in np.unique(part):
            settle(finer[q], finer[q + 1], mine, here[part == q])
    if not points:
        return np.empty(0, dtype=np.int64), region[:0]
    return np.concatenate(points), np.concatenate(regions)


def region_edges(regions: DataFrame) -> DataFrame:
    """``region_id``, ``y1``, ``x1``, ``y2``, ``x2``, ``east`` (the ring's eastern end) of all rings, unrolled across the antimeridian and repeated where they reach over it."""

    @F.pandas_udf("array<double>")
    def unrolled(lons):
        import numpy as np

        return lons.map(lambda x: x if x is None else np.unwrap(np.asarray(x, dtype=float), period=360))

    usable = F.forall("ring", lambda p: F.coalesce(p["lat"].between(-90, 90) & p["lon"].between(-1e6, 1e6), F.lit(False)))
    rings = regions.where((F.size("ring") > 2) & usable).select("region_id", "ring").distinct().select("region_id", F.transform("ring", lambda p: p["lat"]).alias("y"), unrolled(F.transform("ring", lambda p: p["lon"])).alias("x"))
    y, x = F.col("y"), F.col("x")
    west, east = F.array_min("x"), F.array_max("x")
    turns = F.filter(F.array(*(F.lit(t) for t in (-360.0, 0.0, 360.0))), lambda t: (east + t >= -180) & (west + t <= 180))
    after = lambda i: F.pmod(i + 1, F.size(y))
    edge = F.transform(F.sequence(F.lit(0), F.size(y) - 1), lambda i: F.struct(y[i].alias("y1"), x[i].alias("x1"), y[after(i)].alias("y2"), x[after(i)].alias("x2")))
    edges = rings.select("region_id", east.alias("east"), F.explode(turns).alias("turn"), edge.alias("e")).select("region_id", "east", "turn", F.explode("e").alias("e"))
    return edges.select("region_id", "e.y1", (F.col("e.x1") + F.col("turn")).alias("x1"), "e.y2", (F.col("e.x2") + F.col("turn")).alias("x2"), (F.col("east") + F.col("turn")).alias("east")).where("y1 <> y2")


def locate(points: DataFrame, regions: DataFrame, slab_deg: float = 0.05, strip_deg: float = 1.0, group_rows: int = 200_000) -> DataFrame:
    """The regions that contain each point: ``id``, ``region_id``.

    ``points``: ``id``, ``lat``, ``lon``; ``regions``: ``region_id``, ``ring`` (array of ``lat``, ``lon``; closed or
    not, any direction, may be concave, may overlap others; one with a missing or impossible corner is left out). Rows of one region are its rings: parts, or holes.
    Edges are half open in latitude, so a point on a shared edge of two regions is in one of them. A ring may cross the
    antimeridian (no side is half the globe long), but not go round a pole. An edge goes to the strips from its own to its ring's
    eastern end, so a strip knows all edges to the west that count. A slab and strip with more than
    ``group_rows`` points is worked on by several tasks, each with all its edges.
    """
    slab_of, strip_of = (lambda c: F.floor((c + 90) / slab_deg).cast("int")), (lambda c: F.floor((c + 180) / strip_deg).cast("int"))
    last = strip_of(F.lit(180.0))
    first, end = F.greatest(F.lit(0), strip_of(F.least("x1", "x2"))), F.least(last, strip_of(F.col("east")))
    strips = F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<int>"))
    spread = region_edges(regions).select("region_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(slab_of(F.least("y1", "y2")), slab_of(F.greatest("y1", "y2")))).alias("slab"), strips.alias("s")).select("*", F.explode("s").alias("strip")).drop("s")
    there = points.where(valid_point(F.col("lat"), F.col("lon"))).select("id", "lat", "lon", slab_of(F.col("lat")).alias("slab"), strip_of(F.col("lon")).alias("strip"))
    load = there.groupBy("slab", "strip").agg(F.ceil(F.count(F.lit(1)) / group_rows).cast("int").alias("parts"))
    salted = there.join(load, ["slab", "strip"]).withColumn("salt", F.pmod(F.xxhash64("id", "lat", "lon"), F.col("parts")).cast("int"))
    copied = spread.join(load, ["slab", "strip"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def work(p, e):
        import numpy as np
        import pandas as pd

        code, names = pd.factorize(e.region_id)
        names = np.asarray(names)
        i, r = inside({"region": code, **{c: e[c].to_numpy(dtype=float) for c in ("x1", "y1", "x2", "y2")}}, p.lat.to_numpy(dtype=float), p.lon.to_numpy(dtype=float))
        return pd.DataFrame({"id": p.id.to_numpy()[i], "region_id": names[r]})

    schema = f"id {dict(points.dtypes)['id']}, region_id {dict(regions.dtypes)['region_id']}"
    group = ["slab", "strip", "salt"]
    return salted.drop("parts").groupBy(*group).cogroup(copied.drop("parts").groupBy(*group)).applyInPandas(work, schema)
