"""Records at the same postal address, written differently.

An address is parsed into components: house number, its suffix, kind of street,
title, core name, postal code and city. Records are then compared in sorted neighbourhoods, in passes over differing
orders of the components; a record with many copies is one entry, so a hot address takes no room in a window.

* Passes *city* and *street*: all spellings of cities, and of street names, each with its number of records.
* Pass *city, street*: the street names of each place, where place is the settled city, or the city that most records with the postal code name.
* Pass *city, number, street*: the records at each house number of a place.

Each pass sorts forwards and backwards by letters (the last one also from the middle). A window reaches as far as
neighbours share the half of the shorter name (a third where two edits are borne), so it has no fixed width: one edit leaves the beginning
or the end of a name whole, two edits the beginning, the end or the middle, and the two spellings meet in one of the orders. Windows are spread over the
cluster by what they share. Two entries of a window are scored by edit distance, a swap of neighbouring letters
counting as one edit; one edit takes three letters, two (at one house number only) take eight. In the first three passes a spelling stands for
the near one with most records, if that has clearly more. In the last pass, numbers and
suffixes must be equal, kinds of street equal or missing, titles equal or missing; a missing kind is the one that most records of the number and street have.

Defined results: null, blank and numberless addresses, and those without city
and postal code, match nothing; building parts, floors, courtyards and post
boxes are left out; ``B`` and ``T`` stand for ``bis`` and ``ter``; repeated rows
give one pair; an id with different rows matches by any of them; an empty table
gives no rows; extra columns are ignored.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.plans.cut import cut

# Kinds of street and titles with their usual abbreviations.
KINDS = {
    "rue": "rue r",
    "avenue": "avenue av ave",
    "boulevard": "boulevard bd bld blvd boul bvd",
    "place": "place pl plc",
    "square": "square sq",
    "quai": "quai qu q",
    "chemin": "chemin ch che chem cem",
    "route": "route rte rt",
    "impasse": "impasse imp",
    "allee": "allee allees all al",
    "cours": "cours crs",
    "passage": "passage pass psg",
    "sentier": "sentier sent",
    "esplanade": "esplanade esp",
    "faubourg": "faubourg fbg fg",
    "ruelle": "ruelle rle",
    "voie": "voie",
    "villa": "villa",
    "cite": "cite",
    "montee": "montee mte",
    "promenade": "promenade prom",
    "residence": "residence",
}
TITLES = {
    "marechal": "marechal mal mar",
    "general": "general gen gal",
    "docteur": "docteur dr doc",
    "professeur": "professeur prof pr",
    "capitaine": "capitaine cap cne capt",
    "colonel": "colonel col",
    "commandant": "commandant cdt",
    "lieutenant": "lieutenant lt",
    "president": "president pdt pres",
    "abbe": "abbe ab",
    "saint": "saint st",
    "sainte": "sainte ste",
}
LINKS = "de du des d la le les l et a au aux en sur sous"
PARTS = (
    r"\b(?:batiment|bat|immeuble|imm|bloc|escalier|esc|entree|ent|porte|appartement|appt|apt|hall|tour)\b\.?\s*(?:[a-z]|\d{1,3}[a-z]?)\b"
    r"|\bresidence annexe\b|\brdc\b|\brez[- ]de[- ]chaussee\b"
    r"|\b\d{1,2}\s*(?:er|ere|e|eme|nd|nde)?\s*(?:etage|et)\b\.?"
    r"|\bcour\s+(?:interieure|arriere|anglaise|[a-z])\b"
    r"|\b(?:bp|cs|tsa|boite postale)\s*n?\s*\d+\b"
)
SUFFIXES = {"b": "bis", "t": "ter"}


def _parser():
    """A function from address, postal code and city to components; all its tables are built once per task."""
    import re
    import unicodedata

    kinds = {a: k for k, v in KINDS.items() for a in v.split()}
    titles = {a: k for k, v in TITLES.items() for a in v.split()}
    links = set(LINKS.split())
    parts = re.compile(PARTS)
    zipped = re.compile(r"(?<!\d)(?:f-?)?(\d{2} ?\d{3})(?!\d)")
    number = re.compile(r"(?:\bn(?:o|um|umero)?\s*[°º.]?\s*|°\s*)?(?<![a-z\d])(\d{1,4})\s*(?:(bis|ter|quater|b|t)\b(?!\s*\.))?(?![a-z\d])")
    word = re.compile(r"[a-z]+")

    def plain(s):
        s = unicodedata.normalize("NFKD", s).lower()
        s = "".join(c for c in s if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", s.replace("’", "'").replace("№", "no ")).strip()

    def place(s):
        s = re.sub(r"\bcedex\b.*", "", plain(s))
        s = re.sub(r"\bs/", "sur ", s)
        s = re.sub(r"\bst\b", "saint", re.sub(r"\bste\b", "sainte", s))
        return re.sub(r"[^a-z]", "", s) or None

    def code(s):
        d = re.sub(r"\D", "", s)
        return d.zfill(5) if len(d) in (4, 5) else None

    def near(a, b):
        """At most one edit, a swap counting as one."""
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        x, y = a[i:], b[i:]
        return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])

    def parse(address, postal, city):
        at = code(postal) if postal else None
        town = place(city) if city else None
        s = parts.sub(" , ", re.sub(r"\bcedex(?:\s+\d{1,2}\b)?", " ", plain(address)))
        rest = []
        for piece in re.split(r"[,;()]|\s-\s", s):
            z = zipped.search(piece)
            if z and len(z[1].replace(" ", "")) == 5 and not (" " in z[1] and re.search(r"\b(?:bis|ter)\b", piece)):
                at = at or z[1].replace(" ", "")
                town = town or place(zipped.sub(" ", piece))
            elif piece.strip():
                rest.append(piece)
        s = " , ".join(rest)
        m = number.search(s)
        if not m or int(m[1]) == 0:
            return None
        tail = s[m.end() :]
        suffix = SUFFIXES.get(m[2], m[2]) if m[2] else ""
        words = word.findall(f"{s[: m.start()]} , {tail}".replace("'", " "))
        kind, title, core = "", "", []
        for i, w in enumerate(words):
            later = any(len(x) > 2 and x not in links for x in words[i + 1 :])
            if not kind and not core and not title and w in kinds and later:
                kind = kinds[w]
            elif not core and not title and w in titles and later:
                title = titles[w]
            elif w not in links or (not later and not core):
                core.append(w)
        if not kind and len(core) > 1 and len(core[0]) > 3:
            guess = next((k for k in KINDS if near(core[0], k)), "")
            if guess:
                kind, core = guess, core[1:]
        if not title and len(core) > 1 and len(core[0]) > 3:
            guess = next((k for k in TITLES if near(core[0], k)), "")
            if guess:
                title, core = guess, core[1:]
        name = "".join(core)
        if not name or not (at or town):
            return None
        return int(m[1]), suffix, kind, title, name, at, town

    return parse


PARSED = "number int, suffix string, kind string, title string, name string, postal string, town string"


def parsed(df: DataFrame, key: str, address: str, postal: str, city: str) -> DataFrame:
    """``id`` and the components of every usable address."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parse = _parser()
        kinds = [pa.int32(), *[pa.string()] * 6]
        for batch in batches:
            ids, *texts = (c.to_pylist() for c in batch.columns)
            found = [(i, p) for i, a, z, c in zip(ids, *texts, strict=True) if (p := parse(a, z, c))]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), *(pa.array([p[k] for _, p in found], t) for k, t in enumerate(kinds))], names=["id", *names])

    rows = df.where(F.col(key).isNotNull() & F.col(address).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(address).alias("address"), F.col(postal).cast("string").alias("postal"), F.col(city).alias("city"))
    return rows.mapInArrow(run, f"id string, {PARSED}")


def _edits():
    """A function from two spellings and a limit to whether they are at most that many edits apart."""

    def within(a, b, most):
        if a == b:
            return True
        if abs(len(a) - len(b)) > most:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        a, b = a[i:], b[i:]
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        if most == 1 or not a or not b:
            return max(len(a), len(b)) <= most or (len(a) == len(b) == 2 and a == b[::-1])
        before, last = [], list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    d = min(d, before[j - 2] + 1)
                row.append(d)
            if min(row) > most:
                return False
            before, last = last, row
        return last[-1] <= most

    return within


#: Letters that one edit and two edits take; a spelling shorter than ``SHORT`` gives way only to one ``SURE`` times as common.
LEAST, LEAST_TWO, SHORT, SURE = 3, 8, 6, 10


def respelled(spellings: DataFrame) -> DataFrame:
    """Of ``g`` (what is compared with one another), ``w`` (spelling), ``n`` (records), ``few``, ``ratio``: ``g``, ``w``, ``right`` for spellings that stand for another one.

    A spelling gives way to a near one with more records (on a tie to the smaller); one with at least ``few``
    records only to one with ``ratio`` times as many.
    """

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        within = _edits()
        names = ["g", "w", "o", "n"]

        def window(rows):
            out = []
            for k, (g, w, n, few, ratio, home) in enumerate(rows):
                for _, v, m, *_, home_too in rows[k + 1 :]:
                    if (home or home_too) and v != w and within(w, v, 1):
                        (weak, a), (strong, b) = sorted(((w, n), (v, m)), key=lambda x: (x[1], [-ord(c) for c in x[0]]))
                        enough = max(ratio, SURE) if min(len(w), len(v)) < SHORT else ratio
                        if (a < few and min(len(w), len(v)) >= SHORT) or b >= enough * a:
                            out.append((g, weak, strong, b))
            return out

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=names)

        key, rows, found = None, [], []
        for batch in batches:
            for *own, g, w, n, few, ratio, home in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (*own, g) != key:
                    found += window(rows)
                    key, rows = (*own, g), []
                rows.append((g, w, n, few, ratio, home))
            if len(found) > 10_000:
                yield packed(found)
                found = []
        found += window(rows)
        if found:
            yield packed(found)

    # a spelling is at home among those of its length, and a guest among those that are a letter shorter
    size = lambda guest: F.length("w") - guest
    entry = lambda v, turned, guest: F.struct(F.lit(turned).alias("turned"), size(guest).alias("size"), F.substring(v, F.lit(1), F.floor((size(guest) - 1) / 2).cast("int")).alias("shared"), F.lit(guest == 0).alias("home"))
    entries = F.array(*(entry(v, turned, guest) for turned, v in ((False, F.col("w")), (True, F.reverse("w"))) for guest in (0, 1)))
    spread = spellings.select("g", "w", "n", "few", "ratio", F.explode(entries).alias("e")).select("e.turned", "e.size", "e.shared", "g", "w", "n", "few", "ratio", "e.home").where(F.col("size") >= LEAST)
    window = ["g", "turned", "size", "shared"]
    near = spread.repartition(*window).sortWithinPartitions(*window, "w").mapInArrow(compare, "g string, w string, o string, n bigint")
    found = near.groupBy("g", "w").agg(F.max(F.struct("n", "o")).alias("x")).select("g", "w", F.col("x.o").alias("right"))
    found = cut(found)
    # the spelling it stands for may itself give way
    again = found.select("g", F.col("w").alias("right"), F.col("right").alias("further"))
    return found.join(again, ["g", "right"], "left").select("g", "w", F.coalesce("further", "right").alias("right"))


DOOR = ["place", "number", "suffix"]
RECORD = [*DOOR, "name", "kind", "title"]


def settled(records: DataFrame, few: int = 5, ratio: int = 5) -> DataFrame:
    """Of ``RECORD`` columns, ``n`` (records) and ``street_n`` (records of the place, name and kind): ``RECORD`` and ``own_name``, ``own_kind``, those that the record stands for.

    The records of one house number of one place are compared in windows of three orders of their names.
    """

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        within = _edits()
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 6]

        def near_names(names):
            """Pairs of spellings that share a third of the shorter one in one of the orders, and are near."""
            pairs, windows = set(), {}
            for w in names:
                for size in range(max(LEAST, len(w) - 2), len(w) + 1):  # at home among its length, a guest among shorter ones
                    third = size // 3
                    middle = size // 2 - third // 2
                    windows.setdefault((size, w[:third], 0), []).append(w)
                    windows.setdefault((size, w[::-1][:third], 1), []).append(w)
                    for shift in (-1, 0, 1):
                        windows.setdefault((size, w[middle + shift : middle + shift + max(1, third - 1)], 2), []).append(w)
            for shared in windows.values():
                ordered = sorted(set(shared))
                pairs.update((a, b) for k, a in enumerate(ordered) for b in ordered[k + 1 :])
            return [(a, b) for a, b in pairs if within(a, b, 2 if min(len(a), len(b)) >= LEAST_TWO else 1)]

        def door(rows):
            count: dict = {}
            for *r, n, _ in rows:
                count[r[3]] = count.get(r[3], 0) + n
            best: dict = {}
            for a, b in near_names(count):
                weak, strong = sorted((a, b), key=lambda x: (count[x], [-ord(c) for c in x]))
                enough = max(ratio, SURE) if min(len(a), len(b)) < SHORT else ratio
                if (count[weak] < few and min(len(a), len(b)) >= SHORT) or count[strong] >= enough * count[weak]:
                    best[weak] = max(best.get(weak, (0, "")), (count[strong], strong))
            right = {w: x[1] for w, x in best.items()}
            told = {w: right.get(right.get(w, w), right.get(w, w)) for w in count}
            usual: dict = {}
            for *r, n, street in rows:
                if r[4]:
                    own = usual.setdefault(told[r[3]], {}).setdefault(r[4], [0, 0])
                    own[0] += n
                    own[1] = max(own[1], street)
            most = {w: max(k, key=lambda x: (*k[x], x)) for w, k in usual.items()}
            return [(*r, told[r[3]], r[4] or most.get(told[r[3]], "")) for *r, _, _ in rows]

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=[*RECORD, "own_name", "own_kind"])

        key, rows, found = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    found += door(rows)
                    key, rows = row[:3], []
                rows.append(row)
            if len(found) > 10_000:
                yield packed(found)
                found = []
        found += door(rows)
        if found:
            yield packed(found)

    kinds = "place string, number int, suffix string, name string, kind string, title string, own_name string, own_kind string"
    return records.select(*RECORD, "n", "street_n").repartition(*DOOR).sortWithinPartitions(*DOOR).mapInArrow(compare, kinds)


def resolved(df: DataFrame, key: str = "id", address: str = "address", postal: str = "postal_code", city: str = "city") -> DataFrame:
    """``id``, ``place``, ``number``, ``suffix``, ``name``, ``kind``, ``title`` of every usable address, in settled spellings.

    An address whose city and postal code point to different places comes out for both.
    """
    raw = cut(parsed(df, key, address, postal, city).distinct())
    told = lambda c, g, few, ratio: raw.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(g).alias("g"), "w", "n", F.lit(few).alias("few"), F.lit(ratio).alias("ratio"))
    # a street name of the whole table gives way only to one that is far more common anywhere
    right = cut(respelled(told("name", "street", 0, 50).unionByName(told("town", "city", 5, 5))))
    of = lambda g, c: right.where(F.col("g") == g).select(F.col("w").alias(c), F.col("right").alias(f"{c}_right"))
    rows = raw.join(of("street", "name"), "name", "left").join(of("city", "town"), "town", "left")
    rows = cut(rows.select("id", "number", "suffix", "kind", "title", "postal", F.coalesce("name_right", "name").alias("name"), F.coalesce("town_right", "town").alias("town")))
    # the place of a postal code is the city that most records with this code name
    codes = rows.where("postal is not null and town is not null").groupBy("postal", "town").agg(F.count(F.lit(1)).alias("c")).groupBy("postal").agg(F.max_by("town", F.struct("c", "town")).alias("of_code"))
    places = F.array_distinct(F.array_compact(F.array(F.coalesce("of_code", "postal"), "town")))
    placed = rows.join(codes, "postal", "left").select("id", F.explode(places).alias("place"), *RECORD[1:])
    streets = placed.groupBy(F.col("place").alias("g"), F.col("name").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("g", "w", "n", F.lit(5).alias("few"), F.lit(5).alias("ratio"))
    right = respelled(streets).select(F.col("g").alias("place"), F.col("w").alias("name"), F.col("right").alias("name_right"))
    fixed = cut(placed.join(right, ["place", "name"], "left").select("id", *DOOR, F.coalesce("name_right", "name").alias("name"), "kind", "title").distinct())
    kinds = fixed.where("kind <> ''").groupBy("place", "name", "kind").agg(F.count(F.lit(1)).alias("street_n"))
    records = fixed.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n")).join(kinds, ["place", "name", "kind"], "left").withColumn("street_n", F.coalesce("street_n", F.lit(0)))
    return fixed.join(settled(records), RECORD).select("id", *DOOR, F.col("own_name").alias("name"), F.col("own_kind").alias("kind"), "title").distinct()


def matches(df: DataFrame, key: str = "id", address: str = "address", postal: str = "postal_code", city: str = "city") -> DataFrame:
    """``id_a``, ``id_b`` (smaller first): distinct keys at one and the same address."""
    final = resolved(df, key, address, postal, city)
    same = [*DOOR, "name", "kind"]
    one, two = (final.select(F.col("id").alias(f"id_{x}"), *same, F.col("title").alias(f"title_{x}")) for x in "ab")
    agree = lambda c: (F.col(f"{c}_a") == F.col(f"{c}_b")) | (F.col(f"{c}_a") == "") | (F.col(f"{c}_b") == "")
    return one.join(two, same).where((F.col("id_a") < F.col("id_b")) & agree("title")).select("id_a", "id_b").distinct()
