"""Address matching and near-duplicates against brute force and hand-written cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from placewright.llm import addresses, near_dup
from placewright.llm import queries as q

SAME = [
    ("12 bis Rue du Maréchal Fitrudrabout", "01234", "Vouglai"),
    ("12 B r Mal Fitrudrabout", "1234", None),
    ("rue du Maréchal Fitrudrabout, 12BIS, 2e étage", None, "VOUGLAI CEDEX 2"),
    ("Bât. A, n°12 bis Rue Mar. Fitrudarbout - BP 12", "F-01234", "Vougalai"),
    ("Vouglai 01234, 12 bis du Maréchal Fitrudrabout", None, None),
]
OTHER = [
    ("12 Rue du Maréchal Fitrudrabout", "01234", "Vouglai"),
    ("12 ter Rue du Maréchal Fitrudrabout", "01234", "Vouglai"),
    ("12 bis Impasse du Maréchal Fitrudrabout", "01234", "Vouglai"),
    ("13 bis Rue du Maréchal Fitrudrabout", "01234", "Vouglai"),
    ("12 bis Rue du Maréchal Fitrudrabout", "55555", "Zanaipol"),
    ("12 bis Rue du Maréchal Dradrouplai", "01234", "Vouglai"),
    ("Rue du Maréchal Fitrudrabout", "01234", "Vouglai"),
    ("12 bis Rue du Maréchal Fitrudrabout", None, " "),
    ("Le Bourg", "01234", "Vouglai"),
    ("", "01234", "Vouglai"),
    (None, None, None),
]
PLACE = "id string, address string, postal_code string, city string"


def test_addresses(spark):
    rows = [(f"s{i}", *x) for i, x in enumerate(SAME)] + [(f"o{i}", *x) for i, x in enumerate(OTHER)] + [(f"t{i}", *SAME[0]) for i in range(3)] + [("s0", *SAME[0]), (None, *SAME[0])]
    rows += [(f"f{i}", f"{i + 20} Rue du Maréchal Fitrudrabout", "01234", "Vouglai") for i in range(6)]
    df = spark.createDataFrame(rows, PLACE).withColumn("number", F.lit("clash"))
    got = [tuple(r) for r in addresses.matches(df).collect()]
    same = sorted([f"s{i}" for i in range(len(SAME))] + ["t0", "t1", "t2"])
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for a in same for b in same if a < b}
    assert addresses.matches(spark.createDataFrame([], PLACE)).count() == 0


def test_long_and_odd_addresses(spark):
    odd = [("a", "9 Rue " + "x" * 50_000, "01234", "A"), ("b", "9 Rue " + "x" * 50_000, "01234", "A"), ("c", "日本 9", "01234", "A"), ("d", "9", "01234", "A"), ("e", "0 Rue Vouglaibo", "01234", "A"), ("f", "0 Rue Vouglaibo", "01234", "A")]
    assert [tuple(r) for r in addresses.matches(spark.createDataFrame(odd, PLACE)).collect()] == [("a", "b")]


def _words(name, desc, site):
    s = re.split("[?#]", re.sub(r"^\s*www\.", "", re.sub(r"^\s*[a-z][a-z0-9+.\-]*://", "", (site or "").lower())))[0]
    t = unicodedata.normalize("NFD", " ".join(x for x in (name, desc, s) if x).lower())
    return frozenset(re.findall(r"[^\W_]+", "".join(c for c in t if not unicodedata.combining(c))))


def _brute(rows):
    got = sorted({(i, w) for i, *x in rows if i is not None and (w := _words(*x))}, key=lambda x: (len(x[1]), x[0]))
    return {tuple(sorted((a[0], b[0]))) for k, a in enumerate(got) for b in got[k + 1 :] if a[0] != b[0] and 5 * len(a[1] & b[1]) >= 3 * len(a[1] | b[1])}


def test_near_duplicates_equal_brute_force(spark, root):
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/silver_places.parquet").select("id", "name", "description", "website").distinct().collect()]
    assert {tuple(r) for r in q.p4_found(spark, root).collect()} == _brute(rows)


@pytest.mark.parametrize(("cold", "seed", "how"), [(1, 1, {}), (1, 2, {"n_gram": 3}), (3, 3, {"longest": 5}), (1000, 4, {}), (1, 5, {"n_gram": 1}), (2, 6, {"hot_words": 2}), (1, 7, {"longest": 7, "n_gram": 4})])
def test_near_duplicates_hot_words(spark, cold, seed, how):
    random.seed(seed)
    rows = [(f"i{k}", " ".join(random.sample("a b c d e f g h i j k l".split(), random.randint(1, 12))), None, random.choice([None, "http://www.a.b/c?d#e", "HTTPS://x.y"])) for k in range(120)]
    rows += [("n1", None, None, None), ("n2", " ", "", None), (None, "a b", None, None), ("i3", "z", None, None), ("u1", "Éte à", None, None), ("u2", "ete a", None, None), rows[0]]
    df = spark.createDataFrame(rows, "id string, name string, description string, website string").withColumn("toks", F.lit(0))
    words = near_dup.columns_as_words(df, "id", F.col("name"), F.col("description"), near_dup.bare_site(F.col("website")))
    got = [tuple(r) for r in near_dup.near_duplicate_pairs(words, cold=cold, sketch_bits=10, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)


def test_other_thresholds_equal_brute_force(spark):
    random.seed(9)
    sets = sorted({tuple(sorted(random.sample(range(14), random.randint(1, 9)))) for _ in range(90)})
    df = spark.createDataFrame([(f"{k:03}", list(w)) for k, w in enumerate(sets)], "id string, toks array<bigint>")
    for num, den in ((1, 5), (1, 2), (4, 5)):
        want = {(f"{i:03}", f"{j:03}") for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and den * len({*a} & {*b}) >= num * len({*a} | {*b})}
        assert {tuple(r) for r in near_dup.near_duplicate_pairs(df, cold=5, num=num, den=den).collect()} == want


def test_long_and_short_sets_meet(spark):
    long = list(range(1000))
    rows = [("a", long), ("b", long[100:]), ("c", [*long[:300], *range(5000, 5700)]), ("d", long[:100]), ("e", long[:70]), ("f", long[:61]), ("g", long[:60]), ("h", long[:59]), *((f"x{k}", [k % 1000, 9000 + k]) for k in range(3000))]
    df = spark.createDataFrame(rows, "id string, toks array<bigint>")
    got = {tuple(r) for r in near_dup.near_duplicate_pairs(df, cold=2).collect()}
    assert got == {("a", "b"), ("d", "e"), ("d", "f"), ("d", "g"), ("e", "f"), ("e", "g"), ("e", "h"), ("f", "g"), ("f", "h"), ("g", "h")}


def test_sets_with_one_hash_stay_apart(spark):
    sets = spark.createDataFrame([(1, 1, [1, 2, 3]), (1, 2, [7, 8, 9, 10, 11]), (2, 3, [1, 2, 3, 4]), (3, 4, [7, 8, 9, 10]), (1, 5, [7, 8, 9, 10, 12])], "sid long, sid2 long, toks array<bigint>")
    got = sorted(tuple(r)[:4] for r in near_dup.similar_sets(sets, cold=1).collect())
    assert got == [(1, 1, 2, 3), (1, 2, 1, 5), (3, 4, 1, 2), (3, 4, 1, 5)]


def test_near_duplicates_empty(spark):
    empty = spark.createDataFrame([], "id string, toks array<bigint>")
    assert near_dup.near_duplicate_pairs(empty).count() == 0


def test_links_in_linear_form(spark):
    rows = [(f"c{k}", "a b c d e", None, None) for k in range(5)] + [("n1", "a b c d", None, None), ("n2", "a b c d e f", None, None), ("x", "y z", None, None)]
    df = spark.createDataFrame(rows, "id string, name string, description string, website string")
    got = {r.id: (r.copies, r.links) for r in near_dup.near_duplicate_links(near_dup.columns_as_words(df, "id", F.col("name"))).collect()}
    assert got == {**{f"c{k}": (5, 2) for k in range(5)}, "n1": (1, 2), "n2": (1, 2), "x": (1, 0)}
    assert len({r.class_id for r in near_dup.near_duplicate_links(near_dup.columns_as_words(df, "id", F.col("name"))).collect()}) == 4


def test_resolved_addresses(spark):
    df = spark.createDataFrame([("a", "3, r. du Gal Vouglaibor", "01234", "Trelmouville"), ("b", "3 Rue du Général Vouglaibor", None, "TRELMOUVILLE")], PLACE)
    got = addresses.resolved(df).collect()
    assert {(r.place, r.number, r.suffix, r.name, r.kind, r.title) for r in got} == {("trelmouville", 3, "", "vouglaibor", "rue", "general")} and len(got) == 2


def test_short_street_names(spark):
    rows = [(f"f{i}", f"{i + 1} Rue Foche", "01234", "Vouglai") for i in range(30)] + [("x", "12 Rue Fouche", "01234", "Vouglai"), ("y", "14 Rue Foceh", "01234", "Vouglai"), ("z", "3 Rue Roche", "01234", "Vouglai")]
    rows += [(f"m{i}", f"{i + 1} Rue Mare", "01234", "Vouglai") for i in range(9)] + [(f"g{i}", f"{i + 1} Rue Gare", "01234", "Vouglai") for i in range(8)]
    got = {tuple(r) for r in addresses.matches(spark.createDataFrame(rows, PLACE)).collect()}
    assert got == {("f11", "x"), ("f13", "y"), ("f2", "z")}


def _apart(a, b):
    """Edit distance with swaps of neighbours."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def _edited(w, edits):
    for _ in range(edits):
        i, c = random.randrange(len(w)), random.choice("abcd")
        w = random.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
    return w


def test_windows_hold_all_near_spellings(spark):
    random.seed(6)
    right = ["".join(random.choice("abcdefghij") for _ in range(random.randint(3, 14))) for _ in range(60)]
    count = {w: 1000 + k for k, w in enumerate(right)}
    for w in right * 6:
        count.setdefault(_edited(w, 1), random.randint(1, 3))
    count = {w: n for w, n in count.items() if w}
    df = spark.createDataFrame([("g", w, n, 5, 5) for w, n in count.items()], "g string, w string, n int, few int, ratio int")
    got = {r.w: r.right for r in addresses.respelled(df).collect()}
    best = {}
    for w, n in count.items():
        near = [(m, v) for v, m in count.items() if v != w and min(len(v), len(w)) >= 3 and _apart(v, w) == 1 and m >= (10 if min(len(v), len(w)) < 6 else 1) * n and (m, v) > (n, w)]
        if near:
            best[w] = max(near)[1]
    assert got == {w: best.get(v, v) for w, v in best.items()} and len(got) > 200


def test_two_edits_at_a_number(spark):
    random.seed(7)
    right = ["".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(8, 16))) for _ in range(150)]
    wrong = [_edited(w, 2) for w in right]
    rows = [("p", k, "", w, "rue", "", n, 1) for k, (a, b) in enumerate(zip(right, wrong, strict=True)) for w, n in ((a, 9), (b, 1)) if a != b]
    columns = ", ".join(f"{c} {'int' if c == 'number' else 'string'}" for c in addresses.RECORD)
    got = {r.number: r.own_name for r in addresses.settled(spark.createDataFrame(rows, f"{columns}, n int, street_n int")).where("name <> own_name").collect()}
    assert got == {k: a for k, (a, b) in enumerate(zip(right, wrong, strict=True)) if a != b and min(len(a), len(b)) >= 8} | {k: a for k, (a, b) in enumerate(zip(right, wrong, strict=True)) if a != b and min(len(a), len(b)) < 8 and _apart(a, b) == 1}


def test_a_third_of_all_rows_in_one_group(spark):
    n, hot = 3000, F.col("id") % 3 == 0
    same = F.when(hot, "12 bis Rue du Maréchal Fitrudrabout").otherwise(F.concat((F.col("id") % 50 + 1).cast("string"), F.lit(" Rue "), F.translate((F.col("id") + 10_000).cast("string"), "0123456789", "abcdefghij"), F.lit("ville")))
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), same.alias("address"), F.lit("01234").alias("postal_code"), F.lit("Vouglai").alias("city"))
    got = addresses.resolved(rows).groupBy("number", "suffix", "name").agg(F.count("*").alias("n")).orderBy(F.desc("n")).first()
    assert (got.number, got.suffix, got.name, got.n) == (12, "bis", "fitrudrabout", 1000)
    words = F.when(hot, "one two three four five six").otherwise(F.concat(F.lit("one two three four five w"), F.col("id"), F.lit(" x"), F.col("id")))
    listed = near_dup.columns_as_words(spark.range(n).withColumn("t", words), "id", F.col("t"))
    found = {(r.copies, r.links, r.n) for r in near_dup.near_duplicate_links(listed, cold=10).groupBy("copies", "links").agg(F.count("*").alias("n")).collect()}
    # five shared words of eight are 0.625 with the hot set, five of nine are 0.556 among the others
    assert found == {(1000, 2000, 1000), (1, 1, 2000)}
