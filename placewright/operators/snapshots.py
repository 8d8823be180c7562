"""What changed between full snapshots, by Merkle trees over hash ranges.

Every key falls into a leaf, a range of a 64-bit hash; there are as many leaves
as keep about ``LEAF_ROWS`` keys in each, so their number follows the table. A leaf's digest is made
of commutative sums over its rows (count, two sums of independent row hashes),
so it is built with partial aggregation. The level above has ``2**FAN_BITS``
leaves in one node, whose digest is the sum of its children's, and so on up to the root;
each level is rolled up from the one below it. The digests are stored before they
are compared, so a delivered snapshot's tree is computed once. Two snapshots are
compared from the root down: only children of nodes that differ are looked at,
and rows are diffed only in leaves that differ. Where many keys change, small
leaves keep the share of rows that must be diffed close to the share that changed.
Three sums of 64-bit hashes would have to coincide for a change to be missed.

Defined results: rows without a key are dropped; of several rows of one
snapshot and key the one with the latest arrival counts (a null arrival is the
earliest; ties fall to the greatest hash, so the result doesn't depend on row
order); a null hash is a value of its own; the first snapshot gives nothing; a
snapshot is compared with the greatest number below it that was delivered; an
empty table gives no rows; extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placewright.plans.cut import cut

#: Keys in a leaf, about; and binary digits that a level of the tree adds.
LEAF_ROWS = 4
FAN_BITS = 6
SUMS = ("n", "d1", "d2")


def hex_number(c: Column) -> Column:
    """One writing for each hexadecimal number: lower case, no blanks, no ``0x``, no leading zeros."""
    bare = F.regexp_replace(F.lower(c), r"[\s_]+|^\s*0x", "")
    return F.when(c.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(bare, "^0+", ""), F.lit("")), F.lit("0")))


def current_rows(df: DataFrame, snapshot: str, key: str, digest: Column, arrival: str) -> DataFrame:
    """``s``, ``k``, ``h``: the row that counts for each snapshot and key."""
    rows = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(F.col(snapshot).alias("s"), F.col(key).alias("k"), digest.alias("h"), F.col(arrival).alias("a"))
    return rows.groupBy("s", "k").agg(F.max(F.struct("a", "h")).alias("x")).select("s", "k", F.col("x.h").alias("h"))


def leaf_bits(rows: DataFrame, leaf_rows: int = LEAF_ROWS) -> int:
    """Binary digits of the leaves' numbers, from the keys of the largest snapshot."""
    most = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return max(1, min(48, (max(1, most // leaf_rows) - 1).bit_length()))


def _leaf(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("k"), 64 - bits)


def leaf_digests(rows: DataFrame, bits: int) -> DataFrame:
    """Digest of every leaf of every snapshot: ``s``, ``node``, ``n``, ``d1``, ``d2``."""
    both = F.concat_ws("\x1f", "k", F.coalesce("h", F.lit("\x1e")))
    wide = lambda c: c.cast("decimal(20,0)")
    return rows.groupBy("s", _leaf(bits).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum(wide(F.xxhash64(both))).alias("d1"), F.sum(wide(F.xxhash64(F.lit(7), both))).alias("d2"))


def levels_above(digests: DataFrame, bits: int, fan_bits: int = FAN_BITS) -> list[tuple[int, DataFrame]]:
    """The tree, root's children first: (binary digits, digests of that level), each made from the level below."""
    tree = [(bits, digests)]
    while tree[0][0] > fan_bits:
        below, table = tree[0]
        level = (below - 1) // fan_bits * fan_bits
        up = table.groupBy("s", F.shiftright("node", below - level).alias("node")).agg(*(F.sum(c).alias(c) for c in SUMS))
        tree.insert(0, (level, up))
    return tree


def _order(digests: DataFrame) -> DataFrame:
    """``s``, ``prev``: one row per delivery but the first."""
    return digests.select("s").distinct().select("s", F.lag("s").over(Window.orderBy("s")).alias("prev")).where("prev is not null")


def differing(table: DataFrame, order: DataFrame, parents: DataFrame | None, shift: int) -> DataFrame:
    """``s``, ``prev``, ``node`` of one level's nodes that differ between neighbouring snapshots, below ``parents`` that do."""
    as_new = table.join(order, "s").select("s", "prev", "node", *SUMS, F.lit(1).alias("side"))
    as_old = table.withColumnRenamed("s", "prev").join(order, "prev").select("s", "prev", "node", *SUMS, F.lit(-1).alias("side"))
    pairs = as_new.unionByName(as_old)
    if parents is not None:
        open_above = parents.select("s", F.col("node").alias("up"))
        pairs = pairs.withColumn("up", F.shiftright("node", shift)).join(open_above, ["s", "up"], "left_semi")
    # equal digests cancel out
    apart = pairs.groupBy("s", "prev", "node").agg(*(F.sum(F.col(c) * F.col("side")).alias(c) for c in SUMS))
    return apart.where(" or ".join(f"{c} <> 0" for c in SUMS)).select("s", "prev", "node")


def differing_leaves(digests: DataFrame, bits: int, fan_bits: int = FAN_BITS) -> list[DataFrame]:
    """``s``, ``prev``, ``node`` of the nodes that differ, for each level from the top; the last are the leaves."""
    order, found = F.broadcast(_order(digests)), []  # one row per delivery
    above, parents = 0, None
    for level, table in levels_above(digests, bits, fan_bits):
        parents = differing(table, order, parents, level - above)
        found.append(parents)
        above = level
    return found


def snapshot_changes(df: DataFrame, snapshot: str, key: str, digest: Column, arrival: str, bits: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """``s``, ``k``, ``change_kind`` (added, removed, changed) for every snapshot after the first.

    ``bits`` (from the data, unless given) sets the number of leaves, ``2**bits``.
    """
    rows = cut(current_rows(df, snapshot, key, digest, arrival))
    bits = bits or leaf_bits(rows)
    digests = cut(leaf_digests(rows, bits))
    leaves = differing_leaves(digests, bits, fan_bits)[-1]
    placed = rows.withColumn("node", _leaf(bits))
    none, said = F.lit(None).cast("string"), F.coalesce("h", F.lit("\x1e"))
    new = placed.join(leaves.select("s", "node"), ["s", "node"], "left_semi").select("s", "k", said.alias("new"), none.alias("old"))
    old = placed.withColumnRenamed("s", "prev").join(leaves, ["prev", "node"]).select("s", "k", none.alias("new"), said.alias("old"))
    both = new.unionByName(old).groupBy("s", "k").agg(F.max("new").alias("new"), F.max("old").alias("old")).where("not (new <=> old)")
    return both.select("s", "k", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change_kind"))


def pruned_shares(df: DataFrame, snapshot: str, key: str, digest: Column, arrival: str, bits: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """What the tree saves: ``level`` (binary digits), ``compared`` nodes of all pairs of snapshots, ``differing`` ones."""
    rows = cut(current_rows(df, snapshot, key, digest, arrival))
    bits = bits or leaf_bits(rows)
    digests = cut(leaf_digests(rows, bits))
    order, parts = F.broadcast(_order(digests)), []  # one row per delivery
    for (level, table), apart in zip(levels_above(digests, bits, fan_bits), differing_leaves(digests, bits, fan_bits), strict=True):
        met = table.join(order, "s").select("s", "node").unionByName(table.withColumnRenamed("s", "prev").join(order, "prev").select("s", "node")).distinct()
        parts += [met.select(F.lit(level).alias("level"), F.lit(1).alias("m"), F.lit(0).alias("d")), apart.select(F.lit(level).alias("level"), F.lit(0).alias("m"), F.lit(1).alias("d"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("level").agg(F.sum("m").alias("compared"), F.sum("d").alias("differing"))
