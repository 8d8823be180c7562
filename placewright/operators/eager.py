"""Aggregating through a join without joining rows (skewed keys).

Both inputs are first reduced to one compact state per key: a count and, for
each measure, sum, minimum, maximum and number of non-null values. Spark does
this before the shuffle, so a key with a third of all rows sends one state per
map task. The states are joined; what the full join would have given follows
by algebra:

* rows of the join = n_left * n_right,
* sum of a left measure over the join = sum_left * n_right (and the reverse),
* minimum and maximum are those of the states,
* an average of a left measure over the join is that of its state.

A roll-up then adds the results of all keys, which stays exact: counts are
decimals of 38 digits, since a hot key's product of counts passes 64 bits.

Defined results: a null key joins with nothing but keeps its state in an outer
join; NaN measures give NaN sums as in the plain join; an empty input gives no
rows (inner) or the other side's states (outer); a side that an outer join
lacks counts 0 rows; repeated rows count each; extra columns, also with clashing
names, are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts and what is made of them.
WIDE = "decimal(38,0)"


def key_states(df: DataFrame, key: Column, measures: dict[str, Column], prefix: str) -> DataFrame:
    """One row per key (null counts as a key): ``k``, ``<prefix>n`` and for each measure its sum, count, minimum and maximum."""
    cols = [key.alias("k"), *(m.alias(f"m_{n}") for n, m in measures.items())]
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    for n in measures:
        c = F.col(f"m_{n}")
        aggs += [F.sum(c).alias(f"{prefix}sum_{n}"), F.count(c).alias(f"{prefix}cnt_{n}"), F.min(c).alias(f"{prefix}min_{n}"), F.max(c).alias(f"{prefix}max_{n}")]
    return df.select(*cols).groupBy("k").agg(*aggs)


def join_states(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two tables of states on ``k``. In outer joins null keys stay on their own side."""
    r = right.withColumnRenamed("k", "rk")
    joined = left.join(r, left["k"] == r["rk"], how)
    return joined.withColumn("k", F.coalesce("k", "rk")).drop("rk")


def _times(x: Column, n: Column, kind: str) -> Column:
    """A sum times a count of rows, without overflow for whole numbers."""
    return x.cast(WIDE) * n if kind in ("bigint", "int", "smallint", "tinyint") else x * n.cast("double") if kind in ("double", "float") else x * n


def eager_join_aggregate(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_measures: dict[str, Column], right_measures: dict[str, Column], how: str = "inner") -> DataFrame:
    """Per key the results of ``left JOIN right ON key GROUP BY key``, made from compact states.

    Columns: ``k``, ``join_rows`` (decimal), ``left_rows``, ``right_rows``; for a left measure x ``sum_x``
    (over the joined rows), ``avg_x``, ``min_x``, ``max_x``; the same for right measures. With
    ``full_outer``, keys of one side come too, with 0 rows of the other, and so do the null keys' states.
    """
    a = key_states(left, left_key, left_measures, "l_")
    b = key_states(right, right_key, right_measures, "r_")
    if how == "inner":
        a, b = a.where("k is not null"), b.where("k is not null")
    kinds = {**dict(a.dtypes), **dict(b.dtypes)}
    j = join_states(a, b, how).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("l_n", "r_n")})
    rows = F.col("l_n").cast("decimal(19,0)") * F.col("r_n").cast("decimal(19,0)")
    out = [F.col("k"), rows.cast(WIDE).alias("join_rows"), F.col("l_n").alias("left_rows"), F.col("r_n").alias("right_rows")]
    for mine, other, names in (("l_", "r_", left_measures), ("r_", "l_", right_measures)):
        for n in names:
            s, c = F.col(f"{mine}sum_{n}"), F.col(f"{mine}cnt_{n}")
            out += [_times(s, F.col(f"{other}n"), kinds[f"{mine}sum_{n}"]).alias(f"sum_{n}"), (s / F.when(c > 0, c)).alias(f"avg_{n}"), F.col(f"{mine}min_{n}").alias(f"min_{n}"), F.col(f"{mine}max_{n}").alias(f"max_{n}")]
    return j.select(*out)


def roll_up(joined: DataFrame) -> DataFrame:
    """One row of totals over all keys: ``left_total``, ``right_total``, ``join_total``."""
    total = lambda c: F.sum(F.col(c).cast(WIDE)).alias(f"{c.removesuffix('_rows')}_total")
    return joined.agg(total("left_rows"), total("right_rows"), total("join_rows"))


def heavy_keys(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, names: tuple[str, str], share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows of their table: ``table_name``, ``k``, ``n``, ``total``, ``join_rows``.

    The states of both tables are joined once (full outer, so that no key is lost); the totals are the roll-up of
    the joined states, the null keys' included; ``join_rows`` is what the key weighs in a join of the two tables.
    """
    j = eager_join_aggregate(left, right, left_key, right_key, {}, {}, "full_outer")
    side = lambda name, s, own: F.struct(F.lit(name).alias("table_name"), *(F.col(f"{s}_{x}").alias(y) for x, y in own.items()))
    both = lambda own: F.explode(F.array(*(side(name, s, own) for name, s in zip(names, ("left", "right"), strict=True)))).alias("s")
    each = j.where("k is not null").select("k", "join_rows", both({"rows": "n"})).select("s.table_name", "k", "s.n", "join_rows")
    totals = roll_up(j).select(both({"total": "total"})).select("s.*")
    # two rows, one per table
    found = each.join(F.broadcast(totals), "table_name").where((F.col("n") > 0) & (F.col("n") >= F.lit(share) * F.col("total")))
    return found.select("table_name", "k", "n", "total", "join_rows")
