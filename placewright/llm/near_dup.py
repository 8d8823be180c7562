"""Near-duplicate records: an exact similarity join on sets of words.

All pairs with Jaccard similarity of at least ``num/den`` come out, by prefix
filtering in rare-first order:

* Words become 64-bit hashes; records with equal sets are collapsed to one, known by 128 bits.
* Every word's number of sets is counted exactly. *Hot* words are those in more than ``cold`` sets; they and their
  counts are sent to the tasks. ``cold`` is raised until they are at most ``HOT_WORDS``, which it must reach, as the counts add up to the input. All others
  are rarer than any hot word, and are ordered among themselves by one row of ``2**SKETCH_BITS`` numbers, each the greatest count of the cold words that share it: both are fixed bounds
  whatever the corpus holds, and any common order keeps the join exact.
* Of a set of length n only the first n - ceil(t n) + 1 words can hold the first
  shared word of a similar pair; if it is the pair's shorter set, only the first
  n - ceil(2t/(1+t) n) + 1. Sets are joined as shorter with longer, so the shorter
  prefix meets the longer one. Where that word is cold, sets are joined on it: lists are at most ``cold`` long, so the work
  grows in proportion to the input.
* Where the first shared word is hot, every shared word is, since all others
  come later in the order. Then at least ceil(t n) hot words are shared, and two
  such sets share ``N`` words among their first h - ceil(t n) + N hot words (h:
  number of hot words). They are joined on these prefix n-grams. Sets of more than ``LONG`` words, which would have too
  many, are joined with their like on single hot words.
* Length and positional filters (what is left behind the first shared word) and a suffix filter
  thin the candidates: a signature has a bit for each word behind the first shared one, and a bit
  that only one set has stands for a word that only it has there. A pair is verified once, on the words.

Defined results: null fields give no words; a record without words has no
partner; repeated rows count once; an id with different rows pairs by any of
them; equal sets pair too; long texts are read whole; an empty table gives no
rows; extra columns are ignored.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.functions.text import fold
from placewright.plans.cut import cut

#: Words in a hot prefix n-gram, and the longest sets that have them.
N = 2
LONG = 96
#: Sets that a cold word is in, at most (more if hot words would be too many to send), which bounds the lists of single words.
COLD = 1_000
HOT_WORDS = 2_000_000
SKETCH_BITS = 20


def bare_site(c: Column) -> Column:
    """A website without scheme, leading ``www.`` and all from ``?`` or ``#`` on."""
    s = F.regexp_replace(F.lower(c), r"^\s*[a-z][a-z0-9+.\-]*://", "")
    return F.regexp_replace(F.regexp_replace(s, r"^\s*www\.", ""), r"(?s)[?#].*$", "")


def word_set(*texts: Column) -> Column:
    """Hashes of the distinct words (runs of letters and digits, folded) of all texts, in order of hash."""
    words = F.regexp_extract_all(fold(F.concat_ws(" ", *texts)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _suffix_bits(toks, first, size):
    """For each word of sets in order, a signature of the words behind it in its set: a bit for each."""
    import numpy as np

    bit = np.left_shift(np.int64(1), toks & np.int64(63))
    out = np.zeros(len(toks), dtype=np.int64)
    kind = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for k in np.unique(kind):  # sets of about the same length are one table
        sets = np.flatnonzero((kind == k) & (size > 0))
        if not len(sets):
            continue
        width = int(size[sets].max())
        at = first[sets, None] + np.arange(width)
        own = np.arange(width) < size[sets, None]
        at = np.minimum(at, len(toks) - 1)
        bits = np.where(own, bit[at], 0)
        behind = np.zeros_like(bits)
        behind[:, :-1] = np.bitwise_or.accumulate(bits[:, :0:-1], axis=1)[:, ::-1]
        out[at[own]] = behind[own]
    return out


def _prefixes(order, num: int, den: int, n_gram: int, longest: int):
    """Postings of each set: key, sid, sid2, at, behind.

    ``at`` packs the set's length, the position of the key's first word among the words in order, and
    whether the key also lies in the prefix that serves the shorter set of a pair. ``behind``
    is the signature of the words behind that position.
    """

    def run(batches: Iterator) -> Iterator:
        from itertools import combinations
        from math import comb

        import numpy as np
        import pyarrow as pa

        hot_words, hot_counts, sketch = (np.frombuffer(x, dtype=np.int64) for x in order.value)
        mask = np.int64(len(sketch) - 1)
        picks: dict = {}

        def counts_of(toks):
            at = np.minimum(np.searchsorted(hot_words, toks), max(0, len(hot_words) - 1))
            hot = hot_words[at] == toks if len(hot_words) else np.zeros(len(toks), dtype=bool)
            return hot, np.where(hot, hot_counts[at] if len(hot_words) else 0, sketch[toks & mask])

        def grams(sets, n, first, skip, toks, k_long, k_short):
            """Keys of the ``n``-grams among the first ``k_long`` hot words of each set, the sets, the first word's position, and whether they serve the shorter role."""
            for k in np.unique(k_long[sets]):
                rows = sets[k_long[sets] == k]
                if (n, k) not in picks:
                    picks[n, k] = np.array(list(combinations(range(k), n)), dtype=np.int32).reshape(-1, n)
                pick = picks[n, k]
                step = max(1, 1_000_000 // comb(int(k), n))
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    words = toks[(first + skip)[part, None] + np.arange(k)]
                    key = np.full((len(part), len(pick)), n, dtype=np.int64)
                    with np.errstate(over="ignore"):
                        for g in range(n):
                            key = (key ^ (key >> np.int64(29))) * np.int64(-7046029254386353131) + words[:, pick[:, g]]
                    yield key.ravel(), np.repeat(part, len(pick)), (skip[part, None] + pick[:, 0]).ravel(), (pick[:, -1] < k_short[part, None]).ravel()

        for batch in batches:
            for piece in (batch.slice(begin, 2_000) for begin in range(0, batch.num_rows, 2_000)):
                sid, sid2 = (piece.column(c).to_numpy() for c in (0, 1))
                lists = piece.column(2)
                offsets = lists.offsets.to_numpy()
                size = np.diff(offsets)
                toks = lists.flatten().to_numpy()
                if not len(toks):
                    continue
                row = np.repeat(np.arange(len(sid)), size)
                hot, count = counts_of(toks)
                order_ = np.lexsort((toks, count, hot, row))
                toks, count, hot = toks[order_], count[order_], hot[order_]
                first = np.cumsum(size) - size
                signs = _suffix_bits(toks, first, size)
                pos = np.arange(len(toks)) - first[row]
                long_need = -(-num * size // den)  # shared words at least, as the longer set of a pair
                short_need = -(-2 * num * size // (num + den))  # and as the shorter one
                take = ~hot & (count > 1) & (pos < (size - long_need + 1)[row])
                out = [(toks[take], row[take], pos[take], pos[take] <= (size - short_need)[row[take]])]
                h = np.bincount(row[hot], minlength=len(sid))
                if n_gram > 1:
                    k_long, k_short = (h - np.maximum(need - n_gram, 0) for need in (long_need, short_need))
                    out.extend(grams(np.flatnonzero((size <= longest) & (k_long >= n_gram)), n_gram, first, size - h, toks, k_long, k_short))
                # single words for sets that pair with long ones, or may share fewer words than an n-gram has
                alone = (size * den > longest * num) | (long_need < n_gram) | (n_gram == 1)
                k_long, k_short = h - long_need + 1, h - short_need + 1
                out.extend(grams(np.flatnonzero(alone & (k_long >= 1)), 1, first, size - h, toks, k_long, k_short))
                for begin in range(0, len(out), 50):
                    key, who, at, short = (np.concatenate(x) for x in zip(*out[begin : begin + 50], strict=True))
                    packed = size[who].astype(np.int64) << np.int64(32) | at.astype(np.int64) << np.int64(1) | short.astype(np.int64)
                    place = first[who] + at
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.astype(np.int64), sid[who], sid2[who], packed, signs[place])], names=["key", "sid", "sid2", "at", "behind"])

    return run


def _order(rows: DataFrame, cold: int, hot_words: int, sketch_bits: int) -> tuple[bytes, bytes, bytes]:
    """What the rare-first order needs: hot words in order, their counts, and the cold words' greatest counts by hash bits."""
    import numpy as np

    words = cut(rows.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")))
    above = {r.j: r["count"] for r in words.where(F.col("n") > cold).groupBy(F.ceil(F.log2(F.col("n") / cold)).alias("j")).count().collect()}
    raised = next(j for j in range(max(above, default=0) + 1) if sum(n for k, n in above.items() if k > j) <= hot_words)
    cold = cold << raised
    hot = words.where(F.col("n") > cold).toArrow().sort_by("t")
    mask = (1 << sketch_bits) - 1
    bucket = F.col("t").bitwiseAND(F.lit(mask)).cast("int")
    found = words.where(F.col("n") <= cold).groupBy(bucket.alias("b")).agg(F.max("n").alias("n")).toArrow()
    sketch = np.zeros(1 << sketch_bits, dtype=np.int64)
    sketch[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return hot.column("t").to_numpy().astype(np.int64).tobytes(), hot.column("n").to_numpy().astype(np.int64).tobytes(), sketch.tobytes()


def similar_sets(sets: DataFrame, rows: DataFrame | None = None, num: int = 3, den: int = 5, cold: int = COLD, n_gram: int = N, longest: int = LONG, hot_words: int = HOT_WORDS, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """Pairs of ``sets`` (``sid``, ``sid2`` bigint, together unique; ``toks`` distinct words as bigint) with similarity of at least num/den: ``a``, ``a2``, ``b``, ``b2``, ``shared``, ``n_a``, ``n_b``.

    ``rows`` may give the same sets before copies were collapsed; counting them needs no shuffle of
    sets, and only makes the counts larger.
    """
    order = sets.sparkSession.sparkContext.broadcast(_order(sets if rows is None else rows, cold, hot_words, sketch_bits))
    postings = sets.select("sid", "sid2", "toks").mapInArrow(_prefixes(order, num, den, n_gram, longest), "key bigint, sid bigint, sid2 bigint, at bigint, behind bigint")
    side = lambda s: [F.col("sid").alias(s), F.col("sid2").alias(f"{s}2"), F.col("at").alias(f"at_{s}"), F.col("behind").alias(f"behind_{s}")]
    one = postings.where(F.col("at").bitwiseAND(F.lit(1)) == 1).select("key", *side("a"))
    two = postings.select("key", *side("b"))
    # lengths and positions are unpacked after the shuffle
    n_a, n_b = (F.shiftright(f"at_{x}", 32) for x in "ab")
    pos_a, pos_b = (F.shiftright(F.col(f"at_{x}").bitwiseAND(F.lit(0xFFFFFFFF)), 1) for x in "ab")
    enough = lambda o, n_a, n_b: o * (num + den) >= (n_a + n_b) * num
    rest_a, rest_b = n_a - pos_a - 1, n_b - pos_b - 1
    # a bit that only one set has stands for a word that only it has
    lone = lambda x, y: F.bit_count(F.col(f"behind_{x}").bitwiseAND(F.bitwise_not(f"behind_{y}")))
    behind = F.least(rest_a - lone("a", "b"), rest_b - lone("b", "a"))
    first = (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a2") < F.col("b2")))
    met = one.join(two, "key").where(((n_a < n_b) | ((n_a == n_b) & first)) & (n_a * den >= n_b * num) & enough(1 + F.least(rest_a, rest_b), n_a, n_b) & enough(1 + behind, n_a, n_b))
    pairs = met.select("a", "a2", "b", "b2").distinct()
    mine = lambda s: sets.select(F.col("sid").alias(s), F.col("sid2").alias(f"{s}2"), F.col("toks").alias(f"toks_{s}"))
    both = pairs.join(mine("a"), ["a", "a2"]).join(mine("b"), ["b", "b2"])
    checked = both.select("a", "a2", "b", "b2", F.size("toks_a").alias("n_a"), F.size("toks_b").alias("n_b"), F.size(F.array_intersect("toks_a", "toks_b")).alias("shared"))
    return checked.where(enough(F.col("shared"), F.col("n_a"), F.col("n_b"))).select("a", "a2", "b", "b2", "shared", "n_a", "n_b")


def collapse(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``id``, ``toks``: the members (``id``, ``sid``, ``sid2``) and the distinct sets (``sid``, ``sid2``, ``toks``). Both hashes together tell sets apart."""
    named = records.where(F.size("toks") > 0).select("id", F.xxhash64("toks").alias("sid"), F.xxhash64(F.lit(7), "toks").alias("sid2"), "toks")
    return named.select("id", "sid", "sid2").distinct(), named.select("sid", "sid2", "toks").dropDuplicates(["sid", "sid2"])


def near_duplicate_pairs(records: DataFrame, **how) -> DataFrame:
    """``id_a``, ``id_b`` (smaller first) of ``records`` (``id``, ``toks``)."""
    members, sets = collapse(records)
    alike = similar_sets(sets, records, **how)
    side = lambda s: members.select(F.col("id").alias(f"id_{s}"), F.col("sid").alias(s), F.col("sid2").alias(f"{s}2"))
    apart = alike.select("a", "a2", "b", "b2").join(side("a"), ["a", "a2"]).join(side("b"), ["b", "b2"]).select("id_a", "id_b")
    same = side("a").join(members.select(F.col("id").alias("id_b"), F.col("sid").alias("a"), F.col("sid2").alias("a2")), ["a", "a2"]).where("id_a < id_b").select("id_a", "id_b")
    ordered = apart.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return ordered.unionByName(same).distinct()


def near_duplicate_links(records: DataFrame, **how) -> DataFrame:
    """``id``, ``class_id``, ``copies``, ``links``: of each id and set of words, the set's id, how many ids have it, and how many other sets are similar.

    Its size follows the input whatever the groups of copies; nothing is expanded into pairs of ids.
    """
    members, sets = collapse(records)
    alike = similar_sets(sets, records, **how)
    one = lambda s: F.struct(F.col(s).alias("sid"), F.col(f"{s}2").alias("sid2"))
    ends = alike.select(F.explode(F.array(one("a"), one("b"))).alias("x")).groupBy("x.sid", "x.sid2").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("sid", "sid2").agg(F.count(F.lit(1)).alias("copies"))
    name = F.concat(F.lpad(F.hex("sid"), 16, "0"), F.lpad(F.hex("sid2"), 16, "0"))
    return members.join(copies, ["sid", "sid2"]).join(ends, ["sid", "sid2"], "left").select("id", name.alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def columns_as_words(df: DataFrame, key: str, *texts: Column) -> DataFrame:
    """``id``, ``toks`` of a table.

    The generator keeps later filters and hashes of ``toks`` from computing the words anew.
    """
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(F.array(word_set(*texts))).alias("toks"))
