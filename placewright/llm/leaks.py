"""Held-out test passages inside a corpus, by latent semantic retrieval.

* A passage is ``SPAN`` words in a row. Item passages begin at every word. Only words of the items can be shared with
  them, so of a document those passages count that hold at least ``least`` item words; the others in
  them are one reserved number without weight. The corpus is read once, and its passages are stored.
* Passages are TF-IDF vectors over the items' vocabulary; document frequencies are counted over all documents.
  A randomised singular value decomposition of all passages gives the latent space: the tasks multiply the
  passage matrix, and its transpose, with a narrow block of vectors and add up their parts over the cluster; only
  blocks of ``LATENT_WORDS`` times ``RANK + EXTRA`` numbers, a fixed bound, pass the driver, which makes them orthogonal.
* Item passages are indexed by random hyperplanes in the latent space: in each of several tables a passage falls
  into the bucket of its signs. The number of bits follows the number of item passages, and the number of tables
  is what finds a passage at the wanted cosine with probability ``RECALL``. Corpus passages look up their buckets, so no passage is compared
  with all others. The signs are those of whole numbers, computed exactly, so equal passages always share a bucket.
* Candidates at the wanted cosine are checked: for leaks the words must be the same in the same order;
  for paraphrases the longest common subsequence must reach ``least`` words and
  hold the item passage's most telling word (the answer check).

The items are a stated test set: their vocabulary and passages are sent to the tasks, passages in blocks of at
most ``BLOCK_PASSAGES``. Vocabulary, weights and latent space are those of all items, so blocks
don't change what is found. Words beyond ``LATENT_WORDS`` share their latent vectors with others; the checks compare words.

Defined results: null, empty and short texts hold nothing; items under ``SPAN``
words leak nowhere; repeated documents and items count once; two items with
equal passages both leak; a hyphen at a line's end joins its word, and the
reading that keeps it as two words counts too; texts are read whole.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.plans.cut import cut

SPAN = 8
BLOCK_PASSAGES = 500_000
LATENT_WORDS = 200_000
RANK, EXTRA, POWERS = 48, 8, 2
RECALL = 0.97
EXACT = 0.999


def _reader():
    """A function from a text to its readings, each a list of words."""
    import html
    import re
    import unicodedata

    invisible = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
    broken = re.compile(r"[-­‐‑][ \t]*(?:\r\n|\r|\n)[ \t]*(?=\w)")
    word = re.compile(r"[^\W_]+")

    def fold(t):
        t = invisible.sub("", t).lower()
        if not t.isascii():
            t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return word.findall(t)

    def read(text):
        t = html.unescape(text) if "&" in text else text
        joined = broken.sub("", t)
        return [fold(joined)] if joined == t else [fold(joined), fold(broken.sub(" ", t))]

    return read


class Items:
    """The test items as numbers: the vocabulary, and every distinct passage's words and items.

    ``words`` has the passages; the items of passage p are ``item[first[p]:first[p + 1]]``.
    """

    def __init__(self, rows: list[tuple[int, str]]):
        import numpy as np

        read = _reader()
        texts = [(i, words) for i, t in rows for words in read(t or "") if len(words) >= SPAN]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in texts for w in words}))}
        passages = sorted({(*(self.vocabulary[w] for w in words[k : k + SPAN]), i) for i, words in texts for k in range(len(words) - SPAN + 1)})
        table = np.array(passages, dtype=np.int64).reshape(-1, SPAN + 1)
        new = np.ones(len(table), dtype=bool)
        new[1:] = (table[1:, :SPAN] != table[:-1, :SPAN]).any(axis=1)
        self.words, self.item = table[new, :SPAN].astype(np.int32), table[:, SPAN]
        self.first = np.r_[np.flatnonzero(new), len(table)]

    def blocks(self, size: int):
        """(words, item, first) of at most ``size`` passages each."""
        for begin in range(0, len(self.words), size):
            first = self.first[begin : begin + size + 1]
            yield self.words[begin : begin + size], self.item[first[0] : first[-1]], first - first[0]


def stretches(words: list, least: int, other: int) -> list[list[int]]:
    """Of a text's numbers (None for foreign words, which come out as ``other``): what windows of ``SPAN`` with at least ``least`` known words cover, cut so that every window of a stretch is one."""
    found, held, begin = [], 0, None
    for end, n in enumerate((*words, None), 1):
        if end <= len(words):
            held += n is not None
            if end > SPAN:
                held -= words[end - SPAN - 1] is not None
        good = end <= len(words) and end >= SPAN and held >= least
        if good and begin is None:
            begin = end - SPAN
        if not good and begin is not None:
            found.append([other if w is None else w for w in words[begin : end - 1]])
            begin = None
    return found


def runs(documents: DataFrame, key: str, text: str, vocabulary: dict[str, int], least: int = SPAN) -> DataFrame:
    """``k``, ``terms`` (item words that the document holds), ``runs`` (its runs of item words, each at least ``SPAN`` long; for less than ``SPAN`` shared words its stretches)."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(documents.dtypes)[key]

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read, known = _reader(), shared.value.get
        for batch in batches:
            terms, found = [], []
            for t in batch.column(1).to_pylist():
                seen, own = set(), []
                for words in read(t) if t else ():
                    if least < SPAN:
                        numbers = [known(w) for w in words]
                        seen.update(n for n in numbers if n is not None)
                        own += stretches(numbers, least, len(shared.value))
                        continue
                    run: list[int] = []
                    for n in (*map(known, words), None):
                        if n is not None:
                            run.append(n)
                        elif run:
                            seen.update(run)
                            if len(run) >= SPAN:
                                own.append(run)
                            run = []
                terms.append(list(seen))
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.list_(pa.int32())))], names=["k", "terms", "runs"])

    return documents.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(find, f"k {kind}, terms array<int>, runs array<array<int>>")


def _passages(lists):
    """Of a column of runs: the passages' words, and the row of each."""
    import numpy as np

    rows, parts = [], []
    for row, own in enumerate(lists.to_pylist()):
        for run in own:
            parts.append(np.lib.stride_tricks.sliding_window_view(np.array(run, dtype=np.int32), SPAN))
            rows.append(np.full(len(run) - SPAN + 1, row))
    if not parts:
        return np.empty((0, SPAN), dtype=np.int32), np.empty(0, dtype=np.int64)
    return np.concatenate(parts), np.concatenate(rows)


def _gathered(words, table):
    """The sum of the table's rows of each passage's words."""
    x = table[words[:, 0]].copy()
    for g in range(1, SPAN):
        x += table[words[:, g]]
    return x


def _scattered(words, x, n: int):
    """The transposed product: row w is the sum of ``x`` over the passages' places with word w."""
    import numpy as np

    out = np.zeros((n, x.shape[1]))
    flat = words.ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, dtype=int)
    if len(first):
        out[flat[first]] = np.add.reduceat(x[order // SPAN], first)
    return out


def passages_squared(found: DataFrame, idf, block):
    """``A.T @ (A @ block)`` over all corpus passages, A their TF-IDF matrix: each task adds up its own part, parts are added by rows over the cluster."""
    import numpy as np

    n, width = block.shape
    shared = found.sparkSession.sparkContext.broadcast((idf.astype(np.float32), (idf[:, None] * block).astype(np.float32)))
    step = 256

    def multiply(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        idf, table = shared.value
        total = None
        for batch in batches:
            words, _ = _passages(batch.column(0))
            for begin in range(0, len(words), 20_000):
                part = words[begin : begin + 20_000] % len(idf)
                own = _scattered(part, _gathered(part, table), len(idf))
                total = own if total is None else total + own
        if total is not None:
            total = (total * idf[:, None]).astype(np.float32)
            at = [k for k in range(0, len(total), step) if total[k : k + step].any()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[k : k + step].tobytes() for k in at], pa.binary())], names=["at", "x"])

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(x, dtype=np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], names=["at", "x"])

    parts = found.where(F.size("runs") > 0).select("runs").mapInArrow(multiply, "at int, x binary")
    out = np.zeros((n, width))
    for row in parts.repartition("at").mapInArrow(add, "at int, x binary").collect():
        x = np.frombuffer(row.x, dtype=np.float32).reshape(-1, width)
        out[row.at : row.at + len(x)] += x
    return out


def latent_terms(found: DataFrame, own, idf, rank: int = RANK, extra: int = EXTRA, powers: int = POWERS):
    """Each word's vector in the latent space of all passages (the corpus's and the items' ``own``): idf times the leading right singular vectors."""
    import numpy as np

    n = len(idf)

    def times(block):
        folded = own % n
        mine = idf[:, None] * _scattered(folded, _gathered(folded, idf[:, None] * block), n)
        return mine + passages_squared(found, idf, block)

    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((n, min(n, rank + extra))))
    for _ in range(powers):
        q, _ = np.linalg.qr(times(q))
    _, u = np.linalg.eigh(q.T @ times(q))
    return (idf[:, None] * (q @ u[:, ::-1][:, :rank])).astype(np.float32)


def _project(words, terms):
    """Unit vectors of passages; rows of zeros where nothing is left of a passage."""
    import numpy as np

    x = _gathered(words % len(terms), terms)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    none = size[:, 0] < 1e-9
    x /= np.where(none[:, None], 1, size)
    x[none] = 0
    return x, none


class Buckets:
    """Random-projection buckets: for each table a number of ``bits`` signs.

    Buckets of some dozens of passages are compared as blocks, which costs less than the tables that smaller ones would take;
    where only equal passages are wanted, one table does, and its buckets are as small as they can be.
    """

    def __init__(self, terms, passages: int, cosine: float):
        import math

        import numpy as np

        digits = math.ceil(math.log2(passages + 1))
        self.bits = max(1, min(30, digits + 6 if cosine >= EXACT else digits - 6))
        same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** self.bits
        self.tables = 1 if cosine >= EXACT else max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same)))
        # whole numbers, whose sums are exact in whatever order they are added
        scale = 2.0**20 / max(float(np.abs(terms).max(initial=0)), 1e-12)
        self.terms = np.rint(terms.astype(np.float64) * scale)
        self.planes = np.random.default_rng(11).choice([-1.0, 1.0], size=(terms.shape[1], self.bits * self.tables))

    def codes(self, words):
        """The bucket of each passage in each table."""
        import numpy as np

        sides = (_gathered(words % len(self.terms), self.terms) @ self.planes >= 0).reshape(len(words), self.tables, self.bits)
        return sides @ (1 << np.arange(self.bits, dtype=np.int64))


def _common(a, b):
    """Length of the longest common subsequence of each pair of rows."""
    import numpy as np

    best = np.zeros((len(a), SPAN + 1), dtype=np.int8)
    for i in range(SPAN):
        old = best.copy()
        for j in range(SPAN):
            best[:, j + 1] = np.where(a[:, i] == b[:, j], old[:, j] + 1, np.maximum(old[:, j + 1], best[:, j]))
    return best[:, SPAN]


class Index:
    """The item passages by bucket."""

    def __init__(self, words, terms, cosine: float):
        import numpy as np

        self.cosine, self.terms, self.buckets = cosine, terms, Buckets(terms, len(words), cosine)
        codes = self.buckets.codes(words)
        self.order = [np.argsort(codes[:, t], kind="stable") for t in range(self.buckets.tables)]
        self.codes = [codes[o, t] for t, o in enumerate(self.order)]
        self.vectors, self.none = _project(words, terms)

    def near(self, words):
        """Pairs (passage of ``words``, item passage) that share a bucket and reach the cosine, each once, and their cosines."""
        import numpy as np

        codes = self.buckets.codes(words)
        x, none = _project(words, self.terms)
        size = max(1, len(self.none))
        seen, near = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.float32)]
        for t in range(self.buckets.tables):
            mine = np.argsort(codes[:, t], kind="stable")
            own = codes[mine, t]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, dtype=int)
            begin, end = (np.searchsorted(self.codes[t], own[first], side) for side in ("left", "right"))
            for k in np.flatnonzero(end > begin):
                here = mine[first[k] : first[k + 1] if k + 1 < len(first) else len(own)]
                step = max(1, 4_000_000 // int(end[k] - begin[k]))
                there = self.order[t][begin[k] : end[k]]
                for part in (here[i : i + step] for i in range(0, len(here), step)):
                    block = x[part] @ self.vectors[there].T
                    if none[part].any():
                        block[np.ix_(none[part], self.none[there])] = 1
                    p, m = np.nonzero(block >= self.cosine)
                    seen.append(part[p] * size + there[m])
                    near.append(block[p, m])
        pairs, near = np.concatenate(seen), np.concatenate(near)
        order = np.argsort(pairs, kind="stable")
        order = order[np.diff(pairs[order], prepend=-1) > 0]
        return pairs[order] // size, pairs[order] % size, near[order]


def search(found: DataFrame, block, terms, idf, cosine: float, least: int) -> DataFrame:
    """``k``, ``item_id``, ``lcs``, ``cosine`` of each document and item with a checked passage (the best of it)."""
    sc = found.sparkSession.sparkContext
    shared = sc.broadcast((*block, terms, idf))
    kind = dict(found.dtypes)["k"]

    def look(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        words, item, first, terms, idf = shared.value
        index = Index(words, terms, cosine)
        telling = words[np.arange(len(words)), np.argmax(idf[words], axis=1)]
        for batch in batches:
            theirs, row = _passages(batch.column(1))
            # a passage that many documents have is looked up once
            order = np.lexsort(theirs.T)
            theirs, row = theirs[order], row[order]
            new = np.ones(len(theirs), dtype=bool)
            new[1:] = (theirs[1:] != theirs[:-1]).any(axis=1)
            theirs, holders = theirs[new], np.r_[np.flatnonzero(new), len(row)]
            best: dict = {}
            for begin in range(0, len(theirs), 10_000):
                part = theirs[begin : begin + 10_000]
                p, m, near = index.near(part)
                if least >= SPAN:
                    ok = (part[p] == words[m]).all(axis=1)
                    length = np.full(len(p), SPAN)
                else:
                    telltale = (part[p] == telling[m][:, None]).any(axis=1)
                    p, m, near = p[telltale], m[telltale], near[telltale]
                    length = _common(part[p], words[m])
                    ok = length >= least
                for t, q, n, c in zip((begin + p[ok]).tolist(), m[ok].tolist(), length[ok].tolist(), near[ok].tolist(), strict=True):
                    for r in row[holders[t] : holders[t + 1]].tolist():
                        for i in item[first[q] : first[q + 1]].tolist():
                            best[r, i] = max(best.get((r, i), (0, 0.0)), (n, c))
            if best:
                at = sorted(best)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in at])), pa.array([i for _, i in at], pa.int64()), pa.array([best[x][0] for x in at], pa.int32()), pa.array([float(best[x][1]) for x in at])], names=["k", "item_id", "lcs", "cosine"])

    return found.where(F.size("runs") > 0).select("k", "runs").mapInArrow(look, f"k {kind}, item_id bigint, lcs int, cosine double")


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, cosine: float = EXACT, least: int = SPAN) -> DataFrame:
    """``key``, ``item_id``, ``lcs``, ``cosine``: one row for each document and test item that it leaks."""
    import numpy as np

    spark = documents.sparkSession
    known = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("i"), F.col(item_text).alias("t")).distinct()
    mine = Items([(r.i, r.t) for r in known.collect()])  # the stated test set
    out = None
    if len(mine.item):
        n = len(mine.vocabulary) + 1  # the last for words of no item
        found = cut(runs(documents, key, text, mine.vocabulary, least))
        df = np.zeros(n)
        counted = found.select(F.explode("terms").alias("w")).groupBy("w").count().toArrow()  # at most the items' vocabulary
        df[counted.column("w").to_numpy()] = counted.column("count").to_numpy()
        idf = np.log((1 + documents.count()) / (1 + df)) + 1
        idf[-1] = 0
        latent = idf[:LATENT_WORDS].copy()
        if n > LATENT_WORDS:
            latent[(n - 1) % LATENT_WORDS] = 0  # what shares the row of foreign words has no weight either
        terms = latent_terms(found, mine.words, latent)
        for block in mine.blocks(BLOCK_PASSAGES):
            got = search(found, block, terms, idf.astype(np.float32), cosine, least)
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = spark.createDataFrame([], f"k {dict(documents.dtypes)[key]}, item_id bigint, lcs int, cosine double")
    return out.groupBy("k", "item_id").agg(F.max("lcs").alias("lcs"), F.max("cosine").alias("cosine")).withColumnRenamed("k", key)
