"""Deeply nested documents to related flat tables.

A record's text is read once, event by event, without building the document:
an event is a name, a value, or the begin or end of an object or list. The events
become triples of path, ordinals and value. Paths are grouped by their repeated
ancestor (the last list they pass), and each group is pivoted into one table. A table's key is the
record's key with the ordinals; the parent's key is the same without the last
ordinal, so parent and child join on equality.

A path is names joined by ``/``, with ``[]`` after a name whose value is a list of
objects; ``offers[]/schema:priceSpecification[]`` is the ancestor of every price
specification. In a name, ``~``, ``/`` and ``[`` of the document's own are written
``~0``, ``~1`` and ``~2``, so that different paths never look alike.

Which names are repeated is found in the data (``repeated_names``) or told by
the caller. A lone object at such a name counts as a list of one; a list of objects makes a
table of its own even where nobody expected one, so no object is lost.

Defined results: unreadable text, null, and texts that are no object at the top
give no triples; list members that are no objects keep their position, and come out
in the list's leaf (the JSON text of the list) only if no member is an object; an
object gives a marker (leaf ``""``) even when empty; a text that is itself JSON of an
object or list stands for what it spells, however often it is wrapped; of a name
written twice in one object the last counts; depth is unlimited; of the input only
the keys and the payload are read, and a key named as a column of the result is
refused.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLES = "ancestor string, pos array<int>, leaf string, value string"
#: Paths that ``repeated_names`` may find; a corpus with more has data for names, and needs them told.
MAX_PATHS = 10_000


class Frame:
    """An object or list that is being read."""

    __slots__ = ("begin", "canon", "index", "kind", "leaf", "name", "names", "objects", "pos", "prefix", "table", "want")

    def __init__(self, kind, table=None, canon="", pos=(), prefix="", leaf=None, begin=0, want=False):
        self.kind, self.table, self.canon, self.pos, self.prefix, self.leaf, self.begin, self.want = kind, table, canon, pos, prefix, leaf, begin, want
        self.name, self.names, self.index, self.objects = None, {}, 0, False


def events(text):
    """The events of a JSON text: ``{`` and ``[`` with where they begin, ``}`` and ``]`` with where they end, ``k`` with a name, ``s`` with a text, ``v`` with another scalar as written.

    ValueError where the text is unreadable, which may come after some events.
    """
    import re
    from json.decoder import scanstring

    blank = re.compile(r"[ \t\n\r]*").match
    scalar = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity").match
    i, open_ones, state = blank(text, 0).end(), [], "value"
    while True:
        c = text[i : i + 1]
        if state == "name" or state == "first name":
            if c == '"':
                value, i = scanstring(text, i + 1, True)
                i = blank(text, i).end()
                if text[i : i + 1] != ":":
                    raise ValueError(f"no colon at {i}")
                yield "k", value
                i = blank(text, i + 1).end()
                state = "value"
                continue
            if c != "}" or state == "name":
                raise ValueError(f"no name at {i}")
        elif c == "{" or c == "[":
            yield c, i
            open_ones.append("}" if c == "{" else "]")
            i = blank(text, i + 1).end()
            state = "first name" if c == "{" else "first"
            continue
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
            yield "s", value
        elif c != "]" or state != "first":
            m = scalar(text, i)
            if not m:
                raise ValueError(f"no value at {i}")
            i = m.end()
            yield "v", m[0]
        # a value is over, or an object or list is empty
        while True:
            i = blank(text, i).end()
            if not open_ones:
                if i < len(text):
                    raise ValueError(f"more than a value at {i}")
                return
            c = text[i : i + 1]
            if c == ",":
                i = blank(text, i + 1).end()
                state = "name" if open_ones[-1] == "}" else "value"
                break
            if c != open_ones[-1]:
                raise ValueError(f"no end at {i}")
            i += 1
            yield open_ones.pop(), i


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1").replace("[", "~2") if any(c in name for c in "~/[") else name


def names_of(ancestors: list[str]) -> set[str]:
    """The names that are repeated in these ancestors, as paths without ``[]``."""
    found = set()
    for a in ancestors:
        steps = a.split("/")
        found |= {"/".join(x.removesuffix("[]") for x in steps[: k + 1]) for k, step in enumerate(steps) if step.endswith("[]")}
    return found


class Shredder:
    """From a record's text to its triples: (ancestor, ordinals, leaf, value).

    ``repeated`` names count as lists even where an object stands alone; ``wanted`` tables come out, all if None.
    """

    def __init__(self, repeated: set[str], wanted: set[str] | None = None, with_leaves: bool = True):
        self.repeated, self.wanted, self.with_leaves = repeated, wanted, with_leaves
        self.out: list = []

    def __call__(self, text: str | None) -> list[tuple]:
        self.out = []
        try:
            if text:
                self._text(Frame("top"), text)
        except ValueError:
            return []
        return [t for t in self.out if t is not None]

    def _row(self, table, canon, pos, begin):
        want = self.wanted is None or table in self.wanted
        if want:
            self.out.append((table, pos, "", None))
        return Frame("{", table, canon, pos, begin=begin, want=want and self.with_leaves)

    def _object(self, f, begin):
        if f.kind == "top":
            return self._row("", "", [], begin)
        if f.kind == "{":
            name = f.prefix + _escaped(f.name)
            canon = f"{f.canon}/{_escaped(f.name)}" if f.canon else _escaped(f.name)
            if canon in self.repeated:
                return self._row((f"{f.table}/{name}" if f.table else name) + "[]", canon, [*f.pos, 0], begin)
            return Frame("{", f.table, canon, f.pos, name + "/", begin=begin, want=f.want)
        f.objects = True
        if f.kind == "[":
            return self._row(f.table, f.canon, [*f.pos, f.index], begin)
        return Frame("inner", begin=begin)

    def _list(self, f, begin):
        if f.kind == "top":
            raise ValueError("no object")
        if f.kind != "{":  # a list in a list has no path; the outer list's text holds it
            return Frame("inner", begin=begin)
        name = f.prefix + _escaped(f.name)
        canon = f"{f.canon}/{_escaped(f.name)}" if f.canon else _escaped(f.name)
        return Frame("[", (f"{f.table}/{name}" if f.table else name) + "[]", canon, f.pos, leaf=(f.table, f.pos, name) if f.want else None, begin=begin)

    def _scalar(self, f, x):
        if f.kind == "top":
            raise ValueError("no object")
        if f.kind == "{" and f.want:
            self.out.append((f.table, f.pos, f.prefix + _escaped(f.name), x))

    def _text(self, f, s):
        """A text where a value stands: what it spells, if that is an object or list, else itself."""
        import json

        inner = s.strip()
        while inner[:1] == '"' and inner[-1:] == '"':
            try:
                once = json.loads(inner)
            except ValueError:
                break
            inner = once.strip()
        if f.kind == "top" or inner[:1] in ("{", "["):
            mark, objects = len(self.out), f.objects
            try:
                return self._consume(inner, f)
            except ValueError:
                del self.out[mark:]
                f.objects = objects
        self._scalar(f, s)

    def _consume(self, text, top):
        stack = [top]
        for kind, x in events(text):
            f = stack[-1]
            if kind == "k":
                before = f.names.get(x)
                if before is not None:  # the last writing counts
                    self.out[before[0] : before[1]] = [None] * (before[1] - before[0])
                f.names[x] = (len(self.out), len(self.out))
                f.name = x
                continue
            if kind == "{":
                stack.append(self._object(f, x))
                continue
            if kind == "[":
                stack.append(self._list(f, x))
                continue
            if kind == "s":
                self._text(f, x)
            elif kind == "v":
                if x != "null":
                    self._scalar(f, x)
            else:
                own = stack.pop()
                f = stack[-1]
                if own.leaf is not None and not own.objects and (own.index or own.canon not in self.repeated):
                    self.out.append((*own.leaf, text[own.begin : x]))
            if len(stack) > 1:  # else whoever reads the text around this one counts the value
                if f.kind == "{":
                    f.names[f.name] = (f.names[f.name][0], len(self.out))
                elif f.kind == "[":
                    f.index += 1


def repeated_names(df: DataFrame, payload: Column) -> set[str]:
    """The names that hold a list of objects in any record, as paths without ``[]``.

    Each task sends each path once; their number follows the schema, and is checked.
    """

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shred, seen = Shredder(set(), with_leaves=False), set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(a for a, *_ in shred(text) if a)
            if len(seen) > MAX_PATHS:
                break
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["ancestor"])

    found = df.select(payload.cast("string").alias("t")).mapInArrow(look, "ancestor string").distinct().limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:
        raise ValueError("names look like data; tell the repeated ancestors")
    return names_of([r.ancestor for r in found])


def triples(df: DataFrame, keys: dict[str, Column], payload: Column, ancestors: list[str] | None = None, with_leaves: bool = True, only: list[str] | None = None) -> DataFrame:
    """Every record's triples: the keys, ``ancestor``, ``pos``, ``leaf``, ``value``.

    The repeated names are those of ``ancestors``, whose tables come out; without them, all that the data have (which
    reads the data once more), and all tables, the record's own (``""``) too. ``only`` keeps some tables. Without leaves only the markers of objects come out.
    """
    taken = {"ancestor", "pos", "leaf", "value", "__payload"} & set(keys)
    if taken:
        raise ValueError(f"key names that the result has itself: {sorted(taken)}")
    repeated = repeated_names(df, payload) if ancestors is None else names_of(ancestors)
    wanted = only if only is not None else ancestors

    def parse(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shred = Shredder(repeated, None if wanted is None else set(wanted), with_leaves)
        for batch in batches:
            for part in (batch.slice(begin, 500) for begin in range(0, batch.num_rows, 500)):
                rows, ends, ordinals, tables, leaves, values = [], [0], [], [], [], []
                for row, text in enumerate(part.column(0).to_pylist()):
                    for table, pos, leaf, value in shred(text):
                        rows.append(row)
                        tables.append(table)
                        ordinals += pos
                        ends.append(len(ordinals))
                        leaves.append(leaf)
                        values.append(value)
                told = [pa.array(tables, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ordinals, pa.int32())), pa.array(leaves, pa.string()), pa.array(values, pa.string())]
                at = pa.array(np.array(rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[1:]), *told], names=[*part.schema.names[1:], "ancestor", "pos", "leaf", "value"])

    source = df.select(payload.cast("string").alias("__payload"), *(c.alias(n) for n, c in keys.items()))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(parse, fields + TRIPLES)


def _map_of(entry: Column) -> Column:
    """A map of an aggregated column of (leaf, value); where a key's records say different things of one leaf, the greatest value counts."""
    entries = F.array_sort(F.collect_list(entry))
    last = lambda a: F.filter(a, lambda x, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["leaf"] != x["leaf"]))
    return F.map_from_entries(F.element_at(F.transform(F.array(entries), last), 1))


def pivot_groups(found: DataFrame, keys: list[str]) -> DataFrame:
    """All groups pivoted in one go: the keys, ``ancestor``, ``pos``, ``parent_pos``, ``leaves`` (a map from leaf path to value).

    The triples of one object are in one task already, so the first of the two aggregations
    makes them one before anything is shuffled.
    """
    leaf = F.when(F.col("value").isNotNull(), F.struct("leaf", "value"))
    flat = found.groupBy(*keys, "ancestor", "pos").agg(_map_of(leaf).alias("leaves"))
    return flat.withColumn("parent_pos", F.slice("pos", F.lit(1), F.greatest(F.size("pos") - 1, F.lit(0))))


def pivot_group(found: DataFrame, keys: list[str], ancestor: str, columns: dict[str, str], rest: str | None = None) -> DataFrame:
    """One flat table of a group: the keys, ``pos``, ``parent_pos``, and a column for each leaf path.

    ``rest`` names a map column for the leaves that have no column; it's empty, not null, where there are none.
    """
    rows = found.where(F.col("ancestor") == ancestor)
    cells = [F.max(F.when(F.col("leaf") == path, F.col("value"))).alias(name) for name, path in columns.items()]
    if rest:
        other = F.when(F.col("value").isNotNull() & ~F.col("leaf").isin(*columns.values()), F.struct("leaf", "value"))
        cells.append(_map_of(other).alias(rest))
    flat = rows.groupBy(*keys, "pos").agg(*cells)
    return flat.withColumn("parent_pos", F.slice("pos", F.lit(1), F.greatest(F.size("pos") - 1, F.lit(0))))
