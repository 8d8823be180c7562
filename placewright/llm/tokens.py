"""Encoding of a corpus with a byte-level BPE vocabulary.

Method: a pair of bytes that occurs inside no vocabulary token can never be
bridged by a merge, so the text may be cut there, the fragments encoded on their
own, and the ids concatenated. Nearly every boundary between a letter and a
space is such a cut, so fragments are short and repeat; each distinct fragment
is encoded once per worker process and batch run.

A cut must also leave the vocabulary's pre-splitting pattern as it is. That
holds if the byte before it ends a letter or digit, and the byte after it is a
space followed by a letter, digit or ASCII symbol that isn't an apostrophe: the
pattern itself then splits there, and neither of its look-aheads sees across.

Defined results: an empty list for null and for empty text; strings of special
tokens are ordinary text; texts of any length are encoded whole; one row for
each row, in whatever order; extra columns are ignored.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's pre-splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments remembered by a worker process; beyond it the memory starts anew (results don't depend on it).
REMEMBERED = 200_000


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabularies keep the file ``name``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _memory() -> dict:
    """State of a worker process that outlives the functions shipped to it."""
    import sys
    import types

    return sys.modules.setdefault("_placewright_memory", types.ModuleType("_placewright_memory")).__dict__


def load(path: str):
    """The encoding of a rank file, and ``bridged[a, b]``: bytes a, b are neighbours inside some token."""
    memory = _memory()
    if path not in memory:
        import base64

        import numpy as np
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        bridged = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            b = np.frombuffer(token, dtype=np.uint8)
            bridged[b[:-1], b[1:]] = True
        memory[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), bridged, {}
    return memory[path]


def forced_cuts(data, bridged):
    """Positions in ``data`` (bytes as an array) before which a text may be cut."""
    import numpy as np

    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    a, b, c = data[:-2], data[1:-1], data[2:]
    lower, digit = (a | 32) - 97 < 26, a - 48 < 10  # unsigned: below the range wraps to large numbers
    after = (c > 32) & (c < 127) & (c != 39)
    return np.flatnonzero(~bridged[a, b] & (b == 32) & (lower | digit) & after) + 1


def encode_column(texts, path: str):
    """Ids of an Arrow string column, as an Arrow column of lists."""
    import numpy as np
    import pyarrow as pa

    encoding, bridged, known = load(path)
    flat: list[int] = []
    ends = np.zeros(len(texts) + 1, dtype=np.int32)
    for row, text in enumerate(texts.to_pylist()):
        if text:
            raw = text.encode()
            cuts = forced_cuts(np.frombuffer(raw, dtype=np.uint8), bridged).tolist()
            begin = 0
            for end in (*cuts, len(raw)):
                piece = raw[begin:end]
                ids = known.get(piece)
                if ids is None:
                    ids = encoding.encode_ordinary(piece.decode())
                    if len(piece) <= 64:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[piece] = ids
                flat += ids
                begin = end
        ends[row + 1] = len(flat)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, dtype=np.int32)))


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``ids``: the token ids of ``text`` under the rank file at ``path`` (readable on every executor)."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), path)], names=["k", "ids"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)
