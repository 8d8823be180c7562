"""Archives of JSON documents, and what decides whether they are read again."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_of(member: str, data: bytes) -> list[str]:
    """The JSON objects of a file, written with ASCII only: the objects of a top-level list, or a lone object; nothing of an unreadable file."""
    try:
        doc = json.loads(data)
    except (ValueError, RecursionError):
        return []
    return [json.dumps(x, ensure_ascii=True) for x in (doc if isinstance(doc, list) else [doc]) if isinstance(x, dict)]


def zip_members(spark: SparkSession, path: str, prefix: str, suffix: str, bytes_per_part: int) -> DataFrame:
    """``archive``, ``members`` (names): the wanted members of all ZIP files under ``path``, in groups of about ``bytes_per_part`` unpacked bytes.

    Only the directory at an archive's end is read; a file that is no archive gives nothing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path")  # the contents aren't read

    def list_(batches):
        import zipfile

        import pyarrow as pa

        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                try:
                    with open_file(name) as f, zipfile.ZipFile(f) as z:
                        part, size = [], 0
                        for m in z.infolist():
                            if not (m.filename.startswith(prefix) and m.filename.endswith(suffix)):
                                continue
                            if part and size + m.file_size > bytes_per_part:
                                out.append((name, part))
                                part, size = [], 0
                            part.append(m.filename)
                            size += m.file_size
                        if part:
                            out.append((name, part))
                except (OSError, ValueError, zipfile.BadZipFile):
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([m for _, m in out], pa.list_(pa.string()))], names=["archive", "members"])

    return files.mapInArrow(list_, "archive string, members array<string>")


def file_system(name: str):
    """The file system of a path or URI, and the path inside it."""
    from pyarrow import fs

    if name.startswith("file:/") and not name.startswith("file://"):
        name = "file://" + name.removeprefix("file:")
    return fs.FileSystem.from_uri(name if ":/" in name else f"file://{name}")


def open_file(name: str):
    """A file for random access."""
    system, path = file_system(name)
    return system.open_input_file(path)


def scan_zip(spark: SparkSession, path: str, prefix: str = "objects/", suffix: str = ".json", bytes_per_part: int = 64 << 20) -> DataFrame:
    """``archive``, ``member``, ``document`` of all ZIP files under ``path``.

    An archive is never read whole: its directory tells the members, groups of members are spread over the cluster,
    and each task reads its own one after the other. A member whose checksum doesn't hold, or that is no JSON, gives nothing.
    """

    def read(batches):
        import zipfile
        import zlib

        import pyarrow as pa

        for batch in batches:
            for name, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open_file(name) as f, zipfile.ZipFile(f) as z:
                        for m in members:
                            try:
                                found = documents_of(m, z.read(m))
                            except (zipfile.BadZipFile, zlib.error, EOFError):
                                continue
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([m] * len(found), pa.string()), pa.array(found, pa.string())], names=["archive", "member", "document"])
                except (OSError, ValueError, zipfile.BadZipFile):
                    pass

    groups = zip_members(spark, path, prefix, suffix, bytes_per_part).repartition(spark.sparkContext.defaultParallelism, F.xxhash64("archive", "members"))
    return groups.mapInArrow(read, "archive string, member string, document string")


def write_zips(rows: DataFrame, path: str) -> None:
    """Write ``archive`` (file name), ``member``, ``text`` as ZIP files under ``path``, a task for each archive."""

    def pack(batches):
        import zipfile

        import pyarrow as pa

        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        at = z = f = None
        for batch in batches:
            for archive, member, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != at:
                    if z:
                        z.close()
                        f.close()
                    at, f = archive, system.open_output_stream(f"{root}/{archive}")
                    z = zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED)
                z.writestr(member, text)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
        if z:
            z.close()
            f.close()

    rows.select("archive", "member", "text").repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(pack, "n bigint").agg(F.sum("n")).collect()


def write_files(rows: DataFrame, path: str) -> None:
    """Write ``name``, ``text`` as one file each under ``path``."""

    def save(batches):
        import pyarrow as pa

        system, root = file_system(path)
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    rows.select("name", "text").mapInArrow(save, "n bigint").agg(F.sum("n")).collect()


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """``member``, ``document`` of all JSON files under ``path``."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, d) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for d in documents_of(p, c)]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in rows], pa.string()), pa.array([d for _, d in rows], pa.string())], names=["member", "document"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, "member string, document string")


def merged_metadata(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Snapshot metadata with the new values that aren't null over the old ones."""
    fresh = new.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in new.columns if c != key))
    both = old.join(fresh, key, "full_outer")
    return both.select(key, *(F.coalesce(*(F.col(x) for x in (f"__{c}", c) if x in both.columns)).alias(c) for c in dict.fromkeys([*old.columns, *new.columns]) if c != key))


def unchanged(remote: DataFrame, known: DataFrame) -> DataFrame:
    """``archive``, ``skip``, ``reason``: same file token, else same ETag or modification time, and ingested before."""
    k = known.select("archive", *(F.col(c).alias(f"k_{c}") for c in ("token", "etag", "modified", "ingested_token")))
    same = lambda c: F.coalesce(F.col(c) == F.col(f"k_{c}"), F.lit(False))
    reason = F.when(same("token"), "token").when(same("etag"), "etag").when(same("modified"), "modified")
    both = remote.join(k, "archive", "left")
    loaded = F.col("k_ingested_token").eqNullSafe(F.col("k_token")) & F.col("k_token").isNotNull()
    return both.select("archive", (reason.isNotNull() & loaded).alias("skip"), F.coalesce(reason, F.lit("new")).alias("reason"))
