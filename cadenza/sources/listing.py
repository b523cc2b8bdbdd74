"""Files listed by tasks, so that existence checks are joins and no list passes the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("is_folder", pa.bool_())])


def _entries(folder: str) -> list[fs.FileInfo]:
    """What a folder holds; nothing if it can't be read."""
    try:
        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        return system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    except (OSError, pa.ArrowException):
        return []


def list_folders(folders: DataFrame) -> DataFrame:
    """(path, size_bytes, is_folder): the entries of each folder (column path), one level deep.

    Folders are dealt over the tasks as rows; a missing one has no entries, a
    null or repeated one is looked at once. Paths begin as their folder does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = _entries(folder)
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [[f"{folder.rstrip('/')}/{f.base_name}" for f in part], [f.size for f in part], [f.type == fs.FileType.Directory for f in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)

    n = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = folders.select(F.col("path").cast("string").alias("path")).filter("path is not null").distinct().repartition(n)
    return dealt.mapInArrow(run, "path string, size_bytes long, is_folder boolean")


def list_tree(folders: DataFrame) -> DataFrame:
    """(path, size_bytes) of all files below the folders: one job a level, until a level has no folders."""
    from cadenza.tables import written

    found, level = None, folders
    while True:
        entries = written(list_folders(level), "listing")
        files = entries.filter("not is_folder").select("path", "size_bytes")
        found = files if found is None else found.unionByName(files)
        level = entries.filter("is_folder").select("path")
        if level.isEmpty():
            return found


def existing(paths: DataFrame) -> DataFrame:
    """(path): those of paths (column path) that are files, by listing the folders that they lie in.

    Each folder is listed once, however many of its files are asked for. Empty,
    null and repeated paths are left out.
    """
    asked = paths.select(F.col("path").cast("string").alias("path")).filter("path <> ''").distinct()
    folder = F.coalesce(F.nullif(F.regexp_replace("path", "/[^/]*$", ""), F.lit("")), F.lit("/"))
    there = list_folders(asked.select(F.when(F.col("path").contains("/"), folder).otherwise(".").alias("path")))
    name = F.when(F.col("path").contains("/"), F.col("path")).otherwise(F.concat(F.lit("./"), "path"))
    return asked.withColumn("_name", F.regexp_replace(name, "^//", "/")).join(there.filter("not is_folder").select(F.col("path").alias("_name")).distinct(), "_name", "left_semi").select("path")
