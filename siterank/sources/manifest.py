"""File manifests, checksum verification and the file inventory.

Hashes need a file's bytes in one task, in memory only for small files, so very large data belongs in many files; sizes
and roles are read without content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Bytes from which on a file is hashed as a stream: Spark's binary reader holds a file in memory and takes none of 2 GB or more.
STREAMED = 1 << 28
CHUNK = 1 << 22


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def _relative(root: str) -> Column:
    prefix = "file:" + root.rstrip("/") + "/" if root.startswith("/") else root.rstrip("/") + "/"
    return F.replace(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(prefix), F.lit(""))


def _opened(path: str):
    """A byte stream of a file that a Spark path names, local or of a file system that Arrow knows."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    store, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return store.open_input_stream(name)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with _opened(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], names=["path", "length", "sha256"])


def manifest(spark: SparkSession, root: str, pattern: str = "*", streamed: int = STREAMED) -> DataFrame:
    """Relative path, bytes and sha256 of every file below a folder; files of ``streamed`` bytes or more are never held whole."""
    files = _files(spark, root, pattern)
    held = files.where(F.col("length") < streamed).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") >= streamed).select("path", "length").mapInArrow(_stream_hashes, "path string, length long, sha256 string")
    return held.unionByName(large).select(_relative(root).alias("relative_path"), F.col("length").alias("bytes"), "sha256")


def verify_checksums(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Missing, unexpected, mismatching and matching files."""
    a = expected.select("relative_path", F.lower("sha256").alias("_e"))
    b = found.select("relative_path", F.lower("sha256").alias("_f"))
    status = (F.when(F.col("_f").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("_e") != F.col("_f"), "hash_mismatch").otherwise("ok"))
    return a.join(b, "relative_path", "full_outer").select("relative_path", status.alias("status"))


# Fixed role of a file by its suffix; the first row that lists the suffix decides.
ROLES = [
    ("executable_code", [".py", ".r", ".mjs", ".js", ".sh"]),
    ("spatial_data", [".tif", ".tiff", ".hgt", ".gz"]),
    ("vector_data", [".geojson", ".gpkg"]),
    ("tabular_data_or_result", [".csv", ".xlsx"]),
    ("documentation", [".docx", ".pdf", ".md", ".txt"]),
]


def classify_files(files: DataFrame) -> DataFrame:
    """Role and status of each ``relative_path``: a raw folder (or archived source) outranks the suffix."""
    parts = F.split("relative_path", "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    suffix = F.lower(F.regexp_extract("relative_path", r"[^/](\.[^./]+)$", 1))
    role = F.when(has("raw") | (suffix.isin(".zip", ".json") & has("source")), "source_or_frozen_input")
    for name, suffixes in ROLES:
        role = role.when(suffix.isin(suffixes), name)
    status = F.when(has("derived", "outputs", "deliverables"), "derived").when(has("inputs", "source"), "original_or_frozen_input").otherwise("project_working_file")
    out = files.withColumns({"file_type": F.when(suffix == "", "none").otherwise(suffix), "workflow_role": role.otherwise("other"), "data_status": status})
    return out.withColumn("reproducible", F.col("workflow_role").isin("executable_code", "documentation") | (F.col("data_status") == "derived"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder, classified without reading its content."""
    files = _files(spark, root, "*").select(_relative(root).alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return classify_files(files)
