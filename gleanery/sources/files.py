"""Files below a folder as a source: names and sizes decide what is read, contents are read after that."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a directory scan reads and leaves out.
TEXT_EXTENSIONS = ("md", "txt", "py", "json", "yaml", "yml", "html")
SECRET_NAMES = (r"\.env", "credentials", "secrets", r"\.pem$", r"\.key$", "id_rsa")
LEAST_CHARS, LEAST_BYTES, MOST_BYTES = 20, 32, 2 * 1024 * 1024


def scan_files(spark: SparkSession, root: str, extensions=TEXT_EXTENSIONS, least: int = LEAST_BYTES, most: int = MOST_BYTES, skip_dirs: tuple[str, ...] = (), special: dict[str, int] | None = None) -> DataFrame:
    """Every file below ``root`` with the reason it is skipped (null: kept), without reading any content.

    The listing is the file source's, so it is split over the cluster. ``special`` allows larger files below
    the folders it names.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise(""))
    blocked = F.col("path").rlike("/(?:" + "|".join(map(re.escape, skip_dirs)) + ")/") if skip_dirs else F.lit(False)
    limit = F.lit(most)
    for folder, size in (special or {}).items():
        limit = F.when(F.contains("path", F.lit(f"/{folder}/")), F.lit(size)).otherwise(limit)
    reason = (
        F.when(name.startswith("."), "hidden")
        .when(F.lower(name).rlike("|".join(SECRET_NAMES)), "secret")
        .when(blocked, "directory")
        .when(~extension.isin(*extensions), "extension")
        .when(F.col("length") < least, "too_small")
        .when(F.col("length") > limit, "too_large")
    )
    return files.select("path", name.alias("name"), extension.alias("extension"), "length", "modificationTime", reason.alias("skipped"))


def read_files(spark: SparkSession, root: str, extensions=TEXT_EXTENSIONS, most: int = MOST_BYTES, **rules) -> DataFrame:
    """Kept files with their content: names and sizes are pushed into the file source, so nothing else is read."""
    pattern = "*.{" + ",".join(extensions) + "}"
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).filter(F.col("length") <= max([most, *(rules.get("special") or {}).values()]))
    kept = scan_files(spark, root, extensions, most=most, **rules).filter("skipped is null").select("path")
    return content.join(kept, "path", "left_semi").select("path", "length", "modificationTime", "content")


def scan_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(F.coalesce("skipped", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def decode_files(files: DataFrame) -> DataFrame:
    """``source, text, file_hash`` of read files of at least LEAST_CHARS; broken bytes become replacement marks."""
    texts = files.select(F.col("path").alias("source"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return texts.filter(F.length("text") >= LEAST_CHARS).withColumn("file_hash", F.md5("text"))
