"""Photos as rows: listing, header dimensions, digests, decoding. Listing and digests are built-in; only image bytes
go through Arrow."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import IntegerType, StructField, StructType

from resight.schema import IMAGE_TYPES, SKIPPED_NAMES


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/?$", 1)


def is_image(path: Column) -> Column:
    """An image by its ending, not hidden, not one of the names that are no photos."""
    name = F.lower(name_of(path))
    return name.rlike(r"\.(" + "|".join(IMAGE_TYPES) + ")$") & ~name.isin(*SKIPPED_NAMES) & ~name.startswith(".")


def below(path: Column, folder: str) -> Column:
    """A path without the folder that it is in."""
    root = "/" + folder.split("://")[-1].split("/", 1)[-1].strip("/") + "/" if "://" in folder else "/" + folder.removeprefix("file:").strip("/") + "/"
    return F.replace(F.regexp_replace(path, "^[a-z0-9]+:/*", "/"), F.lit(root), F.lit(""))


def list_images(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path_rel (below folder), size, and content if asked for; in all subfolders. Without content no file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = files.select("path", F.col("length").alias("size"), *(["content"] if content else []))
    return base.filter(is_image(F.col("path"))).withColumn("path_rel", below(F.col("path"), folder)).drop("path")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """path_rel, decoded, image (height, width, nChannels, data) of the photos below folder, JPEG or PNG of any kind,
    decoded by Spark's image source in the JVM. Photos that can't be read stay, with decoded false."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).filter(is_image(F.col("image.origin")))
    return rows.select(below(F.col("image.origin"), folder).alias("path_rel"), (F.col("image.height") > 0).alias("decoded"), F.struct(*[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")]).alias("image"))


def dimensions(data: bytes | None) -> tuple[int, int]:
    """(width, height) from a PNG or JPEG header; (0, 0) if it is neither."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", data[16:24])
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    at += 1
                    continue
                kind = data[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return w, h
                at += 2 + (0 if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8 else struct.unpack(">H", data[at + 2 : at + 4])[0])
    except (struct.error, TypeError):
        pass
    return 0, 0


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def image_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions(c) for c in content], columns=["width", "height"])


def base_records(files: DataFrame) -> DataFrame:
    """files with content -> width, height, md5, defaults of the registry; without the content."""
    sized = files.withColumn("_d", image_size("content"))
    return sized.select("*", "_d.*", F.md5("content").alias("md5"), F.lit("unknown").alias("stage"), F.lit("none").alias("stage_source")).drop("_d", "content")
