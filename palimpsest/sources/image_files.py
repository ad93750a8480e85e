"""Image files as rows: binary files with their EXIF orientation. Pixels are decoded elsewhere."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# EXIF orientations that are plain rotations; all others leave the image as it is.
DEGREES = {6: 90, 3: 180, 8: 270}
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def orientation_tag(data: bytes | None) -> int:
    """The orientation of a JPEG's first image directory, 1 where there is none or it can't be read."""
    if not data or data[:2] != b"\xff\xd8":
        return 1
    at = 2
    try:
        while data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack_from(">H", data, at + 2)[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                base = at + 10
                order = {b"II": "<", b"MM": ">"}[bytes(data[base : base + 2])]
                directory = base + struct.unpack_from(order + "I", data, base + 4)[0]
                for k in range(struct.unpack_from(order + "H", data, directory)[0]):
                    tag, _, _, value = struct.unpack_from(order + "HHIH", data, directory + 2 + 12 * k)
                    if tag == 0x0112:
                        return value
            at += 2 + size
    except (IndexError, KeyError, struct.error):
        pass
    return 1


@F.pandas_udf(T.IntegerType())
def rotation(content: pd.Series) -> pd.Series:
    """Clockwise degrees that turn the stored image upright."""
    return content.map(lambda b: DEGREES.get(orientation_tag(b), 0)).astype("int32")


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("rotation", rotation("content"))


def read_image_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New files as they arrive, a bounded number for each trigger."""
    stream = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return stream.withColumn("rotation", rotation("content"))
