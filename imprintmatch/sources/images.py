"""Image files as binary rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("jpg", "jpeg", "png", "webp")


def image_kind(content: Column) -> Column:
    """jpeg, png or webp by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    webp = F.startswith(head, F.lit("52494646")) & F.endswith(head, F.lit("57454250"))
    return F.when(F.startswith(head, F.lit("FFD8FF")), "jpeg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png").when(webp, "webp")


def read_images(spark: SparkSession, path: str, decode: bool = False) -> tuple[DataFrame, DataFrame]:
    """((path, content, kind) of images, (path, reason) of the others); the suffix and the first bytes decide.

    decode: jpeg and png files must also be images that Spark's image source can decode (reason: decode).  It
    does not know webp, which is judged by its first bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.withColumns({"_named": suffix.isin(*SUFFIXES), "kind": image_kind(F.col("content"))})
    reason = F.when(~F.col("_named"), "suffix").when(F.col("kind").isNull(), "content")
    if decode:
        bare = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
        seen = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path)
        seen = seen.filter("image.width > 0").select(bare(F.col("image.origin")).alias("_path"), F.lit(True).alias("_seen"))
        files = files.join(seen, bare(F.col("path")) == F.col("_path"), "left")
        reason = reason.when(F.col("_seen").isNull() & (F.col("kind") != "webp"), "decode")
    files = files.withColumn("reason", reason)
    return files.filter("reason is null").select("path", "content", "kind"), files.filter("reason is not null").select("path", "reason")


def bgr_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, w, h, channels, data) of the decoded jpeg and png images under path: lines of blue, green and red bytes, or of one grey byte."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*").filter("width > 0")
    return image.select(F.col("origin").alias("path"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("nChannels").alias("channels"), "data")


def masked_images(images: DataFrame, key: str = r"([^/.]+)(?:\.mask)?\.[^/.]+$", mask: str = r"\.mask\.[^/.]+$") -> DataFrame:
    """(roi_id, w, h, channels, data, mask) of images whose masks are grey images of their own.

    key: a pattern whose first group is the region's number; mask: a pattern that only paths of masks have.  A mask of
    another size than its image counts as none.
    """
    named = images.withColumns({"roi_id": F.regexp_extract("path", key, 1).cast("long"), "is_mask": F.col("path").rlike(mask)})
    # Images and masks come from one pass over the files; rows without a number have no mask and stay apart.
    own, mask = F.when(~F.col("is_mask"), F.struct("w", "h", "channels", "data")), F.when(F.expr("is_mask and channels = 1 and roi_id is not null"), F.struct(F.col("w").alias("mask_w"), F.col("h").alias("mask_h"), F.col("data").alias("mask")))
    alone = F.when(F.col("roi_id").isNull(), F.col("path")).alias("_alone")
    files = named.groupBy("roi_id", alone).agg(F.collect_list(own).alias("own"), F.collect_list(mask).alias("masks"))
    rows = files.select("roi_id", "masks", F.inline("own")).select("roi_id", "w", "h", "channels", "data", F.inline_outer("masks"))
    fits = (F.col("w") == F.col("mask_w")) & (F.col("h") == F.col("mask_h"))
    return rows.select("roi_id", "w", "h", "channels", "data", F.when(fits, F.col("mask")).alias("mask"))


def png_bytes(image: np.ndarray) -> bytes:
    """A png file of an array of lines of grey bytes, or of red, green and blue bytes."""
    h, w = image.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], 1)  # every line begins with its filter

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def jpeg_bytes(spark: SparkSession, image: np.ndarray) -> bytes:
    """A jpeg file of an array of lines of red, green and blue bytes, by the JVM's own encoder."""
    jvm, (h, w) = spark._jvm, image.shape[:2]
    drawn = jvm.java.awt.image.BufferedImage(w, h, 1)  # TYPE_INT_RGB
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, image[y, x])
            drawn.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(drawn, "jpg", out)
    return bytes(out.toByteArray())


def make_folder(path: str, new: bool = False) -> None:
    """new: fails where there is one already."""
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(path)
    if new and fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise FileExistsError(path)
    fs.create_dir(at, recursive=True)


def open_file(path: str):
    """A new file for writing, from a task, and the folders above it."""
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(at)


def write_file(path: str, content: bytes) -> None:
    """A whole file, from a task; a repeated task writes the same again."""
    import pyarrow.fs as pafs

    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_output_stream(at) as f:
        f.write(content)


def write_png(path: str, image: np.ndarray) -> None:
    write_file(path, png_bytes(image))
