"""Detector classes, label files and result files."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import make_folder, open_file, write_file

#: The 38 classes of the detector.
ALPHABET = [*"0123456789", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "-", "."]


def read_class_map(spark: SparkSession, names: list[str] | dict[int, str] | None = None) -> DataFrame:
    """(class_id, ch) from a list or an index; fewer than two names give the default classes."""
    if isinstance(names, dict):
        names = [names[k] for k in sorted(names, key=int)]
    if not names or len(names) < 2:
        names = ALPHABET
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("class_id", "ch"))


def _folder(split: str, stem: str) -> str:
    """split=.../stem=..., with marks escaped as Spark escapes values of partitions."""
    bare = lambda v: re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda m: f"%{ord(m[0]):02X}", v) or "__HIVE_DEFAULT_PARTITION__"
    return f"split={bare(split)}/stem={bare(stem)}"


def write_yolo_labels(boxes: DataFrame, path: str) -> None:
    """boxes (split, stem, line_no, class_id, cx, cy, w, h) as one text file per split and stem, in split=.../stem=... folders.

    A file's lines come in order of a sorted partition and go straight to its writer, however many they are.  Files are
    many and small, so tasks write them at their place, where a repeated task writes the same again; renaming each on
    commit would cost more than its lines.  _SUCCESS comes last.
    """
    line = F.format_string("%d %.6f %.6f %.6f %.6f\n", "class_id", "cx", "cy", "w", "h")
    names = [F.coalesce(c, F.lit("")).alias(c) for c in ("split", "stem")]
    lines = boxes.select(*names, "line_no", line.alias("value")).repartition("split", "stem").sortWithinPartitions("split", "stem", "line_no", "value")

    def write(batches):
        last, file = None, None
        for batch in batches:
            split, stem, value = batch.column("split"), batch.column("stem"), batch.column("value").cast(pa.large_string())
            if not len(value):
                continue
            ends = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
            new = pc.or_(pc.not_equal(split[1:], split[:-1]), pc.not_equal(stem[1:], stem[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(value)]
            for i, j in zip(starts, starts[1:]):
                if (split[i].as_py(), stem[i].as_py()) != last:
                    if file:
                        file.close()
                    last = split[i].as_py(), stem[i].as_py()
                    file = open_file(f"{path}/{_folder(*last)}/labels.txt")
                file.write(value.buffers()[2].slice(ends[i], ends[j] - ends[i]))
            yield pa.RecordBatch.from_pydict({"n": [len(value)]})
        if file:
            file.close()

    make_folder(path, new=True)
    lines.select("split", "stem", "value").mapInArrow(write, "n long").count()
    write_file(f"{path}/_SUCCESS", b"")


def read_yolo_labels(spark: SparkSession, path: str, classes: DataFrame | None = None) -> DataFrame:
    """(split, stem, line_no, class_id, cx, cy, w, h), and ch with classes.

    split and stem come from split=.../stem=... folders, or from .../<split>/<stem>.txt.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    by_folder = F.col("file").rlike(r"/split=[^/]+/stem=")
    split = F.when(by_folder, F.regexp_extract("file", r"/split=([^/]+)/", 1)).otherwise(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))
    stem = F.when(by_folder, F.regexp_extract("file", r"/stem=([^/]+)/", 1)).otherwise(F.regexp_extract("file", r"/([^/]+)\.txt$", 1))
    lines = files.select(split.alias("split"), stem.alias("stem"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line")).filter(F.trim("line") != "")
    part = F.split(F.trim("line"), r"\s+")
    rows = lines.select("split", "stem", "line_no", F.get(part, F.lit(0)).cast("int").alias("class_id"), *[F.get(part, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)])
    return rows.join(F.broadcast(classes), "class_id", "left") if classes is not None else rows


def new_run_id() -> str:
    return f"{datetime.now():%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def write_results(responses: DataFrame, path: str, run_id: str | None = None, form: str = "parquet") -> str:
    """Nested responses under run_id=...; returns the run id."""
    run_id = run_id or new_run_id()
    responses.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(form).save(path)
    return run_id
