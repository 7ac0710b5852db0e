"""Incremental builds: rebuild only what changed since the stored results were made.

The store is append-only Parquet in a fixed number of buckets. A build adds its rows with
its number and the rows that each lecture has in it, so a lecture counts as stored only if
all rows of its newest build can be read; a build that failed, or a file that went bad,
leaves the lecture to be built again.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Rows of a lecture that one task writes; a longer lecture is written by several.
TASK_ROWS = 1 << 20
MARKS = ("fingerprint", "_build", "_rows", "_bucket")
#: The steps that a bundle must have reused to count as there already.
MAJOR_STEPS = {"asr_only": ("transcript",), "full": ("transcript", "segments", "slides", "ocr")}


def fingerprint(*cols: str | Column, version: str = "v1", settings: Mapping | None = None) -> Column:
    """Digest of the inputs and settings a result depends on, in a canonical form.

    Columns by name, nested settings by key at every level; columns that are null do not count.
    """
    named = sorted(cols, key=str)
    if settings is not None:
        named.append(F.lit(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)).alias("settings"))
    return F.sha2(F.to_json(F.struct(F.lit(version).alias("version"), *named)), 256)


def file_fingerprints(spark: SparkSession, root: str, pattern: str, *, settings: Mapping | None = None, version: str = "v1") -> DataFrame:
    """``path, fingerprint`` of every file under ``root`` whose name fits, from its path, size and modification time.

    The files themselves are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    at = files.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("modified"))
    return at.select("path", fingerprint("path", "size", "modified", version=version, settings=settings).alias("fingerprint"))


def read_results(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The newest whole build of every lecture, with its ``fingerprint``; a missing store is empty.

    ``schema`` is that of the records without the marks of the store. Files that cannot be read are left
    out, and with them the lectures that have rows in them, even if an older build is whole: it is stale anyway.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in fields if f.name not in MARKS]
    full = T.StructType([*kept, T.StructField("fingerprint", T.StringType()), T.StructField("_build", T.LongType()),
                         T.StructField("_rows", T.LongType()), T.StructField("_bucket", T.IntegerType())])
    try:
        rows = spark.read.schema(full).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)
    except AnalysisException:  # no store yet
        return spark.createDataFrame([], T.StructType([f for f in full if not f.name.startswith("_")]))
    newest = rows.groupBy("_bucket", "lecture_key", "_build").agg(F.count(F.lit(1)).alias("_n"), F.max("_rows").alias("_want"))
    first = F.row_number().over(Window.partitionBy("_bucket", "lecture_key").orderBy(F.desc("_build")))
    newest = newest.withColumn("_r", first).where("_r = 1 AND _n = _want").select("_bucket", "lecture_key", "_build")
    return rows.join(newest, ["_bucket", "lecture_key", "_build"], "left_semi").select(*[f.name for f in kept], "fingerprint")


def write_results(records: DataFrame, path: str, *, build: int) -> None:
    """Add the records (with ``lecture_key`` and ``fingerprint``) of whole lectures as build number ``build``.

    They replace what older builds hold of the same lectures; other lectures stay. Numbers must rise.
    """
    sizes = records.groupBy("lecture_key").agg(F.count(F.lit(1)).alias("_rows"))
    ids = [c for c in ("tree_path", "segment_id") if c in records.columns] or ["lecture_key"]
    placed = records.join(sizes, "lecture_key").withColumns({
        "_build": F.lit(build).cast("long"), "_bucket": F.pmod(F.xxhash64("lecture_key"), F.lit(BUCKETS)).cast("int"),
        "_part": F.pmod(F.xxhash64(*ids), F.ceil(F.col("_rows") / TASK_ROWS).cast("long"))})
    placed.repartition("_bucket", "_part").drop("_part").write.mode("append").partitionBy("_bucket").parquet(path)


def stale_lectures(wanted: DataFrame, stored: DataFrame, *, rebuild: bool = False) -> DataFrame:
    """Lectures whose ``(lecture_key, fingerprint)`` is not in the store."""
    if rebuild:
        return wanted
    return wanted.join(stored.select("lecture_key", "fingerprint").distinct(), ["lecture_key", "fingerprint"], "left_anti")


def request_status(requests: DataFrame, validated: DataFrame, *, dry_run: bool = False) -> DataFrame:
    """What to do with each requested bundle: valid ones are skipped, the rest processed."""
    valid = validated.where("ok").select("lecture_key").withColumn("_ok", F.lit(True))
    status = (F.when(F.lit(dry_run), "dry_run").when(F.col("_ok"), "skipped_existing").otherwise("to_process"))
    return requests.join(valid, "lecture_key", "left").withColumn("status", status).drop("_ok")


def outcome(processed: DataFrame, *, dry_run: bool = False) -> DataFrame:
    """Status and failing stage of processed bundles.

    ``mode`` (a key of ``MAJOR_STEPS``, any other is ``full``), ``error_stage`` (null or empty: none), ``valid`` (null: not
    validated) and ``reused_steps``. A step that failed decides first, then a dry run, then the validation; a bundle
    of which every major step was reused was there already.
    """
    broke = F.coalesce("error_stage", F.lit("")) != ""
    invalid = F.coalesce(~F.col("valid"), F.lit(False))
    need = F.lit(None).cast("array<string>")
    for mode, steps in MAJOR_STEPS.items():
        need = F.when(F.col("mode") == mode, F.array(*map(F.lit, steps))).otherwise(need)
    need = F.coalesce(need, F.array(*map(F.lit, MAJOR_STEPS["full"])))
    reused = F.size(F.array_except(need, F.coalesce("reused_steps", F.array().cast("array<string>")))) == 0
    status = (F.when(broke, "failed").when(F.lit(dry_run), "dry_run").when(invalid, "failed")
              .when(reused, "skipped_existing").otherwise("success"))
    stage = F.when(broke, F.col("error_stage")).when(~F.lit(dry_run) & invalid, "validate")
    return processed.withColumns({"status": status, "error_stage": stage})
