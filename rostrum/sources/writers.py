"""Writers for tables, dumps, end times, slide text and segment documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators.quality import OCR_COLUMNS
from rostrum.operators.slides import normalize_ends


def write_csv(df: DataFrame, path: str, columns: list[str], *, single: bool = False) -> None:
    """CSV with a header and a fixed column order; ``single`` is for summaries of a few rows."""
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run_summary(df: DataFrame, path: str) -> None:
    """One JSON object out of a one-row table."""
    df.coalesce(1).write.mode("overwrite").json(path)


def slide_end_lines(ends: DataFrame) -> DataFrame:
    """Cleaned end times as text lines with four decimals."""
    kept = normalize_ends(ends)
    return kept.select("lecture_key", "slide_index", F.format_string("%.4f", "end").alias("value"))


def write_slide_ends(ends: DataFrame, path: str) -> None:
    """One folder per lecture, lines in order; refuses an empty result."""
    lines = slide_end_lines(ends)
    if lines.limit(1).count() == 0:
        raise ValueError("no valid slide end times")
    (lines.repartition("lecture_key").sortWithinPartitions("lecture_key", "slide_index").drop("slide_index")
     .write.mode("overwrite").partitionBy("lecture_key").text(path))


def normalize_ocr_table(df: DataFrame) -> DataFrame:
    """Slide text table in its fixed columns: missing ones empty, text never null, confidence numeric."""
    have = set(df.columns)
    out = df.withColumns({c: F.lit("") for c in OCR_COLUMNS if c not in have})
    return out.select(*OCR_COLUMNS).withColumns({
        "text": F.coalesce(F.col("text").cast("string"), F.lit("")), "conf": F.col("conf").cast("string").try_cast("double")})


def segment_dump(rows: DataFrame, *, field: str = "asr_segments", id_col: str = "segment_id") -> DataFrame:
    """Segments nested per lecture in id order; the dump's own format asks for one object per lecture."""
    seg = F.struct(F.col(id_col), F.col("start"), F.col("end"), F.col("text"))
    return rows.groupBy("lecture_key").agg(F.array_sort(F.collect_list(seg)).alias(field))


def segment_documents(rows: DataFrame) -> DataFrame:
    """One text document per segment: title, rule, facts, rule, text."""
    rule = F.lit("=" * 60)
    body = F.concat_ws(
        "\n", F.format_string("Segment %d", "segment_id"), rule, F.concat(F.lit("Identifier: "), F.col("tree_path")),
        F.format_string("Start Time: %.2fs", "start"), F.format_string("End Time: %.2fs", "end"),
        F.format_string("Duration: %.2fs", F.col("end") - F.col("start")),
        F.format_string("Number of Utterances: %d", "n_utterances"), rule, F.lit(""), "text")
    return rows.select("lecture_key", "segment_id", body.alias("value"))


def write_segment_documents(rows: DataFrame, path: str) -> None:
    (segment_documents(rows).repartition("lecture_key", "segment_id")
     .write.mode("overwrite").partitionBy("lecture_key", "segment_id").text(path))
