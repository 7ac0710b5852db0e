"""Readers for lecture directories, question files, dumps and meeting corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum.functions.text import strip
from rostrum.functions.times import parse_id_list
from rostrum.operators.quality import csv_cells, repair_range_rows, timestamp_examples
from rostrum.plans.ordered import ordered_scan

# File names of a lecture directory.
TRANSCRIPT_GLOB = "*_transcripts.csv"
SEGMENTS_FILE = "segments.txt"
SLIDE_OCR = r"(?i)slide_(\d+)_ocr\.csv$"
PLACE = r"([^/]+)/([^/]+)/([^/]+)/[^/]+$"


def _lecture(path: Column) -> dict[str, Column]:
    part = lambda i: F.regexp_extract(path, PLACE, i)
    return {"lecture_key": F.concat_ws("/", part(1), part(2), part(3)), "speaker": part(1),
            "course_dir": part(2), "meeting_id": part(3)}


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Paths below a root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path")


def discover_lectures(spark: SparkSession, root: str) -> DataFrame:
    """Directories ``speaker/course/meeting`` that hold a transcript; the first name wins if several do."""
    name = F.element_at(F.split("path", "/"), -1)
    found = _files(spark, root, TRANSCRIPT_GLOB).withColumn("name", name).withColumns(_lecture(F.col("path")))
    keys = ["lecture_key", "speaker", "course_dir", "meeting_id"]
    first = found.groupBy(*keys).agg(F.min_by("path", "name").alias("transcripts_path"), F.min("name").alias("name"))
    return first.select(*keys, F.regexp_replace("name", "_transcripts\\.csv$", "").alias("video_id"), "transcripts_path",
                        F.regexp_replace("transcripts_path", "/[^/]+$", "").alias("meeting_dir"))


def _positions(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """File order: split offset, then order within the split, numbered per key."""
    with_pos = rows.withColumns({"_at": F.col("_metadata.file_block_start"), "_m": F.monotonically_increasing_id()})
    return ordered_scan(with_pos, keys, ["_at", "_m"], block=F.col("_at"), number=out).drop("_at", "_m")


def read_words(spark: SparkSession, root: str) -> DataFrame:
    """Raw transcript cells of all lectures below a root, in file order."""
    raw = (spark.read.schema("Word string, Start string, End string").option("header", "true")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", TRANSCRIPT_GLOB).csv(root))
    rows = raw.select("Word", "Start", "End", "_metadata", _lecture(F.col("_metadata.file_path"))["lecture_key"].alias("lecture_key"))
    return _positions(rows, ["lecture_key"], "ord").drop("_metadata")


def read_slide_lines(spark: SparkSession, root: str) -> DataFrame:
    """Non-blank lines of the end-time files with their number; ``end`` is null where a line is no number."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", SEGMENTS_FILE).text(root)
           .select("value", "_metadata"))
    rows = raw.withColumn("lecture_key", _lecture(F.col("_metadata.file_path"))["lecture_key"]).where(strip("value") != "")
    placed = _positions(rows, ["lecture_key"], "line").drop("_metadata")
    return placed.select("lecture_key", "line", strip("value").try_cast("double").alias("end"))


def read_slide_ends(spark: SparkSession, root: str) -> DataFrame:
    """End times in file order; lines that are no numbers are dropped."""
    lines = read_slide_lines(spark, root).where(F.col("end").isNotNull())
    return ordered_scan(lines, ["lecture_key"], "line", number="slide_index").select("lecture_key", "slide_index", "end")


def read_ocr_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Recognised slide tokens; the slide index comes from the file name."""
    cols = "level,page_num,block_num,par_num,line_num,word_num,left,top,width,height,conf,text".split(",")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    raw = (spark.read.schema(schema).option("header", "true").option("enforceSchema", "false")
           .option("recursiveFileLookup", "true").option("pathGlobFilter", "*_ocr.csv").csv(root))
    name = F.col("_metadata.file_name")
    rows = raw.select(*cols, name.alias("_f"), _lecture(F.col("_metadata.file_path"))["lecture_key"].alias("lecture_key"))
    whole = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)
    return rows.where(F.col("_f").rlike(SLIDE_OCR)).select(
        "lecture_key", F.regexp_extract("_f", SLIDE_OCR, 1).cast("long").alias("slide_index"),
        *[whole(c) for c in ("block_num", "par_num", "line_num", "word_num")], F.col("conf").try_cast("double").alias("conf"), "text")


def read_range_questions(spark: SparkSession, path: str) -> DataFrame:
    """Time-range questions with rows mended that an unquoted comma split, by however many cells."""
    named = ["question", "lecture_key", "answer_timestamps", "answer_text", "question_type"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*named, "_record"]])
    raw = (spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_record").option("quote", '"').option("escape", '"').option("multiLine", "true").csv(path))
    # Spark hands over the whole record where its cells do not fit the schema.
    more = F.slice(csv_cells("_record"), len(named) + 1, F.greatest(F.size(csv_cells("_record")), F.lit(0)))
    rows = _positions(raw.select(*named, more.alias("_more"), "_metadata"), [], "n").drop("_metadata").withColumn("row_index", F.col("n") + 1)
    return repair_range_rows(rows.drop("n"), "_more")


def read_timestamp_questions(spark: SparkSession, path: str, split: str, *, limit: int | None = None) -> DataFrame:
    raw = (spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true")
           .schema("url string, id string, question string, answer string, timestamp string").csv(path))
    rows = _positions(raw.select("*", "_metadata"), [], "n").drop("_metadata").withColumn("row_index", F.col("n") + 1)
    rows = rows if limit is None else rows.where(F.col("row_index") <= limit)
    return timestamp_examples(rows, split)


def read_id_questions(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.option("header", "true").option("ignoreLeadingWhiteSpace", "true").option("quote", '"').option("escape", '"')
           .schema("question string, lecture_key string, asr_segment_ids string, ocr_slide_indices string").csv(path))
    return raw.select("question", strip("lecture_key").alias("lecture_key"), parse_id_list("asr_segment_ids").alias("asr_segment_ids"),
                      parse_id_list("ocr_slide_indices").alias("ocr_slide_indices"))


def read_segment_dump(spark: SparkSession, path: str, *, field: str = "asr_segments", id_col: str = "segment_id") -> DataFrame:
    """Rows of a dump of lectures with nested segments; a repeated id keeps its last text."""
    schema = f"lecture_key string, {field} array<struct<{id_col}:bigint,start:double,end:double,text:string>>"
    raw = spark.read.schema(schema).option("multiLine", "true").json(path)
    flat = raw.where(F.col("lecture_key") != "").select("lecture_key", F.posexplode(field).alias("p", "s"))
    flat = flat.select("lecture_key", "p", "s.*").where(F.col(id_col).isNotNull())
    last = flat.groupBy("lecture_key", id_col).agg(F.max_by(F.struct("start", "end", "text"), "p").alias("w"))
    return last.select("lecture_key", id_col, "w.*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; no file gives no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], schema)


# --- meeting corpora ----------------------------------------------------------------

# One element of a flat word file: name, attributes, and text or references inside.
_ELEMENT = (r"(?s)<([A-Za-z][\w:.-]*)((?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*"
            r"(?:/>|>([^<]*)(?:<nite:child[^>]*?(?:/>|>\s*</nite:child>)\s*)*</\1>)")


def _attr(raw: str | Column, name: str) -> Column:
    col = F.col(raw) if isinstance(raw, str) else raw
    got = F.regexp_extract(col, rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    return F.when(got != "", got)


def _unescape(x: Column) -> Column:
    x = _references(x)
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def _references(x: Column) -> Column:
    """Numeric character references to their characters; text that only looks like one stays."""

    def piece(s: Column, i: Column) -> Column:
        number = F.regexp_extract(s, "^([xX][0-9A-Fa-f]+|[0-9]+);", 1)
        code = F.when(F.lower(number).startswith("x"), F.conv(F.substring(number, 2, 20), 16, 10)).otherwise(number).try_cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (F.when(i == 0, s).when((number == "") | ~code.between(1, 0x10FFFF), F.concat(F.lit("&#"), s))
                .otherwise(F.concat(char, F.regexp_replace(s, "^[^;]*;", ""))))

    return F.array_join(F.transform(F.split(x, "&#"), piece), "")


def _documents(spark: SparkSession, root: str, glob: str) -> DataFrame:
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
           .load(root).select("content", F.col("_metadata.file_name").alias("file")))
    named = F.upper(F.regexp_extract(F.decode(F.substring("content", 1, 200), "ISO-8859-1"), "encoding\\s*=\\s*[\"']([^\"']+)[\"']", 1))
    raw = raw.select(F.when(named.isin("ISO-8859-1", "LATIN1"), F.decode("content", "ISO-8859-1"))
                     .when(named == "UTF-16", F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8")).alias("value"), "file")
    body = F.regexp_replace("value", r"(?s)<\?.*?\?>|<!--.*?-->", "")
    name = F.split("file", r"\.")
    return raw.select(body.alias("value"), name[0].alias("meeting"), name[1].alias("speaker"))


def read_meeting_words(spark: SparkSession, root: str) -> DataFrame:
    """Elements of the word files in order; those without text keep their place with a null text."""
    inner = F.regexp_replace("value", r"(?s)^\s*<[^>]*>|</[^>]*>\s*$", "")
    docs = _documents(spark, root, "*.words.xml").withColumn("value", inner)
    found = docs.select("meeting", "speaker", F.posexplode(F.regexp_extract_all("value", F.lit(_ELEMENT), F.lit(0))).alias("pos", "el"))
    head = F.regexp_extract("el", r"(?s)^<[^>]*>", 0)
    text = F.trim(_unescape(F.regexp_extract("el", r"(?s)^<[^>]*[^/]>([^<]*)<", 1)))
    return found.select(
        "meeting", "speaker", F.col("pos").cast("long").alias("pos"), _attr(head, "nite:id").alias("word_key"),
        _attr(head, "c").alias("cls"), F.when(text != "", text).alias("text"),
        _attr(head, "starttime").try_cast("double").alias("start"), _attr(head, "endtime").try_cast("double").alias("end"))


def read_meeting_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments with the word range of their first child; segments within segments are flattened."""
    docs = _documents(spark, root, "*.segs.xml")
    pattern = r"(?s)<segment\b[^>]*[^/]>\s*<nite:child\b[^>]*>"
    found = docs.select("meeting", "speaker", F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(0))).alias("el"))
    head, href = F.regexp_extract("el", r"(?s)^<[^>]*>", 0), _attr(F.regexp_extract("el", r"(?s)<nite:child[^>]*>$", 0), "href")
    ends = F.split(F.element_at(F.split(href, "#"), -1), r"\.\.(?=id\()")
    key = lambda c: F.regexp_extract(c, r"id\(([^)]*)\)", 1)
    start = _attr(head, "starttime").try_cast("double")
    return found.select(
        "meeting", "speaker", _attr(head, "nite:id").alias("utt_key"), start.alias("start"),
        F.coalesce(_attr(head, "endtime").try_cast("double"), start + 1.0).alias("end"),
        key(ends[0]).alias("start_key"), key(F.element_at(ends, -1)).alias("end_key"))


def read_topic_tree(spark: SparkSession, root: str) -> DataFrame:
    """Nodes of the topic files: path ``*.0.1``, whether a leaf, and the child references of leaves.

    Loose references between topics become leaves of their own. A topic with neither topics nor references
    is a leaf with no reference and ``error`` ``empty_topic``, which counts as a place among its siblings; a file that is
    no XML is one row, the root, with ``error`` ``unreadable``. A topic file is one small document per meeting,
    walked within its row.
    """
    import xml.etree.ElementTree as ET

    import pandas as pd

    def walk(node, path: str) -> list[tuple[str, bool, list[str], str | None]]:
        kids = [k for k in node if "pointer" not in k.tag]
        refs = lambda ks: [k.attrib["href"] for k in ks if k.attrib.get("href")]
        if not any(k.tag == "topic" for k in kids):
            return [(path, True, refs(kids), None if refs(kids) else "empty_topic")]
        out, loose, n = [(path, False, [], None)], [], 0
        for kid in [*kids, None]:
            if kid is not None and kid.tag != "topic":
                loose.append(kid)
                continue
            if refs(loose):
                out.append((f"{path}.{n}", True, refs(loose), None))
                n += 1
            loose = []
            if kid is not None:
                out += walk(kid, f"{path}.{n}")
                n += 1
        return out

    def rows_of(text: str) -> list[tuple[str, bool, list[str], str | None]]:
        try:
            return walk(ET.fromstring(text), "*")
        except ET.ParseError:
            return [("*", True, [], "unreadable")]

    def parse(batches):
        for pdf in batches:
            rows = [(m, *r) for m, v in zip(pdf["meeting"], pdf["value"]) for r in rows_of(v)]
            yield pd.DataFrame(rows, columns=["meeting", "path", "is_leaf", "refs", "error"])

    docs = _documents(spark, root, "*.topic.xml").select("meeting", "value")
    return docs.mapInPandas(parse, "meeting string, path string, is_leaf boolean, refs array<string>, error string")
