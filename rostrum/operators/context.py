"""Context for an answering model: evidence blocks and the character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import BLANK, clean_text, or_blank, slide_part, spoken_part, strip
from rostrum.functions.times import plain_number

# Fixed value: default length of a context.
MAX_CHARS = 8000
NO_CONTEXT = "<no context retrieved>"


def _labelled(label: str, x: Column) -> Column:
    return F.concat(F.lit(label), x.cast("string"))


def hit_header(score: Column) -> Column:
    """Header of a hit: rank, score, lecture, tree place, slide or segment, time."""
    tree = F.col("index_kind") == "summary_tree"
    leaf = F.coalesce(F.col("is_leaf"), F.lit(True))
    return F.concat_ws(
        " ", F.format_string("[%d]", "rank"),
        F.when(score.isNotNull(), F.format_string("score=%.3f", score)), F.when(F.col("lecture_key") != "", F.col("lecture_key")),
        F.when(tree, F.when(leaf, F.lit("leaf")).otherwise(F.lit("summary-node"))),
        F.when(tree, _labelled("depth=", F.col("depth"))),
        F.when(tree & (F.col("tree_path") != ""), _labelled("path=", F.col("tree_path"))),
        F.coalesce(_labelled("slide=", F.col("slide_index")), _labelled("seg=", F.col("segment_id"))),
        F.concat(F.lit("time="), plain_number("start"), F.lit("-"), plain_number("end"), F.lit("s")))


def leaf_block(score: Column, *, include_ocr: bool = True) -> Column:
    """Block of a leaf, chunk or segment: header, speech, and slide text if asked; empty without text."""
    parts = [hit_header(score), F.concat(F.lit("Spoken:\n"), or_blank(spoken_part("text")))]
    if include_ocr:
        parts.append(F.concat(F.lit("Slide OCR:\n"), or_blank(slide_part("text"))))
    return F.when(strip(F.coalesce("text", F.lit(""))) == "", F.lit("")).otherwise(F.concat_ws("\n", *parts))


def node_block(score: Column) -> Column:
    """Block of an inner tree node: its summary and the evidence of its leaves."""
    body = or_blank(strip(F.coalesce(F.when(F.col("summary_text") != "", F.col("summary_text")), F.col("text"), F.lit(""))))

    def evidence(x: Column, i: Column) -> Column:
        head = F.concat_ws(" ", F.concat(F.lit("Leaf "), (i + 1).cast("string")), _labelled("seg=", x["segment_id"]),
                           F.concat(F.lit("time="), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit("s")))
        return F.concat(head, F.lit("\nSpoken:\n"), or_blank(spoken_part(x["text"])),
                        F.lit("\nSlide OCR:\n"), or_blank(slide_part(x["text"])))

    blocks = F.array_join(F.transform("supporting_leaves", evidence), "\n\n")
    return F.concat(hit_header(score), F.lit("\nSummary Node:\n"), body, F.lit("\nSupporting Leaf Evidence:\n"),
                    F.when(F.size("supporting_leaves") > 0, blocks).otherwise(F.lit(BLANK)))


def tree_block(score: Column) -> Column:
    return F.when(F.coalesce(F.col("is_leaf"), F.lit(True)), leaf_block(score)).otherwise(node_block(score))


def slide_block(score: Column) -> Column:
    """Block of a slide hit."""
    said = strip(F.coalesce("text", F.lit("")))
    return F.when(said == "", F.lit("")).otherwise(F.concat(hit_header(score), F.lit("\nSlide OCR:\n"), said))


def time_span(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.format_string("time=%.2f-%.2fs", start, end))


def transcript_block(*, include_ocr: bool = False) -> Column:
    """Short block of a leaf or chunk: segment, time, transcript on one line."""
    head = F.concat_ws(" ", F.format_string("[%d]", "rank"), _labelled("seg=", F.col("segment_id")),
                       time_span(F.col("start"), F.col("end")))
    if include_ocr:
        return F.concat(head, F.lit("\nTranscript:\n"), or_blank(clean_text(spoken_part("text"))),
                        F.lit("\nSlide OCR:\n"), or_blank(clean_text(slide_part("text"))))
    return F.concat(head, F.lit("\nTranscript:\n"), or_blank(plain_speech(F.col("text"))))


def plain_speech(text: Column) -> Column:
    """Spoken part on one line; the whole text where nothing is marked as spoken."""
    said = spoken_part(text)
    return clean_text(F.when(said != "", said).otherwise(text))


def tree_transcript_block() -> Column:
    """Short block of a tree hit: leaf transcript, or summary with supporting transcripts."""
    leaf = F.coalesce(F.col("is_leaf"), F.lit(True))
    head = F.concat_ws(" ", F.format_string("[%d]", "rank"), F.when(leaf, F.lit("leaf")).otherwise(F.lit("summary-node")),
                       _labelled("depth=", F.col("depth")), time_span(F.col("start"), F.col("end")))
    summary = clean_text(F.coalesce(F.when(F.col("summary_text") != "", F.col("summary_text")), F.col("text"), F.lit(BLANK)))

    def support(x: Column, i: Column) -> Column:
        line = F.concat_ws(" ", F.concat(F.lit("Support "), (i + 1).cast("string")), _labelled("seg=", x["segment_id"]),
                           time_span(x["start"], x["end"]))
        return F.concat(line, F.lit("\n"), or_blank(clean_text(x["text"])))

    evidence = F.when(F.size("supporting_leaves") > 0, F.array_join(F.transform("supporting_leaves", support), "\n\n"))
    return F.when(leaf, F.concat(head, F.lit("\nTranscript:\n"), or_blank(clean_text("text")))).otherwise(
        F.concat(head, F.lit("\nSummary:\n"), summary, F.lit("\nSupporting transcript evidence:\n"),
                 F.coalesce(evidence, F.lit(BLANK))))


def build_context(hits: DataFrame, block: Column, *, max_chars: int | None = MAX_CHARS) -> DataFrame:
    """Join the leading blocks of each query while they fit the budget.

    Empty blocks are passed over. A block counts its length and, after the first, two
    characters of separator; the sum only grows, so the first block that does not fit ends
    the context. A query has no more blocks than the hits kept for it.
    """
    # Exploding a one-element array keeps a block from being made once per use.
    rows = hits.withColumn("_b", F.explode(F.array(block))).where(F.col("_b") != "")
    so_far = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_used", F.sum(F.length("_b") + 2).over(so_far) - 2)
    if max_chars is not None:
        rows = rows.where(F.col("_used") <= max_chars)
    packed = rows.groupBy("query_id").agg(
        strip(F.expr("listagg(`_b`, '\\n\\n') within group (order by rank)")).alias("context"),
        F.count(F.lit(1)).alias("n_blocks"))
    every = hits.select("query_id").distinct()
    return every.join(packed, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def separate_context(asr: DataFrame, ocr: DataFrame) -> DataFrame:
    """Speech and slide contexts of each query under their titles."""
    both = asr.select("query_id", F.col("context").alias("a")).join(
        ocr.select("query_id", F.col("context").alias("o")), "query_id", "full_outer")
    part = lambda title, c: F.when(F.col(c) != "", F.concat(F.lit(title), F.col(c)))
    return both.select("query_id", F.concat_ws("\n\n", part("ASR Context:\n", "a"), part("OCR Context:\n", "o")).alias("context"))


def context_texts(hits: DataFrame) -> DataFrame:
    """Flat list of evidence texts per query: a summary and then its leaves, else the speech."""
    summary = clean_text(F.coalesce(F.when(F.col("summary_text") != "", F.col("summary_text")), F.col("text"), F.lit("")))
    from_node = F.concat(F.array(summary), F.transform("supporting_leaves", lambda x: clean_text(x["text"])))
    inner = (F.col("index_kind") == "summary_tree") & ~F.coalesce(F.col("is_leaf"), F.lit(True))
    texts = F.filter(F.when(inner, from_node).otherwise(F.array(plain_speech(F.coalesce("text", F.lit(""))))), lambda t: t != "")
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", texts.alias("t")))).alias("l"))
    flat = F.flatten(F.transform("l", lambda s: s["t"]))
    return listed.select("query_id", F.when(F.size(flat) > 0, flat).otherwise(F.array(F.lit(NO_CONTEXT))).alias("texts"))
