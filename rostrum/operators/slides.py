"""Slides: spans, as-of and interval joins to speech, slide text, clean-up of boundaries."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import clean_text, ordered_text, strip
from rostrum.plans.ordered import (
    Rows, Step, attach_per_key, interval_pairs, ordered_fold, ordered_scan, pick, row_block, value_block,
)

# Fixed values of the boundary clean-up.
MIN_STEP_S = 1e-6
DEDUPE_HAMMING = 6
TEXT_SIMILARITY = 0.85
MIN_TERMS = 6
MAX_SAME_TEXT_SPAN_S = 900.0

KEY = ["lecture_key"]


def slide_spans(ends: DataFrame) -> DataFrame:
    """End times to spans: a slide starts where the previous one ended, the first at 0."""
    return ordered_scan(ends, KEY, "slide_index", lags={"start": (F.col("end"), 0.0)})


def slide_midpoints(ends: DataFrame) -> DataFrame:
    return slide_spans(ends).withColumn("midpoint", (F.col("start") + F.col("end")) / 2)


def _pivot(mode: str) -> Column:
    if mode == "start":
        return F.col("start")
    if mode == "end":
        return F.col("end")
    return (F.col("start") + F.col("end")) / 2


def attach_slides(
    utts: DataFrame, ends: DataFrame, *, mode: str = "midpoint", clamp: bool = False,
    block_seconds: float = 3600.0,
) -> DataFrame:
    """As-of join: the first slide that ends at or after the utterance's pivot time.

    Both sides are laid on one time line and walked backwards, carrying the nearest slide
    seen so far; this stays linear however long a lecture is. Later utterances stay
    unmatched, or take the last slide with ``clamp``.
    """
    spans = slide_spans(ends).select(
        *KEY, F.col("end").alias("_t"), F.lit(1).alias("_kind"),
        F.col("slide_index").cast("long").alias("_id"),
        F.struct(F.col("end").alias("e"), F.col("slide_index").alias("i"), F.col("start").alias("s")).alias("_slide"),
    )
    talk = utts.withColumns({"_t": _pivot(mode), "_kind": F.lit(0), "_id": F.col("idx").cast("long")})
    line = talk.unionByName(spans, allowMissingColumns=True)
    totals = {"_last": ("max", F.col("_slide"))} if clamp else {}
    seen = ordered_scan(
        line, KEY, ["_t", "_kind", "_id"], block=value_block("_t", block_seconds),
        running={"_next": ("min", F.col("_slide"))}, totals=totals, descending=True,
    ).where(F.col("_kind") == 0)
    slide = F.coalesce("_next", "_last") if clamp else F.col("_next")
    return seen.select(
        *utts.columns, slide["i"].alias("slide_index"),
        F.round(slide["s"], 3).alias("slide_start"), F.round(slide["e"], 3).alias("slide_end"),
    )


def attach_slide_text(utts: DataFrame, texts: DataFrame, *, per_slide: int | None = 1) -> DataFrame:
    """Give slide text to the first ``per_slide`` utterances of each slide (``None``: to all)."""
    texts = texts.select(*KEY, "slide_index", "ocr_text")
    if per_slide is None:
        return attach_per_key(utts, texts, [*KEY, "slide_index"], row_block("idx"))
    if per_slide <= 0:
        return utts.withColumn("ocr_text", F.lit(None).cast("string"))
    # The rank limit is applied before the shuffle too, so a crowded slide stays small.
    rank = F.row_number().over(Window.partitionBy(*KEY, "slide_index").orderBy("idx"))
    lead = utts.where(F.col("slide_index").isNotNull()).select(*KEY, "slide_index", "idx")
    lead = lead.withColumn("_r", rank).where(F.col("_r") <= per_slide)
    given = lead.join(texts, [*KEY, "slide_index"]).select(*KEY, "idx", "ocr_text")
    return utts.join(given, [*KEY, "idx"], "left")


def ocr_slide_texts(tokens: DataFrame, *, min_conf: float = 0.0, line_sep: str = "\n") -> DataFrame:
    """Recognised tokens to one text per slide: words joined within lines, lines in page order.

    Tokens below ``min_conf`` go; a token without a confidence stays.
    """
    kept = filter_ocr_tokens(tokens, min_conf=min_conf)
    kept = kept.withColumn("_w", clean_text("text"))
    place = ["block_num", "par_num", "line_num"]
    lines = kept.groupBy(*KEY, "slide_index", *place).agg(ordered_text("_w", " ", "word_num", "_w").alias("_line"))
    texts = lines.groupBy(*KEY, "slide_index").agg(strip(ordered_text("_line", line_sep, *place)).alias("ocr_text"))
    return texts.where(F.col("ocr_text") != "")


def filter_ocr_tokens(tokens: DataFrame, *, min_conf: float = 0.0) -> DataFrame:
    return tokens.where(
        (strip(F.coalesce("text", F.lit(""))) != "") & (F.col("conf").isNull() | (F.col("conf") >= min_conf))
    )


def slide_entries(ends: DataFrame, texts: DataFrame) -> DataFrame:
    """Slides that have text, with their span; ``segment_id`` counts slides from 1."""
    spans = slide_spans(ends).join(texts, [*KEY, "slide_index"])
    return spans.select(
        *KEY, (F.col("slide_index") + 1).alias("segment_id"), "slide_index",
        F.round("start", 3).alias("start"), F.round("end", 3).alias("end"),
        F.col("ocr_text").alias("text"), F.lit("ocr").alias("modality"),
    )


def overlapping_slides(
    chunks: DataFrame, slides: DataFrame, *, bucket_seconds: float = 3600.0
) -> DataFrame:
    """Every chunk with the slides its closed time span touches, in slide order."""
    right = slides.select(*KEY, "slide_index", F.col("start").alias("_ss"), F.col("end").alias("_se"),
                          F.col("text").alias("_st"))
    left = chunks.select(*KEY, "chunk_id", "start", "end")
    pairs = interval_pairs(left, right, KEY, width=bucket_seconds,
                           left_span=("start", "end"), right_span=("_ss", "_se"))
    per_chunk = pairs.groupBy(*KEY, "chunk_id").agg(
        F.array_sort(F.collect_list("slide_index")).alias("ocr_slide_indices"),
        ordered_text("_st", "\n", "slide_index").alias("ocr_text"),
    )
    joined = chunks.join(per_chunk, [*KEY, "chunk_id"], "left")
    empty = F.array().cast("array<long>")
    return joined.withColumns({
        "ocr_slide_indices": F.coalesce(F.col("ocr_slide_indices").cast("array<long>"), empty),
        "ocr_text": F.coalesce("ocr_text", F.lit("")),
    })


def reference_boundaries(
    utts: DataFrame, ends: DataFrame, *, block_seconds: float = 3600.0
) -> DataFrame:
    """Flag the last utterance before each slide change, by start time; never the final one."""
    placed = attach_slides(utts, ends, mode="start", clamp=True, block_seconds=block_seconds)
    after = ordered_scan(placed, KEY, "idx", leads={"_next": (F.col("slide_index"), None)})
    changed = F.coalesce((F.col("_next") != F.col("slide_index")).cast("int"), F.lit(0))
    return after.withColumn("flag", changed).drop("_next")


def normalize_ends(ends: DataFrame, *, eps: float = MIN_STEP_S) -> DataFrame:
    """Drop end times that are not positive or not past the last kept one; renumber."""

    def fold(rows: Rows, state: str | None):
        last = -1.0 if state is None else float(state)
        keep = []
        for value in rows["end"]:
            ok = value > 0 and value > last + eps
            keep.append(ok)
            last = value if ok else last
        return pick(rows, ["lecture_key", "pos", "end"], keep), repr(float(last))

    def make(rows: Rows) -> str:
        """Which end is kept last, by the range that the last one before falls into: ``[bound, end]`` by rising bound."""
        highest: list[float] = []  # only an end past all before it in the block can be the first one kept
        for value in rows["end"]:
            if value > 0 and (not highest or value > highest[-1]):
                highest.append(float(value))
        final = list(highest)
        for j in range(len(highest) - 1, -1, -1):
            k = bisect.bisect_right(highest, highest[j] + eps)
            final[j] = final[k] if k < len(highest) else highest[j]
        return json.dumps([[v, e] for v, e, later in zip(highest, final, [*final[1:], None]) if e != later])

    def apply(step: str, state: str | None) -> str:
        last = -1.0 if state is None else float(state)
        return repr(next((end for bound, end in json.loads(step) if bound > last + eps), last))

    numbered = ordered_scan(ends.select(*KEY, "slide_index", "end"), KEY, "slide_index", number="pos")
    kept = ordered_fold(numbered.select(*KEY, "pos", "end"), KEY, "pos", fold,
                        "lecture_key string, pos long, end double", step=Step(make, apply))
    return ordered_scan(kept, KEY, "pos", number="slide_index").select(*KEY, "slide_index", "end")


def dedupe_slides(slides: DataFrame, *, max_distance: int = DEDUPE_HAMMING) -> DataFrame:
    """Merge a slide into the last kept one when their 64-bit picture hashes nearly agree.

    Input ``slide_index, end, hash``; the kept slide's end is extended to the last merged.
    """

    def fold(rows: Rows, state: str | None):
        last = None if state is None else int(state)
        flags = []
        for value in rows["hash"]:
            # Two's complement keeps the differing bits of negative longs countable.
            new = last is None or ((int(value) ^ last) & 0xFFFFFFFFFFFFFFFF).bit_count() > max_distance
            flags.append(int(new))
            last = int(value) if new else last
        return {**pick(rows, ["lecture_key", "slide_index", "end"]), "is_new": flags}, str(last)

    marked = ordered_fold(slides.select(*KEY, "slide_index", "end", "hash"), KEY, "slide_index", fold,
                          "lecture_key string, slide_index long, end double, is_new int")
    groups = ordered_scan(marked, KEY, "slide_index", running={"_g": ("sum", F.col("is_new"))})
    return groups.groupBy(*KEY, (F.col("_g") - 1).alias("slide_index")).agg(
        F.max_by("end", F.struct(groups["slide_index"])).alias("end"),
        F.min(groups["slide_index"]).alias("first_source"), F.count(F.lit(1)).alias("n_merged"),
    )


def filter_by_text_change(
    slides: DataFrame, *, similarity: float = TEXT_SIMILARITY, min_terms: int = MIN_TERMS,
    max_span: float = MAX_SAME_TEXT_SPAN_S,
) -> DataFrame:
    """Drop boundaries after which the slide text hardly changed.

    A boundary goes when both its term set and the last kept one have ``min_terms`` terms
    and are ``similarity`` alike, unless ``max_span`` seconds passed since the last kept
    boundary. The first and last boundary of a lecture always stay.
    """

    def fold(rows: Rows, state: str | None):
        terms, last = (None, 0.0) if state is None else json.loads(state)
        prev = None if terms is None else set(terms)
        keep = []
        for pos, n, end, words in zip(rows["slide_index"], rows["_n"], rows["end"], rows["terms"]):
            now = set(words)
            alike = False
            if prev is not None and len(prev) >= min_terms and len(now) >= min_terms:
                alike = len(prev & now) / len(prev | now) >= similarity
            ok = pos in (0, n - 1) or not alike or end - last >= max_span
            keep.append(ok)
            if ok:
                prev, last = now, float(end)
        return (pick(rows, ["lecture_key", "slide_index", "end"], keep),
                json.dumps([None if prev is None else sorted(prev), last]))

    counted = ordered_scan(slides.select(*KEY, "slide_index", "end", "terms"), KEY, "slide_index",
                           totals={"_n": ("sum", F.lit(1))})
    return ordered_fold(counted, KEY, "slide_index", fold, "lecture_key string, slide_index long, end double")
