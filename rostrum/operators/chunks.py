"""Token-bounded chunks: sliding token windows, packed units, the configuration grid."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import BLANK, clean_text, compose_chunk_text, or_blank, ordered_text, text_tokens
from rostrum.functions.vectors import let
from rostrum.operators.slides import overlapping_slides
from rostrum.plans.ordered import Rows, has_long_key, ordered_fold, ordered_scan
from rostrum.session import materialize

# The default grid of chunk configurations.
STRATEGIES = ("utterance_packed", "raw_token_window")
SIZES = (128, 256, 512)
OVERLAP_PERCENTS = (0, 10)
OCR_MODES = ("transcript_only", "combined_ocr")

# Places of texts that are sent to them: at most so many rows (some 10 MB).
SENT_ROWS = 1 << 17

KEY = ["lecture_key"]


def overlap_tokens(size: Column, percent: Column) -> Column:
    """Overlap in tokens, rounded half to even."""
    return F.bround(size * (percent / F.lit(100.0))).cast("long")


def config_grid(
    spark: SparkSession, strategies=STRATEGIES, sizes=SIZES, overlaps=OVERLAP_PERCENTS, modes=OCR_MODES
) -> DataFrame:
    """All combinations of the chunk settings with their derived overlap and system name."""
    lists = {"chunk_strategy": strategies, "chunk_size_tokens": sizes, "overlap_percent": overlaps, "ocr_mode": modes}
    grid = spark.range(1)
    for name, values in lists.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id").withColumns({
        "chunk_size_tokens": F.col("chunk_size_tokens").cast("long"),
        "overlap_percent": F.col("overlap_percent").cast("long"),
        "overlap_tokens": overlap_tokens(F.col("chunk_size_tokens"), F.col("overlap_percent")),
        "attach_ocr": F.col("ocr_mode") == "combined_ocr",
        "system": F.concat(
            F.lit("baseline__"), F.col("chunk_strategy"), F.lit("__"), F.col("chunk_size_tokens").cast("string"),
            F.lit("tok__ov"), F.col("overlap_percent").cast("string"), F.lit("__"), F.col("ocr_mode")),
    })


def token_windows(
    words: DataFrame, *, size: int, overlap: int = 0, lowercase: bool = True,
    slides: DataFrame | None = None, bucket_seconds: float = 3600.0,
) -> DataFrame:
    """Windows of ``size`` tokens every ``size - overlap`` tokens over a lecture's words.

    The last window is the first to reach the end. Each word computes the windows it
    falls into, so windows are plain groups and no range join is needed. With ``slides``
    the text of all slides a window's time span touches is added. ``text_windows`` takes whole texts.
    """
    step = max(1, size - overlap)
    plain = F.col("word").rlike("^[A-Za-z0-9_]+\\z")
    text = F.when(plain, F.col("word")).otherwise(clean_text("word"))
    text = F.lower(text) if lowercase else text
    n = F.size("_tok").cast("long")
    placed = ordered_scan(
        _with_tokens(words, text, plain).select(*KEY, "ord", "start", "end", "_tok"), KEY, "ord", number="_word",
        running={"_upto": ("sum", n)}, totals={"_total": ("sum", n)}, long=has_long_key(words, KEY),
    )
    chunks = _windows(placed.select(*KEY, "_word", "start", "end", "_tok", "_total", (F.col("_upto") - n).alias("_from")), size, step)
    if slides is None:
        chunks = chunks.withColumns({"ocr_text": F.lit(""), "ocr_slide_indices": F.array().cast("array<long>")})
    else:
        chunks = overlapping_slides(chunks, slides, bucket_seconds=bucket_seconds)
    return chunks.select(
        *KEY, "chunk_id", compose_chunk_text("_spoken", "ocr_text").alias("text"),
        F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "token_count",
        "source_item_start", "source_item_end", "ocr_slide_indices",
    )


def text_windows(texts: DataFrame, *, size: int, overlap: int = 0, lowercase: bool = True) -> DataFrame:
    """``token_windows`` over rows that hold whole texts: ``lecture_key, idx, start, end, text``.

    No row per word is made: a text gives each window that it touches its part as one row. Tokens are found once
    and stored; places come from the counts of the texts, so no text goes through the ordered pass.
    """
    text = clean_text("text")
    rows = texts.select(*KEY, "idx", "start", "end", (F.lower(text) if lowercase else text).alias("text"))
    # No token holds a blank.
    stored = materialize(_with_tokens(rows, F.col("text")).select(
        *KEY, "idx", "start", "end", F.size("_tok").cast("long").alias("_n"), F.array_join("_tok", " ").alias("_text")))
    n = F.col("_n")
    counts = stored.select(*KEY, "idx", "_n")
    placed = materialize(ordered_scan(counts, KEY, "idx", number="_word", running={"_upto": ("sum", n)}, totals={"_total": ("sum", n)}))
    placed = placed.select(*KEY, "idx", "_word", "_total", (F.col("_upto") - n).alias("_from"))
    if placed.count() <= SENT_ROWS:
        placed = F.broadcast(placed)
    parts = stored.join(placed, [*KEY, "idx"]).withColumn("_tok", F.split("_text", " "))
    chunks = _windows(parts, size, max(1, size - overlap))
    return chunks.select(*KEY, "chunk_id", or_blank(F.col("_spoken")).alias("text"), F.round("start", 3).alias("start"),
                         F.round("end", 3).alias("end"), "token_count", "source_item_start", "source_item_end")


def _windows(placed: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of rows with ``_tok``, some tokens that follow ``_from`` others of ``_total`` in the lecture.

    A row gives one part to every window that it touches. ``_word`` is its number.
    """
    frm, n = F.col("_from"), F.size("_tok").cast("long")
    last = F.greatest(F.ceil((F.col("_total") - size) / step), F.lit(0))
    lo = F.greatest(F.ceil((frm - size + 1) / step), F.lit(0))
    hi = F.least(F.floor((frm + n - 1) / step), last)

    def part(tok: Column, win: Column) -> Column:
        at = F.greatest(win * step, frm)
        end = F.least(win * step + size, frm + n)
        return F.struct((win + 1).alias("chunk_id"), at.alias("at"), (end - at).alias("n"),
                        F.array_join(F.slice(tok, (at - frm + 1).cast("int"), (end - at).cast("int")), " ").alias("t"))

    # With step > size a row can lie between two windows.
    parts = placed.where(lo <= hi).select(
        *KEY, "_word", "start", "end", F.explode(let(F.col("_tok"), lambda tok: F.transform(F.sequence(lo, hi), lambda w: part(tok, w)))).alias("_p"))
    flat = parts.select(*KEY, "_p.chunk_id", "_word", "start", "end", F.col("_p.at").alias("_pos"), F.col("_p.n").alias("_n"), F.col("_p.t").alias("_t"))
    return flat.groupBy(*KEY, "chunk_id").agg(
        F.sum("_n").alias("token_count"),
        F.min("_word").alias("source_item_start"), F.max("_word").alias("source_item_end"),
        F.min_by("start", "_pos").alias("start"), F.max_by("end", "_pos").alias("end"),
        ordered_text("_t", " ", "_pos").alias("_spoken"),
    )


def _with_tokens(rows: DataFrame, text: Column, plain: Column | None = None) -> DataFrame:
    """Rows with ``_tok``, the tokens of a text; rows without any go.

    Where ``plain``, a cheap test, says that the text is a word as it is, no token is searched for.
    Exploding a one-element array keeps the tokens from being found once per use.
    """
    tokens = text_tokens(text)
    if plain is not None:
        tokens = F.when(plain, F.array(text)).otherwise(tokens)
    return rows.select("*", F.explode(F.array(tokens)).alias("_tok")).where(F.size("_tok") > 0)


def utterance_units(utts: DataFrame, *, attach_ocr: bool = False) -> DataFrame:
    """Utterances as packable units: composed text, slide indices, source position."""
    has_ocr = F.lit(attach_ocr) & (F.coalesce("ocr_text", F.lit("")) != "") if attach_ocr else F.lit(False)
    ocr = F.coalesce("ocr_text", F.lit("")) if attach_ocr else F.lit("")
    slide = F.when(has_ocr & F.col("slide_index").isNotNull(), F.col("slide_index").cast("long")) if attach_ocr \
        else F.lit(None).cast("long")
    return utts.select(*KEY, "idx", "start", "end", compose_chunk_text("text", ocr).alias("text"),
                       slide.alias("slide_index"))


def split_units(units: DataFrame, *, size: int) -> DataFrame:
    """Number the units' pieces: a unit longer than ``size`` tokens is cut every ``size``.

    Input rows carry ``idx``, unique within the lecture and in order; output rows ``t``,
    the dense piece position, and ``n_tokens``.
    """
    # Only the count travels; the tokens of the few oversized units are cut out again.
    toks = _with_tokens(units, F.col("text")).withColumn("_n", F.size("_tok").cast("long")).drop("_tok")
    pieces = F.ceil(F.col("_n") / size).cast("long")
    placed = ordered_scan(toks, KEY, "idx", running={"_upto": ("sum", pieces)},
                          totals={"n_units": ("sum", pieces)}, long=has_long_key(units, KEY))
    cut = placed.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    part = F.slice(text_tokens("text"), (F.col("_k") * size + 1).cast("int"), F.lit(size))
    return cut.select(
        *KEY, (F.col("_upto") - pieces + F.col("_k")).alias("t"), "n_units", "idx", "start", "end", "slide_index",
        F.when(pieces > 1, F.array_join(part, " ")).otherwise(F.col("text")).alias("text"),
        F.least(F.lit(size).cast("long"), F.col("_n") - F.col("_k") * size).alias("n_tokens"),
    )


def _packer(size: int, overlap: int):
    """Fold step: the state is the run of units of the chunk still open."""

    def fold(rows: Rows, state: str | None):
        held = [] if state is None else [tuple(p) for p in json.loads(state)]
        total = sum(c for _, c in held)
        out = []

        def close():
            nonlocal held, total
            out.append((held[0][0], held[-1][0]))
            back, cut = 0, len(held)
            while overlap > 0 and cut > 0 and back < overlap:
                cut -= 1
                back += held[cut][1]
            held = held[max(cut, 1):]
            total = sum(c for _, c in held)

        for t, c in zip(rows["t"].tolist(), rows["n_tokens"].tolist()):
            while held and total + c > size:
                close()
            held.append((t, c))
            total += c
        if rows["t"][-1] == rows["n_units"][-1] - 1:
            out.append((held[0][0], held[-1][0]))
        spans = np.array(out, dtype=np.int64).reshape(-1, 2)
        return {"lecture_key": [rows["lecture_key"][0]] * len(out), "lo": spans[:, 0], "hi": spans[:, 1]}, json.dumps(held)

    return fold


def pack_units(units: DataFrame, *, size: int, overlap: int = 0, block_rows: int | None = None) -> DataFrame:
    """Greedy packing of units into chunks of at most ``size`` tokens.

    Consecutive chunks share whole trailing units until these hold ``overlap`` tokens, but
    each chunk starts after the one before. Which units open a chunk is a sequential
    question and is answered by a block-wise fold over counts only; the chunk rows are
    then joined to the unit texts by position.
    """
    # Stored, so that the tokens are found once: spans are made from the counts, and then looked up among the texts.
    long = None if block_rows else has_long_key(units, KEY)
    pieces = materialize(split_units(units, size=size))
    spans = ordered_fold(pieces.select(*KEY, "t", "n_tokens", "n_units"), KEY, "t", _packer(size, overlap),
                         "lecture_key string, lo long, hi long", block_rows=block_rows,
                         long=long)
    spans = ordered_scan(materialize(spans), KEY, "lo", number="_n").withColumn("chunk_id", F.col("_n") + 1)
    at = spans.select(*KEY, "chunk_id", F.explode(F.sequence("lo", "hi")).alias("t"))
    rows = at.join(pieces, [*KEY, "t"])
    # At most ``size`` units fall into a chunk, because every unit has a token.
    slides = F.array_sort(F.collect_list(F.when(F.col("slide_index").isNotNull(), F.struct("t", "slide_index"))))
    return rows.groupBy(*KEY, "chunk_id").agg(
        ordered_text("text", "\n", "t").alias("text"),
        F.min_by("start", "t").alias("start"), F.max_by("end", "t").alias("end"),
        F.sum("n_tokens").alias("token_count"),
        F.min_by("idx", "t").alias("source_item_start"), F.max_by("idx", "t").alias("source_item_end"),
        F.array_distinct(F.transform(slides, lambda s: s["slide_index"])).alias("ocr_slide_indices"),
    ).withColumn("text", F.when(F.trim("text") == "", F.lit(BLANK)).otherwise(F.col("text")))


def grid_chunks(
    words: DataFrame, utts: DataFrame, slides: DataFrame, *, strategies=STRATEGIES, sizes=SIZES, overlaps=OVERLAP_PERCENTS,
    modes=OCR_MODES, bucket_seconds: float = 3600.0,
) -> DataFrame:
    """The chunks of every configuration of the grid, with its settings and system name.

    ``words`` for the token windows; ``utts`` with ``slide_index`` and ``ocr_text`` for the packed units; ``slides``
    (``slide_index, start, end, text``) for the windows that carry slide text.
    """
    words, utts, slides = (materialize(df) for df in (words, utts, slides))  # every configuration reads them
    out = None
    for config in config_grid(words.sparkSession, strategies, sizes, overlaps, modes).collect():  # as many rows as settings asked for
        size, overlap, ocr = config.chunk_size_tokens, config.overlap_tokens, config.attach_ocr
        if config.chunk_strategy == "raw_token_window":
            made = token_windows(words, size=size, overlap=overlap, slides=slides if ocr else None, bucket_seconds=bucket_seconds)
        else:
            made = pack_units(utterance_units(utts, attach_ocr=ocr), size=size, overlap=overlap)
        made = made.select(
            F.lit(config.system).alias("system"), F.lit(config.chunk_strategy).alias("chunk_strategy"), F.lit(config.ocr_mode).alias("ocr_mode"),
            *KEY, "chunk_id", "text", "start", "end", "token_count", "source_item_start", "source_item_end", "ocr_slide_indices")
        out = made if out is None else out.unionByName(made)
    return out
