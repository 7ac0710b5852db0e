"""Timed words to utterances: cleaning, pause estimation, gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import ordered_text, strip
from rostrum.plans.ordered import exact_percentile, has_long_key, ordered_scan
from rostrum.session import materialize

# Pause used when a recording has no gap, and the percentile of its gaps.
DEFAULT_MAX_GAP_S = 0.8
AUTO_MAX_GAP_PERCENTILE = 0.975
GAP_REPORT_SECONDS = (0.5, 0.8, 1.0, 1.5, 2.0)


def clean_timed_words(raw: DataFrame, *, clamp_end: bool = True) -> DataFrame:
    """``Word, Start, End`` cells to ``word, start, end``.

    Blank words go; an unreadable start becomes 0, an unreadable end the start; with
    ``clamp_end`` an end before its start becomes the start.
    """
    start = F.coalesce(F.expr("try_cast(trim(cast(Start as string)) as double)"), F.lit(0.0))
    end = F.coalesce(F.expr("try_cast(trim(cast(End as string)) as double)"), F.col("start"))
    words = raw.withColumn("word", strip("Word")).where(F.col("word") != "")
    words = words.withColumn("_s", start).drop("Start").withColumnRenamed("_s", "start")
    words = words.withColumn("_e", end).drop("End").withColumnRenamed("_e", "end")
    if clamp_end:
        words = words.withColumn("end", F.greatest("end", "start"))
    return words.select("lecture_key", "ord", "word", "start", "end")


def word_gaps(words: DataFrame, *, per_key: DataFrame | None = None, long: bool | None = None) -> DataFrame:
    """Words with ``gap``: seconds since the previous word's end, null on the first word."""
    scan = ordered_scan(
        words, ["lecture_key"], "ord", lags={"prev_end": (F.col("end"), None)}, per_key=per_key, long=long
    )
    return scan.withColumn("gap", F.col("start") - F.col("prev_end"))


def estimate_max_gap(
    words: DataFrame, *, default: float = DEFAULT_MAX_GAP_S, pct: float = AUTO_MAX_GAP_PERCENTILE
) -> DataFrame:
    """Per lecture, the percentile of its non-negative gaps; the default without gaps."""
    long = has_long_key(words, ["lecture_key"])
    gaps = word_gaps(words, long=long).select(
        "lecture_key", "prev_end", F.when(F.col("gap").isNotNull(), F.greatest("gap", F.lit(0.0))).alias("gap"))
    if not long:
        # The first word has no gap; percentile skips nulls, so its lecture still gets a row.
        auto = exact_percentile(gaps, ["lecture_key"], "gap", pct, "max_gap_s", long=False)
        return auto.withColumn("max_gap_s", F.coalesce("max_gap_s", F.lit(float(default))))
    gaps = gaps.where(F.col("gap").isNotNull())
    auto = exact_percentile(gaps, ["lecture_key"], "gap", pct, "max_gap_s", long=True)
    lectures = words.select("lecture_key").distinct()
    return lectures.join(auto, "lecture_key", "left").select(
        "lecture_key", F.coalesce("max_gap_s", F.lit(float(default))).alias("max_gap_s")
    )


def resolve_max_gap(words: DataFrame, mode: str | float | None = "auto") -> DataFrame:
    """Pause per lecture: estimated for ``None``/``"auto"``, else the given positive number."""
    if mode is None or (isinstance(mode, str) and mode.strip().lower() == "auto"):
        return estimate_max_gap(words)
    value = float(mode)
    if value <= 0:
        raise ValueError(f"max_gap_s must be > 0; got {value}")
    return words.select("lecture_key").distinct().withColumn("max_gap_s", F.lit(value))


def gap_sessions(words: DataFrame, max_gap: DataFrame) -> DataFrame:
    """Number the sessions of each lecture; a pause of at least ``max_gap_s`` opens one."""
    long = has_long_key(words, ["lecture_key"])
    gaps = word_gaps(words, per_key=max_gap, long=long)
    breaks = gaps.withColumn("is_break", F.coalesce((F.col("gap") >= F.col("max_gap_s")).cast("int"), F.lit(0)))
    return ordered_scan(breaks, ["lecture_key"], "ord", running={"idx": ("sum", F.col("is_break"))},
                        long=long)


def group_utterances(
    words: DataFrame, max_gap: DataFrame | None = None, *, lowercase: bool = True
) -> DataFrame:
    """Utterances: the words of one gap session joined, with times rounded to 3 places."""
    max_gap = resolve_max_gap(words) if max_gap is None else max_gap
    sessions = gap_sessions(words, max_gap)
    if lowercase:
        sessions = sessions.withColumn("word", F.lower("word"))
    utts = sessions.groupBy("lecture_key", "idx").agg(
        F.min_by("start", "ord").alias("_s"),
        F.max_by("end", "ord").alias("_e"),
        F.count(F.lit(1)).alias("n_words"),
        ordered_text("word", " ", "ord").alias("text"),
        F.max("max_gap_s").alias("_g"),
    )
    return utts.select(
        "lecture_key", "idx", F.round("_s", 3).alias("start"), F.round("_e", 3).alias("end"),
        F.round(F.col("_e") - F.col("_s"), 3).alias("duration"), "n_words", "text",
        F.round("_g", 3).alias("max_gap_s"),
    )


def gap_distribution(words: DataFrame) -> DataFrame:
    """Freedman-Diaconis histogram of all positive gaps plus the share at or under fixed pauses."""
    gaps = word_gaps(words).where(F.col("gap") > 0).select("gap")
    long = has_long_key(words, [])
    if long:
        # Four passes follow; one table of doubles is cheaper than four scans of the words.
        gaps = materialize(gaps)
    q1 = exact_percentile(gaps, [], "gap", 0.25, "q1", long=long)
    q3 = exact_percentile(gaps, [], "gap", 0.75, "q3", long=long)
    shares = [
        (F.avg((F.col("gap") <= t).cast("double")) * 100).alias(f"pct_le_{t}".replace(".", "_"))
        for t in GAP_REPORT_SECONDS
    ]
    stats = gaps.agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), *shares)
    one = lambda d: d.withColumn("_one", F.lit(1))
    facts = one(stats).join(one(q1), "_one").join(one(q3), "_one")
    # The facts are one row, so joining them to every gap is bounded.
    width = 2 * (F.col("q3") - F.col("q1")) / F.cbrt(F.col("n").cast("double"))
    facts = facts.withColumn("bins", F.greatest(F.ceil(F.try_divide(F.col("hi") - F.col("lo"), width)), F.lit(1)))
    binned = one(gaps).join(F.broadcast(facts), "_one").withColumn(
        "bin",
        F.least(
            F.floor(F.try_divide(F.col("gap") - F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins"))),
            F.col("bins") - 1,
        ),
    )
    names = [f"pct_le_{t}".replace(".", "_") for t in GAP_REPORT_SECONDS]
    return binned.groupBy("bin", "bins", "n", *names).agg(F.count(F.lit(1)).alias("bin_count"))

