"""Summaries: means, deltas, counts, bands, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.plans.ordered import exact_percentile, has_long_key
from rostrum.session import materialize

# Names and percentages of systems published elsewhere.
PUBLISHED = {
    "Video LlaVA 7B (paper)": (12.47, 21.84, 17.55),
    "mPLUG Owl 3 8B (paper)": (18.17, 31.79, 19.64),
    "Qwen VL 7B (paper)": (18.36, 33.00, 19.22),
    "Llava 13B (paper)": (17.16, 20.03, 31.41),
    "GPT4o (paper)": (15.03, 32.87, 22.46),
    "Gemini 1.5 (paper)": (13.98, 30.76, 21.25),
}


def finite_mean(x: str | Column) -> Column:
    """Mean of the finite values; NaN if there is none."""
    c = F.col(x) if isinstance(x, str) else x
    usable = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.coalesce(F.avg(F.when(usable, c)), F.lit(float("nan")))


def mean_or_zero(x: str) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def metric_columns(df: DataFrame, prefixes=("recall@", "mean_temporal_distance@", "max_iou@", "ndcg@")) -> list[str]:
    """Metric columns by name prefix, in prefix order."""
    return [c for p in prefixes for c in df.columns if c.startswith(p)]


def system_means(rows: DataFrame, metrics: list[str], *, skip_nan: bool = True) -> DataFrame:
    mean = finite_mean if skip_nan else mean_or_zero
    return rows.groupBy("system").agg(F.count(F.lit(1)).alias("question_count"), *[mean(F.col(f"`{m}`") if skip_nan else m).alias(m) for m in metrics])


def metric_deltas(means: DataFrame, metrics: list[str], base: str) -> DataFrame:
    """Each other system's metric minus the base system's."""
    long = means.unpivot(["system"], [f"`{m}`" for m in metrics], "metric", "value")
    ref = long.where(F.col("system") == base).select("metric", F.col("value").alias("base_value"))
    return long.where(F.col("system") != base).join(ref, "metric").select(
        "system", F.lit(base).alias("base"), "metric", (F.col("value") - F.col("base_value")).alias("delta"))


def leaderboard(means: DataFrame, metric: str, *, ascending: bool = False) -> DataFrame:
    """Systems sorted by a metric; NaN first when descending, last when ascending.

    One row per system, so one task ranks them.
    """
    order = F.col(f"`{metric}`").asc() if ascending else F.col(f"`{metric}`").desc()
    return means.withColumn("place", F.row_number().over(Window.orderBy(order, "system")))


def best_system(scores: DataFrame, metric: str, group: list[str]) -> DataFrame:
    """The system with the lowest metric per group."""
    return scores.groupBy(*group).agg(F.min_by("system", F.struct(metric, "system")).alias("system"), F.min(metric).alias(metric))


def count_comparison(rows: DataFrame) -> DataFrame:
    """Segments against slides per lecture: difference and ratio, or the ``reason`` to skip a lecture that lacks one."""
    diff = F.col("n_segments") - F.col("n_slides")
    reason = (F.when(F.col("max_gap_s").isNull(), "no_words").when(F.col("n_slides").isNull(), "no_slides")
              .when(F.col("n_segments").isNull(), "no_segments"))
    ratio = F.coalesce(F.try_divide(F.col("n_segments"), F.col("n_slides")), F.lit(float("nan")))
    return rows.withColumns({"reason": reason, "diff": diff, "abs_diff": F.abs(diff), "ratio": F.when(reason.isNull(), ratio)})


def count_summary(rows: DataFrame) -> DataFrame:
    """Mean and median of each count, and the share of lectures per ratio band, over those with no ``reason`` to skip."""
    names = ["n_slides", "n_segments", "diff", "abs_diff", "ratio", "max_gap_s"]
    used = F.col("reason").isNull()
    rows = rows.select("reason", *[F.when(used, F.col(c)).alias(c) for c in names])
    r = F.col("ratio")
    bands = {"ratio_lt_0_8": r < 0.8, "ratio_0_8_to_1_2": (r >= 0.8) & (r <= 1.2), "ratio_gt_1_2": (r > 1.2) & ~F.isnan(r)}
    n = F.count_if(r.isNotNull() & ~F.isnan(r))
    aggs = [F.count_if(used).alias("evaluated"), F.count_if(~used).alias("skipped")]
    aggs += [finite_mean(F.col(c).cast("double")).alias(f"{c}_mean") for c in names]
    for b, cond in bands.items():
        aggs += [F.count_if(cond).alias(b), F.coalesce(F.try_divide(F.count_if(cond) * 100.0, n), F.lit(0.0)).alias(f"{b}_pct")]
    valid = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    if not has_long_key(rows, []):
        return rows.agg(*aggs, *[F.percentile(valid(c), F.lit(0.5)).alias(f"{c}_median") for c in names])
    rows = materialize(rows)
    out = rows.agg(*aggs).withColumn("_one", F.lit(1))
    for c in names:
        clean = rows.select(valid(c).alias(c)).where(F.col(c).isNotNull())
        out = out.join(exact_percentile(clean, [], c, 0.5, f"{c}_median", long=True).withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def reason_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def segmentation_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of boundary errors per method over lectures."""
    aggs = [F.count(F.lit(1)).alias("n_lectures")]
    for m in ("wd", "pk"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return scores.groupBy("method").agg(*aggs)


def trial_summary(trials: DataFrame) -> DataFrame:
    """Mean and population deviation of boundary errors over a lecture's trials."""
    aggs = [F.count(F.lit(1)).alias("n_trials")]
    for m in ("wd", "pk"):
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return trials.groupBy("lecture_key").agg(*aggs)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with the position at which each is first seen."""
    return rows.groupBy(key).agg(F.min(order).alias("first_at"))


def first_groups(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Rows of the first ``n`` keys in first-seen order."""
    lead = first_seen(rows, key, order).orderBy("first_at").limit(n)
    kept = lead.withColumn("group_no", F.row_number().over(Window.orderBy("first_at"))).drop("first_at")
    # At most n rows, n being the feature's own parameter.
    return rows.join(F.broadcast(kept), key)


def speaker_stats(turns: DataFrame) -> DataFrame:
    return turns.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("avg_chars"))


def size_stats(nodes: DataFrame) -> DataFrame:
    """Leaf count and sizes per lecture."""
    size = F.col("hi") - F.col("lo") + 1
    return nodes.where("is_leaf").groupBy("lecture_key").agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("avg_size"), F.min(size).alias("min_size"), F.max(size).alias("max_size"))


def level_sizes(levels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Average segment size per hierarchy level: positions over boundaries plus one."""
    per = levels.groupBy("lecture_key", "level").agg(F.count("i").alias("n_boundaries"))
    return per.join(sizes, "lecture_key").select(
        "lecture_key", "level", "n_boundaries", (F.col("n") / (F.col("n_boundaries") + 1)).alias("avg_size"))


def published_comparison(spark: SparkSession, means: DataFrame) -> DataFrame:
    """Local means in percent beside the published figures."""
    local = means.select(F.concat(F.lit("local "), F.col("system")).alias("system"), (F.col("bleu1") * 100).alias("bleu"),
                         (F.col("rouge_l") * 100).alias("rouge_l"), (F.col("meteor") * 100).alias("meteor"))
    rows = [(name, *values) for name, values in PUBLISHED.items()]
    return local.unionByName(spark.createDataFrame(rows, "system string, bleu double, rouge_l double, meteor double"))


def status_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of records by outcome."""
    names = {"success": "success_count", "skipped_existing": "skipped_existing_count", "failed": "failure_count", "dry_run": "dry_run_count"}
    aggs = [F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col("status") == s).alias(n) for s, n in names.items()]]
    return records.groupBy(*(by or [])).agg(*aggs)
