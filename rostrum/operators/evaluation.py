"""Whole evaluations: retrieval systems against answer times, segmentations of lectures against their slides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators import metrics as mt
from rostrum.operators import search as se
from rostrum.operators import tree as tr
from rostrum.operators.slides import reference_boundaries
from rostrum.session import materialize

KEY = ["lecture_key"]


def retrieval_scores(
    systems: dict[str, tuple[DataFrame, bool]], queries: DataFrame, examples: DataFrame, *, first: int = se.FIRST_STAGE,
    final: int = se.FINAL_HITS, cuts=mt.CUTS, width: float = mt.BUCKET_S,
) -> DataFrame:
    """Per system and question: recall, mean distance, best overlap and nDCG of the hits that a two-stage search keeps.

    A system is its records (``lecture_key, rec_id, text, start, end, embedding``, tree columns if any) and whether these are a
    tree, whose inner nodes bring evidence and whose overlapping hits go. The ideal order of the gain is taken over all
    records of the lecture. ``examples`` are ``example_id, lecture_key, answer_ranges``; questions without hits count with nothing found.
    """
    out = None
    for name, (records, tree) in systems.items():
        found = se.two_stage_search(queries, records, top_k=first, top_n=final, tree=tree)
        hits = materialize(found.select(F.col("query_id").alias("example_id"), "rank", "start", "end"))
        candidates = records.select(*KEY, F.col("rec_id").alias("idx"), "start", "end")
        scores = mt.temporal_metrics(hits, examples, cuts=cuts).join(mt.ndcg(hits, examples, candidates, cuts=cuts, width=width), "example_id")
        scores = scores.withColumn("system", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def segmentation_cases(utts: DataFrame, slides: DataFrame, *, block_seconds: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """Reference flags of every utterance, and one row per lecture: can it be evaluated, and with how many baseline cuts.

    ``utts`` are ``lecture_key, idx, start, end``, ``slides`` ``lecture_key, slide_index, end``. A lecture is skipped, with
    a reason, if it has fewer than two slides, fewer than two utterances, or no slide change between its utterances.
    The baselines get as many cuts as the lecture has slides, less one, whatever the reference holds.
    """
    ref = reference_boundaries(utts, slides, block_seconds=block_seconds).select(
        *KEY, F.col("idx").alias("i"), F.col("flag").alias("ref"))
    sizes = ref.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("ref").alias("n_ref"))
    n_slides = slides.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_slides"))
    cases = sizes.join(n_slides, KEY, "full").na.fill(0, ["n", "n_ref", "n_slides"])
    reason = (F.when(F.col("n_slides") < 2, "too_few_slides").when(F.col("n") < 2, "too_few_utterances")
              .when(F.col("n_ref") == 0, "no_slide_change"))
    return ref, cases.withColumns({"reason": reason, "n_boundaries": F.col("n_slides") - 1})


def segmentation_errors(
    ref: DataFrame, cases: DataFrame, nodes: DataFrame, *, trials: int = 100, seed: int = 42, long: bool | None = None
) -> DataFrame:
    """WindowDiff and Pk per lecture and method: ``tree`` at its natural size, ``fixed_window`` and ``random`` cuts.

    The random row holds the means of its trials and their deviations, the others have none.
    """
    able = cases.where("reason IS NULL")
    ref = ref.join(able.select(*KEY), KEY, "left_semi")
    errors = []
    cuts = {"tree": tr.leaf_flags(nodes, side="last").where("flag = 1").select(*KEY, "i"),
            "fixed_window": mt.fixed_boundaries(able.select(*KEY, "n", "n_boundaries"))}
    for method, at in cuts.items():
        flags = ref.join(at.withColumn("hyp", F.lit(1)), [*KEY, "i"], "left").fillna(0, ["hyp"])
        none = F.lit(None).cast("double")
        errors.append(mt.boundary_errors(flags, long=long).select(
            *KEY, F.lit(method).alias("method"), "wd", "pk", none.alias("wd_std"), none.alias("pk_std")))
    tried = mt.trial_errors(ref, able.select(*KEY, "n", "n_ref", "n_boundaries"), trials=trials, seed=seed, long=long)
    errors.append(tried.groupBy(*KEY).agg(
        F.lit("random").alias("method"), F.avg("wd").alias("wd"), F.avg("pk").alias("pk"),
        F.stddev_pop("wd").alias("wd_std"), F.stddev_pop("pk").alias("pk_std")))
    return errors[0].unionByName(errors[1]).unionByName(errors[2])


def evaluation_means(errors: DataFrame) -> DataFrame:
    """Means over lectures per method, those of the deviations between random trials included."""
    return errors.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_lectures"), *[F.avg(c).alias(c) for c in ("wd", "pk", "wd_std", "pk_std")])
