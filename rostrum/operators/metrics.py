"""Scores: time-range, timestamp and id retrieval, answers, segment boundaries."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rostrum.functions.text import word_tokens
from rostrum.functions.times import interval_iou, relevance_grade, temporal_distance
from rostrum.plans.ordered import Rows, Step, attach_per_key, deal, interval_pairs, ordered_fold, ordered_scan, pick, row_block

# Cut-offs and the tolerance in seconds.
CUTS = (1, 3, 5)
TOLERANCE_S = 15.0
# Width of the time buckets in which hits and answer ranges meet; it suits segments of some minutes.
BUCKET_S = 120.0

KEY = ["lecture_key"]


# --- retrieval ----------------------------------------------------------------------


def best_iou(ranges: str = "answer_ranges") -> Column:
    """Best overlap ratio of the row's span with any answer range."""
    return F.array_max(F.transform(ranges, lambda r: interval_iou(F.col("start"), F.col("end"), r["start"], r["end"])))


def least_distance(ranges: str = "answer_ranges") -> Column:
    return F.array_min(F.transform(ranges, lambda r: temporal_distance(F.col("start"), F.col("end"), r["start"], r["end"])))


def score_hits(hits: DataFrame, examples: DataFrame) -> DataFrame:
    """Hits with ``iou`` and ``distance`` against their example's answer ranges."""
    joined = hits.join(examples.select("example_id", "answer_ranges"), "example_id")
    bounded = F.col("start").isNotNull() & F.col("end").isNotNull()
    return joined.withColumns({"iou": F.when(bounded, best_iou()), "distance": F.when(bounded, least_distance())})


def temporal_metrics(hits: DataFrame, examples: DataFrame, *, by: list[str] | None = None, cuts=CUTS) -> DataFrame:
    """Per example recall, mean distance and best overlap among the first k hits.

    Without a bounded hit the mean distance is NaN. Examples without hits are kept, with ``by`` for
    every group (say, system) that has hits at all; there are as many groups as are to be compared.
    """
    keys = [*(by or []), "example_id"]
    scored = score_hits(hits, examples)
    aggs = []
    for k in cuts:
        top = F.col("rank") <= k
        aggs += [
            F.max(F.when(top & (F.col("iou") > 0), 1.0).otherwise(0.0)).alias(f"recall@{k}"),
            F.coalesce(F.avg(F.when(top, F.col("distance"))), F.lit(float("nan"))).alias(f"mean_temporal_distance@{k}"),
            F.coalesce(F.max(F.when(top, F.col("iou"))), F.lit(0.0)).alias(f"max_iou@{k}"),
        ]
    found = scored.groupBy(*keys).agg(*aggs)
    every = examples.select("example_id").distinct()
    if by:
        groups = hits.agg(F.collect_set(F.struct(*by)).alias("_groups")).withColumn("_one", F.lit(1))
        every = every.withColumn("_one", F.lit(1)).join(F.broadcast(groups), "_one").select("example_id", F.inline("_groups"))
    fill = {c: F.coalesce(c, F.lit(float("nan") if c.startswith("mean") else 0.0)) for c in found.columns[len(keys):]}
    return every.join(found, keys, "left").withColumns(fill).select(*found.columns)


def gain_discount(gain: Column, rank: Column) -> Column:
    return gain / F.log2(rank + 1)


def ndcg(hits: DataFrame, examples: DataFrame, candidates: DataFrame, *, cuts=CUTS, width: float = BUCKET_S) -> DataFrame:
    """Normalised discounted gain with gain = overlap in percent.

    The ideal order is taken over all candidates of the lecture, ranked by gain. Only candidates that touch an
    answer range are paired with it; they meet in time buckets of ``width`` seconds.
    """
    cut = max(cuts)
    run = score_hits(hits, examples).withColumn("gain", relevance_grade(F.coalesce("iou", F.lit(0.0))))
    dcg = run.groupBy("example_id").agg(*[
        F.sum(F.when(F.col("rank") <= k, gain_discount(F.col("gain"), F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}") for k in cuts])
    wanted = examples.select("example_id", *KEY, F.explode("answer_ranges").alias("r")).select(
        "example_id", *KEY, F.col("r.start").alias("_from"), F.col("r.end").alias("_to"))
    pairs = interval_pairs(candidates.select(*KEY, "idx", "start", "end"), wanted, KEY, width=width,
                           left_span=("start", "end"), right_span=("_from", "_to"))
    iou = F.max(interval_iou(F.col("start"), F.col("end"), F.col("_from"), F.col("_to")))
    gains = pairs.groupBy("example_id", "idx").agg(relevance_grade(iou).alias("gain")).where("gain > 0")
    order = F.row_number().over(Window.partitionBy("example_id").orderBy(F.desc("gain"), "idx"))
    best = gains.withColumn("r", order).where(F.col("r") <= cut)
    ideal = best.groupBy("example_id").agg(*[
        F.sum(F.when(F.col("r") <= k, gain_discount(F.col("gain"), F.col("r"))).otherwise(0.0)).alias(f"idcg{k}") for k in cuts])
    both = examples.select("example_id").join(dcg, "example_id", "left").join(ideal, "example_id", "left")
    return both.select("example_id", *[
        F.coalesce(F.try_divide(F.col(f"dcg{k}"), F.col(f"idcg{k}")), F.lit(0.0)).alias(f"ndcg@{k}") for k in cuts])


def timestamp_metrics(hits: DataFrame, questions: DataFrame, *, tolerance: float = TOLERANCE_S) -> DataFrame:
    """Per question: does a hit hold the timestamp, exactly and within a tolerance, and at which rank first."""
    joined = questions.select("example_id", "timestamp_seconds").join(hits, "example_id", "left")
    t = F.col("timestamp_seconds").cast("double")
    exact = (F.col("start") <= t) & (t <= F.col("end"))
    near = (F.col("start") - tolerance <= t) & (t <= F.col("end") + tolerance)
    aggs = []
    for name, ok in (("exact", exact), ("relaxed", near)):
        first = F.min(F.when(ok, F.col("rank")))
        aggs += [F.when(first.isNotNull(), 1.0).otherwise(0.0).alias(f"retrieval_hit_{name}"),
                 F.coalesce(1.0 / first, F.lit(0.0)).alias(f"retrieval_mrr_{name}")]
    return joined.groupBy("example_id").agg(*aggs)


def id_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Hit, recall and reciprocal rank of the first relevant id; all 0 without truth."""
    gt = F.array_distinct(truth)
    common = F.size(F.array_intersect(gt, F.col(predicted)))
    ranks = F.transform(gt, lambda g: F.nullif(F.array_position(F.col(predicted), g), F.lit(0).cast("long")))
    return rows.withColumns({
        "hit": (common > 0).cast("double"),
        "recall": F.coalesce(F.try_divide(common, F.size(gt)), F.lit(0.0)),
        "mrr": F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))})


def known_ids(rows: DataFrame, ids: str, lookup: DataFrame, id_col: str) -> DataFrame:
    """Keep the ids that exist in their lecture; the list stays in order, maybe empty."""
    flat = rows.select("example_id", *KEY, F.posexplode(ids).alias("p", id_col))
    real = flat.join(lookup.select(*KEY, id_col).distinct(), [*KEY, id_col], "left_semi")
    back = real.groupBy("example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", id_col))), lambda s: s[id_col]).alias("_ids"))
    out = rows.join(back, "example_id", "left")
    return out.withColumn(ids, F.coalesce("_ids", F.array().cast("array<bigint>"))).drop("_ids")


# --- answers ------------------------------------------------------------------------


def _token_counts(answers: DataFrame) -> DataFrame:
    """Per pair and token how often reference and answer use it; counted before the shuffle."""
    side = lambda c, name: answers.select("example_id", F.explode(word_tokens(c)).alias("t"), F.lit(name).alias("s"))
    both = side("answer", "r").unionByName(side("generated", "g"))
    return both.groupBy("example_id", "t").agg(
        F.count_if(F.col("s") == "r").alias("in_ref"), F.count_if(F.col("s") == "g").alias("in_gen"))


def _overlap(answers: DataFrame) -> DataFrame:
    return _token_counts(answers).groupBy("example_id").agg(
        F.sum(F.least("in_ref", "in_gen")).alias("m"), F.sum("in_ref").alias("n_ref"), F.sum("in_gen").alias("n_gen"))


def bleu1(answers: DataFrame) -> DataFrame:
    """Clipped word precision times the brevity penalty."""
    c = _overlap(answers)
    precision = F.col("m") / F.nullif("n_gen", F.lit(0))
    short = F.when(F.col("n_gen") > F.col("n_ref"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("n_ref"), F.col("n_gen"))))
    score = F.when(F.col("m") > 0, precision * short).otherwise(0.0)
    return answers.select("example_id").join(c.select("example_id", score.alias("bleu1")), "example_id", "left").fillna(0.0, ["bleu1"])


def meteor(answers: DataFrame) -> DataFrame:
    """Word matches weighted to recall, with a penalty for scattered matches.

    A token matched m times takes its first m places in the reference; runs of
    consecutive places are the chunks.
    """
    counts = _token_counts(answers).where((F.col("in_ref") > 0) & (F.col("in_gen") > 0))
    places = answers.select("example_id", F.posexplode(word_tokens("answer")).alias("p", "t"))
    turn = F.row_number().over(Window.partitionBy("example_id", "t").orderBy("p"))
    taken = places.join(counts.select("example_id", "t", "in_gen"), ["example_id", "t"]).withColumn("k", turn).where("k <= in_gen")
    prev = F.lag("p").over(Window.partitionBy("example_id").orderBy("p"))
    runs = taken.withColumn("new", (F.coalesce(prev, F.lit(-2)) != F.col("p") - 1).cast("int"))
    chunks = runs.groupBy("example_id").agg(F.sum("new").alias("chunks"))
    c = _overlap(answers).where("m > 0").join(chunks, "example_id")
    p, r = F.col("m") / F.col("n_gen"), F.col("m") / F.col("n_ref")
    score = (1 - 0.5 * F.pow(F.col("chunks") / F.col("m"), F.lit(3))) * (10 * p * r) / (r + 9 * p)
    return answers.select("example_id").join(c.select("example_id", score.alias("meteor")), "example_id", "left").fillna(0.0, ["meteor"])


def common_subsequence(a, b) -> int:
    """Length of the longest common subsequence: one bit per place of ``a``, one step per token of ``b``."""
    where: dict = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & where.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(x, y) for x, y in zip(a, b)], dtype="int64")


def rouge_l(answers: DataFrame) -> DataFrame:
    """Harmonic mean of precision and recall of the longest common word sequence."""
    toks = answers.select("example_id", word_tokens("answer").alias("r"), word_tokens("generated").alias("g"))
    lcs = toks.select("example_id", F.size("r").alias("n_ref"), F.size("g").alias("n_gen"), _lcs("r", "g").alias("l"))
    p, r = F.try_divide(F.col("l"), F.col("n_gen")), F.try_divide(F.col("l"), F.col("n_ref"))
    return lcs.select("example_id", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("rouge_l"))


# --- boundaries ---------------------------------------------------------------------


def _window_size() -> Column:
    half = F.bround(F.col("n") / (F.col("n_ref") + 1) / F.lit(2.0)).cast("long")
    return F.greatest(F.lit(1).cast("long"), F.least(half, F.col("n") - 1))


def boundary_errors(flags: DataFrame, *, keys: list[str] | None = None, long: bool | None = None) -> DataFrame:
    """WindowDiff and Pk of ``hyp`` against ``ref`` flags per lecture.

    The window is half the mean reference segment, at least 1. Running sums at both ends
    of each window are matched by position, so the window may differ per lecture.
    """
    keys = keys or KEY
    n = {"n": ("sum", F.lit(1).cast("long")), "n_ref": ("sum", F.col("ref").cast("long")), "n_hyp": ("sum", F.col("hyp").cast("long"))}
    run = ordered_scan(flags, keys, "i", totals=n, long=long, running={
        "r": ("sum", F.col("ref").cast("long")), "h": ("sum", F.col("hyp").cast("long"))})
    at = run.select(*keys, "i", "n", "n_ref", "n_hyp", _window_size().alias("k"), (F.col("r") - F.col("ref")).alias("r0"), (F.col("h") - F.col("hyp")).alias("h0"))
    ahead = at.select(*keys, (F.col("i") - F.col("k")).alias("i"), F.col("r0").alias("r1"), F.col("h0").alias("h1"))
    win = at.where(F.col("i") <= F.col("n") - F.col("k")).join(ahead, [*keys, "i"], "left")
    dr = F.coalesce("r1", "n_ref") - F.col("r0")
    dh = F.coalesce("h1", "n_hyp") - F.col("h0")
    return win.groupBy(*keys).agg(
        F.max("k").alias("k"), F.avg((dr != dh).cast("double")).alias("wd"),
        F.avg(((dr == 0) != (dh == 0)).cast("double")).alias("pk"))


def fixed_boundaries(sizes: DataFrame) -> DataFrame:
    """Evenly spaced boundary positions: ``lecture_key, n, n_boundaries`` to ``lecture_key, i``."""
    ok = sizes.where((F.col("n_boundaries") > 0) & (F.col("n") >= 2))
    j = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_boundaries")))
    step = F.col("n") / (F.col("n_boundaries") + 1)
    pos = F.least(F.bround(F.col("j") * step).cast("long") - 1, F.col("n") - 2)
    return ok.withColumn("j", j).select(*KEY, F.greatest(pos, F.lit(0).cast("long")).alias("i")).distinct()


def permuted(key: str, size: int, i: int) -> int:
    """Place of ``i`` in a permutation of ``0 .. size - 1`` that the key decides.

    A Feistel network of four rounds permutes the numbers of an even number of bits that hold ``size``;
    a place beyond the size is permuted again, which ends within ``size`` as ``i`` itself lies there.
    """
    half = max(1, (max(size - 1, 0).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = i >> half, i & mask
        for r in range(4):
            digest = hashlib.md5(f"{key}|{r}|{right}".encode()).hexdigest()
            left, right = right, left ^ (int(digest[:8], 16) & mask)
        i = left << half | right
        if i < size:
            return i


@F.pandas_udf(LongType())
def _permuted(key: pd.Series, size: pd.Series, i: pd.Series) -> pd.Series:
    return pd.Series([permuted(k, int(n), int(j)) for k, n, j in zip(key, size, i)], dtype="int64")


def trial_errors(ref: DataFrame, sizes: DataFrame, *, trials: int = 100, seed: int = 42, long: bool | None = None) -> DataFrame:
    """``boundary_errors`` of ``random_boundaries`` per lecture and trial: ``lecture_key, trial, k, wd, pk``.

    ``ref`` are flags at dense positions ``i``, ``sizes`` ``lecture_key, n, n_ref, n_boundaries``. A boundary is in the
    windows from ``k - 1`` positions before it on, up to itself: two rows say where it comes and goes, and the windows in
    between agree or not as one stretch. So there is no row per trial and position, and nothing is joined by position.
    """
    facts = sizes.withColumn("k", _window_size())
    marks = attach_per_key(ref.where("ref = 1").select(*KEY, "i"), facts.select(*KEY, "n", "k"), KEY, row_block("i"), "inner", long=long)
    marks = marks.select("*", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"), F.lit(1).alias("r"), F.lit(0).alias("h"))
    drawn = random_boundaries(facts, trials=trials, seed=seed, keep=("n", "k")).withColumns({"r": F.lit(0), "h": F.lit(1)})
    last = F.col("n") - F.col("k")
    turns = marks.unionByName(drawn).select(*KEY, "trial", "r", "h", last.alias("last"), F.explode(F.array(
        F.struct(F.greatest(F.col("i") - F.col("k") + 1, F.lit(0).cast("long")).alias("at"), F.lit(1).alias("by")),
        F.struct((F.col("i") + 1).alias("at"), F.lit(-1).alias("by")))).alias("t"))
    turns = turns.select(*KEY, "trial", "r", "h", "last", F.col("t.at").alias("at"), F.col("t.by").alias("by")).where("at <= last")
    # Rows at one place make stretches of length 0, whatever their order.
    run = ordered_scan(turns, [*KEY, "trial"], "at", long=long, leads={"_next": (F.col("at"), None)}, running={
        "dr": ("sum", F.col("r") * F.col("by")), "dh": ("sum", F.col("h") * F.col("by"))})
    size = F.coalesce("_next", F.col("last") + 1) - F.col("at")
    dr, dh = F.col("dr"), F.col("dh")
    found = run.groupBy(*KEY, "trial").agg(
        F.sum(F.when(dr != dh, size)).alias("wd"), F.sum(F.when((dr == 0) != (dh == 0), size)).alias("pk"))
    every = facts.select(*KEY, "k", (last + 1).alias("_n"), F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial"))
    share = lambda c: (F.coalesce(c, F.lit(0)) / F.col("_n")).alias(c)
    return every.join(found, [*KEY, "trial"], "left").select(*KEY, "trial", "k", share("wd"), share("pk"))


def random_boundaries(sizes: DataFrame, *, trials: int = 100, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per trial, ``n_boundaries`` distinct positions drawn from the first n - 1; columns to ``keep`` come along.

    The first numbers of a keyed permutation are drawn, a row each: nothing is ranked, and no position
    that is not drawn is looked at. A lost task draws the same ones again.
    """
    ok = sizes.where((F.col("n_boundaries") > 0) & (F.col("n") >= 2))
    spots = ok.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n_boundaries"), F.col("n") - 1) - 1)))
    key = F.concat_ws("|", F.lit(str(seed)), *KEY, F.col("trial").cast("string"))
    return deal(spots).select(*KEY, *keep, "trial", _permuted(key, F.col("n") - 1, F.col("j")).alias("i"))


def tolerance_match(flags: DataFrame, *, tolerance: int = 2) -> DataFrame:
    """Match predicted to true boundaries within a tolerance; precision, recall, F1.

    Predictions in order take the first free true boundary in reach. Walking the
    positions once with the boundaries still waiting on either side gives the same pairs.
    """

    def fold(rows: Rows, state: str | None):
        preds, trues = ([], []) if state is None else json.loads(state)
        hits = 0
        for i, ref, hyp in zip(rows["i"].tolist(), rows["ref"].tolist(), rows["hyp"].tolist()):
            preds = [p for p in preds if p >= i - tolerance]
            trues = [q for q in trues if q >= i - tolerance]
            if ref:
                if preds:
                    preds.pop(0)
                    hits += 1
                else:
                    trues.append(i)
            if hyp:
                if trues:
                    trues.pop(0)
                    hits += 1
                else:
                    preds.append(i)
        out = {"lecture_key": rows["lecture_key"][:1], "hits": [hits], "n_ref": [int(rows["ref"].sum())],
               "n_hyp": [int(rows["hyp"].sum())]}
        return out, json.dumps([preds, trues])

    part = ordered_fold(flags.select(*KEY, "i", "ref", "hyp"), KEY, "i", fold, "lecture_key string, hits long, n_ref long, n_hyp long")
    s = part.groupBy(*KEY).agg(F.sum("hits").alias("hits"), F.sum("n_ref").alias("n_ref"), F.sum("n_hyp").alias("n_hyp"))
    none = (F.col("n_ref") == 0) & (F.col("n_hyp") == 0)
    p = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("hits"), F.col("n_hyp")), F.lit(0.0)))
    r = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(F.col("hits"), F.col("n_ref")), F.lit(0.0)))
    return s.select(*KEY, p.alias("precision"), r.alias("recall"),
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def min_gap_boundaries(positions: DataFrame, *, min_size: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Clear a boundary that follows a kept one by fewer than ``min_size`` positions.

    Positions before ``min_size - 1`` are never cleared.
    """
    keys = keys or KEY
    schema = ", ".join(f"{c} {t}" for c, t in positions.select(*keys, "i").dtypes)

    def fold(rows: Rows, state: str | None):
        last = -min_size if state is None else int(state)
        keep = []
        for i in rows["i"].tolist():
            ok = i < min_size - 1 or i - last >= min_size
            keep.append(ok)
            last = i if ok else last
        return pick(rows, [*keys, "i"], keep), str(last)

    def make(rows: Rows) -> str:
        first = int(rows["i"][0])
        return json.dumps([first, [int(fold(rows, str(first - d))[1]) for d in range(1, min_size + 1)]])

    def apply(step: str, state: str | None) -> str:
        first, exits = json.loads(step)  # by the distance to the last kept one, which no longer counts from min_size on
        return str(exits[-1 if state is None else min(first - int(state), min_size) - 1])

    return ordered_fold(positions.select(*keys, "i"), keys, "i", fold, schema, step=Step(make, apply))
