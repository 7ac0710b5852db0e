"""Queries that score retrieval, answers and boundaries, and sum the scores up."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import times as tm
from rostrum.operators import evaluation as ev
from rostrum.operators import metrics as mt
from rostrum.operators import report as rp
from rostrum.operators import tree as tr
from rostrum.operators.words import estimate_max_gap
from rostrum.plans.fixtures import DAY, WORDS_RE, Tables, draws_sql, errors_sql
from rostrum.plans.ordered import has_long_key, interval_pairs, ordered_scan
from rostrum.plans.registry import ctes, query


def _rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(f"`{c}`", places) for c in cols})


# --- retrieval ----------------------------------------------------------------------

_TS = """, m AS (SELECT q.example_id, max(CASE WHEN h.start <= q.timestamp_seconds AND q.timestamp_seconds <= h."end" THEN 1.0 ELSE 0.0 END)::DOUBLE AS retrieval_hit_exact,
  round(coalesce(max(CASE WHEN h.start <= q.timestamp_seconds AND q.timestamp_seconds <= h."end" THEN 1.0::DOUBLE / rank END), 0.0), 6) AS retrieval_mrr_exact,
  max(CASE WHEN h.start - 15 <= q.timestamp_seconds AND q.timestamp_seconds <= h."end" + 15 THEN 1.0 ELSE 0.0 END)::DOUBLE AS retrieval_hit_relaxed,
  round(coalesce(max(CASE WHEN h.start - 15 <= q.timestamp_seconds AND q.timestamp_seconds <= h."end" + 15 THEN 1.0::DOUBLE / rank END), 0.0), 6) AS retrieval_mrr_relaxed
  FROM tq q LEFT JOIN ts_hits h USING (example_id) GROUP BY 1)"""


@query("timestamp_metrics", ctes("ts_hits", body=_TS + " SELECT * FROM m"))
def _(t: Tables):
    return _rounded(mt.timestamp_metrics(t.ts_hits, t.ts_questions), "retrieval_mrr_exact", "retrieval_mrr_relaxed")


@query("hit_range_scores", ctes("rhits", body="SELECT example_id, idx, rank, round(iou, 6) AS iou, round(dist, 6) AS distance FROM rhits"))
def _(t: Tables):
    s = mt.score_hits(t.range_hits, t.range_questions)
    return _rounded(s, "iou", "distance").select("example_id", "idx", F.col("rank").cast("long").alias("rank"), "iou", "distance")


_TEMPORAL = ", ".join(f"""max(CASE WHEN rank <= {k} AND iou > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS "recall@{k}",
  round(avg(CASE WHEN rank <= {k} THEN dist END), 6) AS "mean_temporal_distance@{k}", round(max(CASE WHEN rank <= {k} THEN iou END), 6) AS "max_iou@{k}" """ for k in (1, 3, 5))


@query("temporal_metrics", ctes("rhits", body=f"SELECT example_id, {_TEMPORAL} FROM rhits GROUP BY 1"))
def _(t: Tables):
    m = mt.temporal_metrics(t.range_hits, t.range_questions)
    return _rounded(m, *[c for c in m.columns if "distance" in c or "iou" in c])


_NDCG = """, run AS (SELECT example_id, rank, round_even(iou * 100, 0) AS g FROM rhits),
ideal AS (SELECT example_id, round_even(iou * 100, 0) AS g, row_number() OVER (PARTITION BY example_id ORDER BY round_even(iou * 100, 0) DESC, idx) AS r FROM rcand),
a AS (SELECT example_id, """ + ", ".join(f"sum(CASE WHEN rank <= {k} THEN g / log2(rank + 1) ELSE 0 END) AS d{k}" for k in (1, 3, 5)) + """ FROM run GROUP BY 1),
b AS (SELECT example_id, """ + ", ".join(f"sum(CASE WHEN r <= {k} THEN g / log2(r + 1) ELSE 0 END) AS i{k}" for k in (1, 3, 5)) + """ FROM ideal GROUP BY 1)
SELECT rq.example_id, """ + ", ".join(f'round(CASE WHEN coalesce(i{k}, 0) > 0 THEN coalesce(d{k}, 0) / i{k} ELSE 0.0 END, 6) AS "ndcg@{k}"' for k in (1, 3, 5)) + """
FROM rq LEFT JOIN a USING (example_id) LEFT JOIN b USING (example_id)"""


@query("ndcg", ctes("rhits", body=_NDCG))
def _(t: Tables):
    m = mt.ndcg(t.range_hits, t.range_questions, t.paused, width=DAY)
    return _rounded(m, "ndcg@1", "ndcg@3", "ndcg@5")


@query("relevance_grades", ctes("rcand", body="SELECT example_id, idx, round_even(iou * 100, 0)::BIGINT AS grade FROM rcand WHERE iou > 0"))
def _(t: Tables):
    q = t.range_questions.select("example_id", "lecture_key", F.explode("answer_ranges").alias("r"))
    u = t.paused.select("lecture_key", "idx", "start", "end")
    a = q.select("example_id", "lecture_key", F.col("r.start").alias("rs"), F.col("r.end").alias("re"))
    pairs = interval_pairs(u, a, ["lecture_key"], width=86400.0, left_span=("start", "end"), right_span=("rs", "re"))
    iou = tm.interval_iou(F.col("start"), F.col("end"), F.col("rs"), F.col("re"))
    best = pairs.groupBy("example_id", "idx").agg(F.max(iou).alias("iou")).where("iou > 0")
    return best.select("example_id", "idx", tm.relevance_grade(F.col("iou")).alias("grade"))


# Ids: truth = the document numbers in a page's text, prediction = the five numbers after the page's own.
_IDS = """WITH c AS (SELECT page_id AS example_id, list_transform(regexp_extract_all(url, '\\d+'), lambda x: try_cast(x AS BIGINT)) AS gt FROM pages),
p AS (SELECT *, [example_id % 7, example_id % 11, example_id % 13, example_id % 101, example_id % 997] AS pr FROM c)"""


def _id_rows(t: Tables):
    p = t.table("pages").select(F.col("page_id").alias("example_id"), F.lit("docs").alias("lecture_key"), tm.parse_id_list("url").alias("gt"))
    return p.withColumn("pr", F.array(*[F.col("example_id") % m for m in (7, 11, 13, 101, 997)]))


@query("id_metrics", _IDS + """, m AS (SELECT example_id, list_distinct(gt) AS g, pr FROM p),
r AS (SELECT *, list_min(list_transform(g, lambda x: nullif(list_position(pr, x), 0))) AS f FROM m)
SELECT example_id, (len(list_intersect(g, pr)) > 0)::INT::DOUBLE AS hit, round(coalesce(len(list_intersect(g, pr))::DOUBLE / nullif(len(g), 0), 0), 6) AS recall,
  round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr FROM r""")
def _(t: Tables):
    return _rounded(mt.id_metrics(_id_rows(t), "gt", "pr"), "recall", "mrr").select("example_id", "hit", "recall", "mrr")


@query("known_ids", _IDS + """, u AS (SELECT example_id, unnest(gt) AS x, unnest(range(len(gt))) AS j FROM p)
SELECT p.example_id, coalesce(s.ids, '') AS ids FROM p LEFT JOIN (SELECT example_id, string_agg(x::VARCHAR, ',' ORDER BY j) AS ids FROM u
  WHERE x IN (SELECT doc_id FROM documents) GROUP BY 1) s USING (example_id)""")
def _(t: Tables):
    lookup = t.documents.select(F.lit("docs").alias("lecture_key"), F.col("doc_id").alias("gid"))
    k = mt.known_ids(_id_rows(t), "gt", lookup, "gid")
    return k.select("example_id", F.array_join(F.col("gt").cast("array<string>"), ",").alias("ids"))


# --- answers ------------------------------------------------------------------------


@query("bleu1", ctes("aover", body="""SELECT example_id, round(CASE WHEN m = 0 THEN 0.0 ELSE m / ng * CASE WHEN ng > nr THEN 1.0 ELSE exp(1 - nr / ng) END END, 6) AS bleu1 FROM aover"""))
def _(t: Tables):
    return _rounded(mt.bleu1(t.answers), "bleu1")


_METEOR = """, pl AS (SELECT k.example_id, k.p FROM (SELECT *, row_number() OVER (PARTITION BY example_id, t ORDER BY p) AS k FROM atok WHERE s = 'r') k
  JOIN acnt c ON c.example_id = k.example_id AND c.t = k.t WHERE k.k <= c.cg),
ch AS (SELECT example_id, count(*) FILTER (d IS NULL OR d <> 1) AS chunks FROM (SELECT *, p - lag(p) OVER (PARTITION BY example_id ORDER BY p) AS d FROM pl) GROUP BY 1),
me AS (SELECT o.example_id, CASE WHEN m = 0 THEN 0.0 ELSE (1 - 0.5 * (chunks / m) ** 3) * (10 * (m / ng) * (m / nr)) / (m / nr + 9 * (m / ng)) END AS meteor
  FROM aover o LEFT JOIN ch USING (example_id))"""


@query("meteor", ctes("aover", body=_METEOR + "SELECT example_id, round(meteor, 6) AS meteor FROM me"))
def _(t: Tables):
    return _rounded(mt.meteor(t.answers), "meteor")


# One row of the longest common subsequence table per word of the reference.
_LCS = """, tk AS (SELECT example_id, regexp_extract_all(lower(answer), '@W@') AS r, regexp_extract_all(lower(generated), '@W@') AS g FROM answers),
lcs AS (SELECT example_id, r, g, 0 AS k, list_transform(g, lambda x: 0) AS d FROM tk
  UNION ALL SELECT example_id, r, g, k + 1, list_transform(range(1, len(g) + 1), lambda j: list_max(c[1:j])) FROM (
    SELECT *, list_transform(range(1, len(g) + 1), lambda j: CASE WHEN g[j] = r[k + 1] THEN coalesce(d[j - 1], 0) + 1 ELSE d[j] END) AS c
    FROM lcs WHERE k < len(r))),
rg AS (SELECT example_id, CASE WHEN l = 0 THEN 0.0::DOUBLE ELSE 2 * (l / ng) * (l / nr) / (l / ng + l / nr) END AS rouge_l FROM (
  SELECT example_id, len(r) AS nr, len(g) AS ng, coalesce(list_max(d), 0) AS l FROM lcs WHERE k = len(r)))""".replace("@W@", WORDS_RE)


@query("rouge_l", ctes("answers", body=_LCS + " SELECT example_id, round(rouge_l, 6) AS rouge_l FROM rg"))
def _(t: Tables):
    return _rounded(mt.rouge_l(t.answers), "rouge_l")


@query("answer_means_and_published", ctes("aover", body=_METEOR + _LCS + """, b AS (SELECT CASE WHEN (o.example_id // 100) % 2 = 0 THEN 'even' ELSE 'odd' END AS system,
  CASE WHEN m = 0 THEN 0.0 ELSE m / ng * CASE WHEN ng > nr THEN 1.0 ELSE exp(1 - nr / ng) END END AS bleu1, meteor, rouge_l
  FROM aover o JOIN me USING (example_id) JOIN rg USING (example_id))
SELECT 'local ' || system AS system, round(avg(bleu1) * 100, 6) AS bleu, round(avg(rouge_l) * 100, 6) AS rouge_l, round(avg(meteor) * 100, 6) AS meteor FROM b GROUP BY 1
UNION ALL SELECT * FROM (VALUES ('Video LlaVA 7B (paper)', 12.47::DOUBLE, 21.84::DOUBLE, 17.55::DOUBLE), ('mPLUG Owl 3 8B (paper)', 18.17, 31.79, 19.64),
  ('Qwen VL 7B (paper)', 18.36, 33.00, 19.22), ('Llava 13B (paper)', 17.16, 20.03, 31.41), ('GPT4o (paper)', 15.03, 32.87, 22.46),
  ('Gemini 1.5 (paper)', 13.98, 30.76, 21.25))"""))
def _(t: Tables):
    a = t.answers
    rows = mt.bleu1(a).join(mt.meteor(a), "example_id").join(mt.rouge_l(a), "example_id").withColumns({
        "system": F.when(F.expr("(example_id div 100) % 2") == 0, "even").otherwise("odd")})
    means = rp.system_means(rows, ["bleu1", "rouge_l", "meteor"], skip_nan=False)
    return _rounded(rp.published_comparison(t.spark, means), "bleu", "rouge_l", "meteor")


# --- boundaries ---------------------------------------------------------------------


@query("fixed_boundaries", ctes("fixed", body="SELECT * FROM fixed"))
def _(t: Tables):
    return mt.fixed_boundaries(t.sizes)


_WD = """, g AS (SELECT b.lecture_key, b.i, s.n, greatest(1, least(round_even(s.n / (s.nb + 1)::DOUBLE / 2.0, 0)::BIGINT, s.n - 1)) AS k,
  sum(ref) OVER w - ref AS r, sum(hyp) OVER w - hyp AS h, sum(ref) OVER (PARTITION BY b.lecture_key) AS tr, sum(hyp) OVER (PARTITION BY b.lecture_key) AS th
  FROM bflags b JOIN sizes s USING (lecture_key) WINDOW w AS (PARTITION BY b.lecture_key ORDER BY b.i)),
wd AS (SELECT a.lecture_key, any_value(a.k) AS k, avg((coalesce(b.r, a.tr) - a.r <> coalesce(b.h, a.th) - a.h)::INT) AS wd,
  avg(((coalesce(b.r, a.tr) - a.r = 0) <> (coalesce(b.h, a.th) - a.h = 0))::INT) AS pk
  FROM g a LEFT JOIN g b ON b.lecture_key = a.lecture_key AND b.i = a.i + a.k WHERE a.i <= a.n - a.k GROUP BY 1)"""


@query("boundary_errors", ctes("bflags", body=_WD + "SELECT lecture_key, k, round(wd, 6) AS wd, round(pk, 6) AS pk FROM wd"))
def _(t: Tables):
    return _rounded(mt.boundary_errors(t.boundary_flags), "wd", "pk")


@query("segmentation_summary", ctes("bflags", body=_WD + """SELECT 'fixed_window' AS method, count(*) AS n_lectures, round(avg(wd), 6) AS wd_mean,
  round(stddev_pop(wd), 6) AS wd_std, round(avg(pk), 6) AS pk_mean, round(stddev_pop(pk), 6) AS pk_std FROM wd"""))
def _(t: Tables):
    e = mt.boundary_errors(t.boundary_flags).withColumn("method", F.lit("fixed_window"))
    return _rounded(rp.segmentation_summary(e), "wd_mean", "wd_std", "pk_mean", "pk_std")


TRIALS = 100


@query("random_boundary_trials", ctes("sizes", body=f""", {draws_sql("sizes", TRIALS)},
fl AS (SELECT r.lecture_key, 'random' AS method, t.trial, r.i, r.ref, (d.i IS NOT NULL)::INT AS hyp FROM refs r CROSS JOIN (SELECT unnest(range(1, {TRIALS} + 1)) AS trial) t
  LEFT JOIN draws d ON d.lecture_key = r.lecture_key AND d.trial = t.trial AND d.i = r.i), {errors_sql("fl")}
SELECT lecture_key, count(*) AS n_trials, round(avg(wd), 6) AS wd_mean, round(stddev_pop(wd), 6) AS wd_std, round(avg(pk), 6) AS pk_mean,
  round(stddev_pop(pk), 6) AS pk_std FROM wd GROUP BY 1"""))
def _(t: Tables):
    # A trial has at most four rows per utterance, and a lecture no more utterances than words.
    errors = mt.trial_errors(t.refs, t.sizes.withColumn("n_ref", F.col("n_boundaries")), trials=TRIALS, long=has_long_key(t.words, ["lecture_key"]))
    return _rounded(rp.trial_summary(errors), "wd_mean", "wd_std", "pk_mean", "pk_std")


@query("random_boundaries", ctes("sizes", body=f", {draws_sql('sizes', 5)} SELECT * FROM draws"))
def _(t: Tables):
    return mt.random_boundaries(t.sizes, trials=5).withColumn("trial", F.col("trial").cast("long"))


_SEGMENTED = f""", {draws_sql("(SELECT * FROM bcases WHERE reason IS NULL)", TRIALS)},
able AS (SELECT r.*, c.n, c.nb FROM brefs r JOIN bcases c USING (lecture_key) WHERE c.reason IS NULL),
bfixed AS (SELECT DISTINCT lecture_key, greatest(least(round_even(j * (n / (nb + 1)::DOUBLE), 0)::BIGINT - 1, n - 2), 0) AS i
  FROM (SELECT *, unnest(range(1, nb + 1)) AS j FROM bcases WHERE reason IS NULL)),
bends AS (SELECT lecture_key, hi AS i FROM (SELECT *, max(hi) OVER (PARTITION BY lecture_key) AS m FROM leaves) WHERE hi < m),
fl AS (SELECT a.lecture_key, 'tree' AS method, 0 AS trial, a.i, ref, (c.i IS NOT NULL)::INT AS hyp FROM able a LEFT JOIN bends c ON c.lecture_key = a.lecture_key AND c.i = a.i
  UNION ALL SELECT a.lecture_key, 'fixed_window', 0, a.i, ref, (c.i IS NOT NULL)::INT FROM able a LEFT JOIN bfixed c ON c.lecture_key = a.lecture_key AND c.i = a.i
  UNION ALL SELECT a.lecture_key, 'random', t.trial, a.i, ref, (d.i IS NOT NULL)::INT FROM able a CROSS JOIN (SELECT unnest(range(1, {TRIALS} + 1)) AS trial) t
    LEFT JOIN draws d ON d.lecture_key = a.lecture_key AND d.trial = t.trial AND d.i = a.i), {errors_sql("fl")},
er AS (SELECT lecture_key, method, avg(wd) AS wd, avg(pk) AS pk, CASE WHEN method = 'random' THEN stddev_pop(wd) END AS wd_std,
  CASE WHEN method = 'random' THEN stddev_pop(pk) END AS pk_std FROM wd GROUP BY 1, 2)"""


def _segmentation_errors(t: Tables):
    ref, cases = ev.segmentation_cases(t.entries.select("lecture_key", "idx", "start", "end"), t.block_slides, block_seconds=300.0)
    return ev.segmentation_errors(ref, cases, t.nodes, trials=TRIALS, long=has_long_key(t.blocks, ["lecture_key"]))


@query("segmentation_cases", ctes("bcases", body="SELECT lecture_key, n, n_ref, n_slides, reason, nb AS n_boundaries FROM bcases"))
def _(t: Tables):
    return ev.segmentation_cases(t.entries.select("lecture_key", "idx", "start", "end"), t.block_slides, block_seconds=300.0)[1]


@query("segmentation_errors", ctes("leaves", "bcases", body=_SEGMENTED + """SELECT lecture_key, method, round(wd, 6) AS wd, round(pk, 6) AS pk,
  round(wd_std, 6) AS wd_std, round(pk_std, 6) AS pk_std FROM er"""))
def _(t: Tables):
    return _rounded(_segmentation_errors(t), "wd", "pk", "wd_std", "pk_std")


@query("segmentation_evaluation", ctes("leaves", "bcases", body=_SEGMENTED + """SELECT method, count(*) AS n_lectures, round(avg(wd), 6) AS wd, round(avg(pk), 6) AS pk,
  round(avg(wd_std), 6) AS wd_std, round(avg(pk_std), 6) AS pk_std FROM er GROUP BY 1"""))
def _(t: Tables):
    return _rounded(ev.evaluation_means(_segmentation_errors(t)), "wd", "pk", "wd_std", "pk_std")


@query("tolerance_match", ctes("bflags", body="""
, nn AS (SELECT lecture_key, list(i ORDER BY i) FILTER (ref = 1) AS rs, list(i ORDER BY i) FILTER (hyp = 1) AS hs, sum(ref) AS nr, sum(hyp) AS nh FROM bflags GROUP BY 1),
f AS (SELECT lecture_key, 0::BIGINT AS j, -1::BIGINT AS last, 0::BIGINT AS hits FROM nn
  UNION ALL SELECT lecture_key, j + 1, coalesce(q, last), hits + (q IS NOT NULL)::BIGINT FROM (
    SELECT f.lecture_key, f.j, f.last, f.hits, list_min(list_filter(nn.rs, lambda x: x > f.last AND abs(x - nn.hs[f.j + 1]) <= 2)) AS q
    FROM f JOIN nn ON nn.lecture_key = f.lecture_key WHERE f.j < coalesce(len(nn.hs), 0))),
h AS (SELECT lecture_key, max(hits) AS hits FROM f GROUP BY 1),
pr AS (SELECT lecture_key, CASE WHEN nr = 0 AND nh = 0 THEN 1.0 WHEN nh = 0 THEN 0.0 ELSE hits / nh END::DOUBLE AS p, CASE WHEN nr = 0 AND nh = 0 THEN 1.0
  WHEN nr = 0 THEN 0.0 ELSE hits / nr END::DOUBLE AS r FROM nn JOIN h USING (lecture_key))
SELECT lecture_key, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM pr"""))
def _(t: Tables):
    return _rounded(mt.tolerance_match(t.boundary_flags), "precision", "recall", "f1")


@query("min_gap_boundaries", ctes("refs", body="""
, b AS (SELECT lecture_key, i, row_number() OVER (PARTITION BY lecture_key ORDER BY i) AS n FROM refs WHERE ref = 1),
f AS (SELECT lecture_key, n, i, i AS last, true AS ok FROM b WHERE n = 1
  UNION ALL SELECT b.lecture_key, b.n, b.i, CASE WHEN b.i < 4 OR b.i - f.last >= 5 THEN b.i ELSE f.last END, b.i < 4 OR b.i - f.last >= 5
  FROM f JOIN b ON b.lecture_key = f.lecture_key AND b.n = f.n + 1)
SELECT lecture_key, i FROM f WHERE ok"""))
def _(t: Tables):
    return mt.min_gap_boundaries(t.boundary_flags.where("ref = 1").select("lecture_key", "i"))


# --- summaries ----------------------------------------------------------------------


def _systems(t: Tables):
    """Per question and system the timestamp metrics; the systems differ in what they rank by."""
    parts = [
        mt.timestamp_metrics(t._nearest(t.ts_questions, "timestamp_seconds", side).select("example_id", "rank", "start", "end"),
                             t.ts_questions).withColumn("system", F.lit(f"by_{side}")) for side in ("start", "end")]
    return parts[0].unionByName(parts[1])


_NAMES = ["retrieval_hit_exact", "retrieval_mrr_exact", "retrieval_hit_relaxed", "retrieval_mrr_relaxed"]
_SYS = """, he AS (SELECT * FROM (SELECT q.example_id, q.timestamp_seconds, u.start, u."end", row_number() OVER (PARTITION BY q.example_id
  ORDER BY abs(u."end" - q.timestamp_seconds), u.idx) AS rank FROM tq q JOIN paused u USING (lecture_key)) WHERE rank <= 5),
al AS (SELECT 'by_start' AS system, * FROM ts_hits UNION ALL SELECT 'by_end', * FROM he),
m AS (SELECT system, example_id, max(CASE WHEN start <= timestamp_seconds AND timestamp_seconds <= "end" THEN 1.0 ELSE 0.0 END) AS retrieval_hit_exact,
  coalesce(max(CASE WHEN start <= timestamp_seconds AND timestamp_seconds <= "end" THEN 1.0::DOUBLE / rank END), 0.0) AS retrieval_mrr_exact,
  max(CASE WHEN start - 15 <= timestamp_seconds AND timestamp_seconds <= "end" + 15 THEN 1.0 ELSE 0.0 END) AS retrieval_hit_relaxed,
  coalesce(max(CASE WHEN start - 15 <= timestamp_seconds AND timestamp_seconds <= "end" + 15 THEN 1.0::DOUBLE / rank END), 0.0) AS retrieval_mrr_relaxed FROM al GROUP BY 1, 2),
s AS (SELECT system, count(*) AS question_count, avg(retrieval_hit_exact) AS retrieval_hit_exact, avg(retrieval_mrr_exact) AS retrieval_mrr_exact,
  avg(retrieval_hit_relaxed) AS retrieval_hit_relaxed, avg(retrieval_mrr_relaxed) AS retrieval_mrr_relaxed FROM m GROUP BY 1)"""


@query("system_means", ctes("ts_hits", body=_SYS + "SELECT system, question_count, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM s"))
def _(t: Tables):
    return _rounded(rp.system_means(_systems(t), _NAMES), *_NAMES)


@query("metric_deltas", ctes("ts_hits", body=_SYS + " UNION ALL ".join(
    f"SELECT 'by_end' AS system, 'by_start' AS base, '{n}' AS metric, round((SELECT {n} FROM s WHERE system = 'by_end') - (SELECT {n} FROM s WHERE system = 'by_start'), 6) AS delta"
    for n in _NAMES)))
def _(t: Tables):
    return _rounded(rp.metric_deltas(rp.system_means(_systems(t), _NAMES), _NAMES, "by_start"), "delta")


@query("leaderboard", ctes("ts_hits", body=_SYS + """SELECT system, row_number() OVER (ORDER BY retrieval_mrr_exact DESC, system) AS place FROM s"""))
def _(t: Tables):
    b = rp.leaderboard(rp.system_means(_systems(t), _NAMES), "retrieval_mrr_exact")
    return b.select("system", F.col("place").cast("long").alias("place"))


@query("best_system_per_lecture", ctes("ts_hits", body=_SYS + """, l AS (SELECT m.system, q.lecture_key, round(avg(retrieval_mrr_exact), 6) AS v FROM m JOIN tq q USING (example_id) GROUP BY 1, 2)
SELECT lecture_key, arg_min(system, {'v': v, 'system': system}) AS system, min(v) AS v FROM l GROUP BY 1"""))
def _(t: Tables):
    m = _systems(t).join(t.ts_questions.select("example_id", "lecture_key"), "example_id")
    per = m.groupBy("system", "lecture_key").agg(F.round(F.avg("retrieval_mrr_exact"), 6).alias("v"))
    return rp.best_system(per, "v", ["lecture_key"])


@query("temporal_metric_means", ctes("rhits", body=f"""
, m AS (SELECT example_id, {_TEMPORAL} FROM rhits GROUP BY 1)
SELECT count(*) AS question_count, """ + ", ".join(f'round(avg("{c}@{k}"), 4) AS "{c}@{k}"' for c in ("recall", "mean_temporal_distance", "max_iou") for k in (1, 3, 5)) + " FROM m"))
def _(t: Tables):
    m = mt.temporal_metrics(t.range_hits, t.range_questions).withColumn("system", F.lit("nearest"))
    cols = rp.metric_columns(m)
    return _rounded(rp.system_means(m, cols), *cols, places=4).drop("system")


_COUNTS = """, ns AS (SELECT lecture_key, count(*) AS n_slides FROM slides GROUP BY 1), ng AS (SELECT lecture_key, count(*) AS n_segments FROM leaves GROUP BY 1),
every AS (SELECT lecture_key, n_slides, n_segments, max_gap_s,
  CASE WHEN max_gap_s IS NULL THEN 'no_words' WHEN n_slides IS NULL THEN 'no_slides' WHEN n_segments IS NULL THEN 'no_segments' END AS reason
  FROM ns FULL JOIN ng USING (lecture_key) FULL JOIN auto_gap USING (lecture_key)),
call AS (SELECT *, n_segments - n_slides AS diff, abs(n_segments - n_slides) AS abs_diff,
  CASE WHEN reason IS NULL THEN n_segments / n_slides::DOUBLE END AS ratio FROM every),
c AS (SELECT * FROM call WHERE reason IS NULL)"""


def _counts(t: Tables):
    s = t.slides.groupBy("lecture_key").agg(F.count(F.lit(1)).alias("n_slides"))
    g = tr.leaves(t.nodes).groupBy("lecture_key").agg(F.count(F.lit(1)).alias("n_segments"))
    return rp.count_comparison(s.join(g, "lecture_key", "full").join(estimate_max_gap(t.words), "lecture_key", "full"))


@query("segment_slide_counts", ctes("slides", "leaves", "auto_gap", body=_COUNTS + "SELECT lecture_key, n_slides, n_segments, reason, diff, abs_diff, round(ratio, 6) AS ratio, round(max_gap_s, 6) AS max_gap_s FROM call"))
def _(t: Tables):
    return _rounded(_counts(t), "ratio", "max_gap_s")


@query("count_summary", ctes("slides", "leaves", "auto_gap", body=_COUNTS + "SELECT count(*) AS evaluated, (SELECT count(*) FROM call WHERE reason IS NOT NULL) AS skipped, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median" for c in ("n_slides", "n_segments", "diff", "abs_diff", "ratio", "max_gap_s")) + """,
  count_if(ratio < 0.8)::BIGINT AS ratio_lt_0_8, round(count_if(ratio < 0.8) * 100.0 / count(*), 6)::DOUBLE AS ratio_lt_0_8_pct,
  count_if(ratio BETWEEN 0.8 AND 1.2)::BIGINT AS ratio_0_8_to_1_2, round(count_if(ratio BETWEEN 0.8 AND 1.2) * 100.0 / count(*), 6)::DOUBLE AS ratio_0_8_to_1_2_pct,
  count_if(ratio > 1.2)::BIGINT AS ratio_gt_1_2, round(count_if(ratio > 1.2) * 100.0 / count(*), 6)::DOUBLE AS ratio_gt_1_2_pct FROM c"""))
def _(t: Tables):
    s = rp.count_summary(_counts(t))
    return _rounded(s, *[c for c in s.columns if c.endswith(("_mean", "_median", "_pct"))])


@query("first_seen_keys", ctes("ev", body="SELECT lecture_key, min(ord) AS first_at FROM ev GROUP BY 1"))
def _(t: Tables):
    return rp.first_seen(t.events, "lecture_key", "ord")


@query("first_groups", ctes("ev", body="""SELECT e.ord, e.lecture_key, f.group_no FROM ev e JOIN (SELECT lecture_key, row_number() OVER (ORDER BY min(ord)) AS group_no FROM ev GROUP BY 1) f
  USING (lecture_key) WHERE f.group_no <= 10"""))
def _(t: Tables):
    return rp.first_groups(t.events.select("ord", "lecture_key"), "lecture_key", "ord", 10).withColumn("group_no", F.col("group_no").cast("long"))


@query("speaker_stats", ctes("turns", body="SELECT speaker, count(*) AS n, round(avg(length(text)), 6) AS avg_chars FROM turns GROUP BY 1"))
def _(t: Tables):
    return _rounded(rp.speaker_stats(t.turns), "avg_chars")


@query("segment_size_stats", ctes("leaves", body="""SELECT lecture_key, count(*) AS n, round(avg(hi - lo + 1), 6) AS avg_size, min(hi - lo + 1) AS min_size, max(hi - lo + 1) AS max_size FROM leaves GROUP BY 1"""))
def _(t: Tables):
    return _rounded(rp.size_stats(t.nodes), "avg_size")


@query("first_examples", ctes("ev", body="""SELECT ord, event_type, n FROM (SELECT ord, event_type, row_number() OVER (ORDER BY ord) - 1 AS n FROM ev WHERE value > 40) WHERE n < 100"""))
def _(t: Tables):
    # The limit is taken over valid rows in file order.
    valid = t.events.where("value > 40").select("ord", "event_type").orderBy("ord").limit(100)
    return ordered_scan(valid, [], "ord", number="n")
