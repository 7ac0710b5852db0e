"""Queries over timed words, slides and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as tx
from rostrum.operators import chunks as ch
from rostrum.operators import slides as sl
from rostrum.operators import words as wd
from rostrum.plans.fixtures import DAY, TOKENS_RE, Tables, r3
from rostrum.plans.ordered import ordered_scan
from rostrum.plans.registry import ctes, query

KEY = ["lecture_key"]

_CLEAN = """SELECT lecture_key, ord, word, start, {end} AS "end" FROM (SELECT lecture_key, ord, trim("Word") AS word,
  coalesce(try_cast("Start" AS DOUBLE), 0.0) AS start,
  coalesce(try_cast("End" AS DOUBLE), coalesce(try_cast("Start" AS DOUBLE), 0.0)) AS e FROM raw_words) WHERE word <> ''"""


@query("clean_timed_words", ctes("raw_words", body=_CLEAN.format(end="greatest(e, start)")))
def _(t: Tables):
    return wd.clean_timed_words(t.raw_words)


@query("clean_timed_words_unclamped", ctes("raw_words", body=_CLEAN.format(end="e")))
def _(t: Tables):
    return wd.clean_timed_words(t.raw_words, clamp_end=False)


@query("word_gaps", ctes("gaps", body="SELECT lecture_key, ord, round(gap, 6) AS gap, "
                         "round(greatest(gap, 0.0), 6) AS clamped FROM gaps WHERE gap IS NOT NULL"))
def _(t: Tables):
    g = wd.word_gaps(t.words).where(F.col("gap").isNotNull())
    return g.select("lecture_key", "ord", F.round("gap", 6).alias("gap"),
                    F.round(F.greatest("gap", F.lit(0.0)), 6).alias("clamped"))


@query("estimated_max_gap", ctes("auto_gap", body="SELECT lecture_key, round(max_gap_s, 6) AS max_gap_s FROM auto_gap"))
def _(t: Tables):
    return wd.estimate_max_gap(t.words).select("lecture_key", F.round("max_gap_s", 6).alias("max_gap_s"))


@query("resolved_max_gap", ctes("auto_gap", body="""SELECT 'auto' AS mode, lecture_key, round(max_gap_s, 6) AS max_gap_s
  FROM auto_gap UNION ALL SELECT DISTINCT '10800', lecture_key, 10800.0::DOUBLE FROM auto_gap"""))
def _(t: Tables):
    auto = wd.resolve_max_gap(t.words, "auto").withColumn("mode", F.lit("auto"))
    fixed = wd.resolve_max_gap(t.words, "10800").withColumn("mode", F.lit("10800"))
    return auto.unionByName(fixed).select("mode", "lecture_key", F.round("max_gap_s", 6).alias("max_gap_s"))


@query("gap_sessions", ctes("sess", body="SELECT lecture_key, ord, CAST(idx AS BIGINT) AS idx FROM sess"))
def _(t: Tables):
    return wd.gap_sessions(t.words, wd.resolve_max_gap(t.words)).select("lecture_key", "ord", "idx")


@query("utterances", ctes("utts", body="SELECT * FROM utts"))
def _(t: Tables):
    return t.utts


@query("utterances_fixed_gap", ctes("paused", body="SELECT * FROM paused"))
def _(t: Tables):
    return t.paused.drop("duration", "max_gap_s")


@query("gap_histogram", ctes("gaps", body="""
, g AS (SELECT gap FROM gaps WHERE gap > 0),
f AS (SELECT count(*) AS n, min(gap) AS lo, max(gap) AS hi, quantile_cont(gap, 0.25) AS q1, quantile_cont(gap, 0.75) AS q3,
  avg(CASE WHEN gap <= 0.5 THEN 1.0 ELSE 0 END) * 100 AS pct_le_0_5, avg(CASE WHEN gap <= 0.8 THEN 1.0 ELSE 0 END) * 100 AS pct_le_0_8,
  avg(CASE WHEN gap <= 1.0 THEN 1.0 ELSE 0 END) * 100 AS pct_le_1_0, avg(CASE WHEN gap <= 1.5 THEN 1.0 ELSE 0 END) * 100 AS pct_le_1_5,
  avg(CASE WHEN gap <= 2.0 THEN 1.0 ELSE 0 END) * 100 AS pct_le_2_0 FROM g),
b AS (SELECT *, greatest(ceil((hi - lo) / (2 * (q3 - q1) / cbrt(n))), 1) AS bins FROM f)
SELECT CAST(least(floor((gap - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, CAST(bins AS BIGINT) AS bins, n,
  round(pct_le_0_5, 6) AS pct_le_0_5, round(pct_le_0_8, 6) AS pct_le_0_8, round(pct_le_1_0, 6) AS pct_le_1_0,
  round(pct_le_1_5, 6) AS pct_le_1_5, round(pct_le_2_0, 6) AS pct_le_2_0, count(*) AS bin_count
FROM g, b GROUP BY ALL"""))
def _(t: Tables):
    d = wd.gap_distribution(t.words)
    return d.select(*[F.round(c, 6).alias(c) if c.startswith("pct") else F.col(c).cast("long").alias(c) for c in d.columns])


# --- slides -------------------------------------------------------------------------


@query("slide_midpoints", ctes("spans", body=f"""SELECT lecture_key, slide_index, round(start, 6) AS start,
  {r3('(start + "end") / 2', 7)} AS midpoint FROM spans"""))
def _(t: Tables):
    return sl.slide_midpoints(t.slides).select(
        "lecture_key", "slide_index", F.round("start", 6).alias("start"), F.round("midpoint", 7).alias("midpoint"))


def _attach_sql(pivot: str) -> str:
    return ctes("paused", "spans", body=f"""SELECT u.lecture_key, u.idx, s.slide_index, {r3('s.start')} AS slide_start,
  {r3('s."end"')} AS slide_end FROM (SELECT *, {pivot} AS p FROM paused) u
  LEFT JOIN (SELECT *, CASE WHEN slide_index = 0 THEN -1e18 ELSE start END AS lo FROM spans) s
  ON u.lecture_key = s.lecture_key AND s.lo < u.p AND u.p <= s."end" """)


for _mode, _pivot in (("midpoint", '(start + "end") / 2'), ("start", "start"), ("end", '"end"')):
    @query(f"attach_slides_by_{_mode}", _attach_sql(_pivot))
    def _(t: Tables, mode=_mode):
        return sl.attach_slides(t.paused, t.slides, mode=mode, block_seconds=DAY).select(
            "lecture_key", "idx", "slide_index", "slide_start", "slide_end")


def _given_sql(cond: str) -> str:
    return ctes("attached", body=f"""SELECT a.lecture_key, a.idx, a.slide_index,
  CASE WHEN {cond} THEN s.ocr_text END AS ocr_text FROM (SELECT *,
  row_number() OVER (PARTITION BY lecture_key, slide_index ORDER BY idx) AS r FROM attached) a
  LEFT JOIN slides s ON a.lecture_key = s.lecture_key AND a.slide_index = s.slide_index""")


for _name, _limit, _cond in (("first_two", 2, "r <= 2"), ("all", None, "true"), ("none", 0, "false")):
    @query(f"attach_slide_text_{_name}", _given_sql(_cond))
    def _(t: Tables, limit=_limit):
        placed = sl.attach_slides(t.paused, t.slides, block_seconds=DAY)
        return sl.attach_slide_text(placed, t.slides, per_slide=limit).select(
            "lecture_key", "idx", "slide_index", "ocr_text")


@query("slide_entries", ctes("slide_rows", body="SELECT * FROM slide_rows"))
def _(t: Tables):
    return t.slide_rows


_OCR = """WITH l AS (SELECT doc_id AS slide_index, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS line_num FROM documents),
tk AS (SELECT slide_index, line_num, unnest(string_split(line, ' ')) AS text, unnest(range(len(string_split(line, ' ')))) AS word_num FROM l),
c AS (SELECT *, CASE WHEN length(text) = 3 THEN NULL ELSE 50 + ('0x' || substr(md5(text), 1, 6))::bigint % 50 END AS conf FROM tk),
k AS (SELECT * FROM c WHERE trim(text) <> '' AND (conf IS NULL OR conf >= 60))"""


@query("filter_ocr_tokens", _OCR + " SELECT slide_index, line_num, word_num, text FROM k")
def _(t: Tables):
    return sl.filter_ocr_tokens(t.ocr_tokens, min_conf=60).select(
        "slide_index", F.col("line_num").cast("long").alias("line_num"), F.col("word_num").cast("long").alias("word_num"), "text")


@query("ocr_slide_texts", _OCR + """, ln AS (SELECT slide_index, line_num, string_agg(regexp_replace(trim(text), '@WS@+', ' ', 'g'), ' '
  ORDER BY word_num) AS line FROM k GROUP BY 1, 2)
SELECT slide_index, md5(string_agg(line, chr(10) ORDER BY line_num)) AS text_md5,
  length(string_agg(line, chr(10) ORDER BY line_num)) AS n_chars FROM ln GROUP BY 1""")
def _(t: Tables):
    texts = sl.ocr_slide_texts(t.ocr_tokens, min_conf=60)
    return texts.select("slide_index", F.md5("ocr_text").alias("text_md5"), F.length("ocr_text").cast("long").alias("n_chars"))


@query("overlapping_slides", ctes("paused", "slide_rows", body="""SELECT u.lecture_key, u.idx AS chunk_id,
  coalesce(string_agg(CAST(s.slide_index AS VARCHAR), ',' ORDER BY s.slide_index), '') AS slide_list,
  coalesce(string_agg(s.text, chr(10) ORDER BY s.slide_index), '') AS ocr_text
FROM paused u LEFT JOIN slide_rows s ON u.lecture_key = s.lecture_key AND s.start <= u."end" AND s."end" >= u.start
GROUP BY 1, 2"""))
def _(t: Tables):
    chunks = t.paused.select("lecture_key", F.col("idx").alias("chunk_id"), "start", "end")
    got = sl.overlapping_slides(chunks, t.slide_rows, bucket_seconds=DAY)
    return got.select("lecture_key", "chunk_id", "ocr_text",
                      F.array_join(F.col("ocr_slide_indices").cast("array<string>"), ",").alias("slide_list"))


@query("reference_boundaries", ctes("paused", "spans", body="""
, m AS (SELECT lecture_key, max("end") AS last_end, max(slide_index) AS last_i FROM spans GROUP BY 1),
a AS (SELECT u.lecture_key, u.idx, coalesce(s.slide_index, m.last_i) AS slide_index FROM paused u
  LEFT JOIN (SELECT *, CASE WHEN slide_index = 0 THEN -1e18 ELSE start END AS lo FROM spans) s
  ON u.lecture_key = s.lecture_key AND s.lo < u.start AND u.start <= s."end" LEFT JOIN m ON u.lecture_key = m.lecture_key)
SELECT lecture_key, idx, slide_index, CASE WHEN lead(slide_index) OVER (PARTITION BY lecture_key ORDER BY idx) <> slide_index
  THEN 1 ELSE 0 END AS flag FROM a"""))
def _(t: Tables):
    return sl.reference_boundaries(t.paused, t.slides, block_seconds=DAY).select("lecture_key", "idx", "slide_index", "flag")


# Noisy end times: every view counts, its end pulled back by its value times 600 seconds.
NOISY = """, noisy AS (SELECT lecture_key, row_number() OVER (PARTITION BY lecture_key ORDER BY ord) - 1 AS slide_index,
  start - value * 600 AS "end" FROM ev WHERE event_type = 'view')"""


def noisy_ends(t: Tables):
    v = t.events.where(F.col("event_type") == "view")
    return ordered_scan(v, KEY, "ord", number="slide_index").select(
        "lecture_key", "slide_index", (F.col("start") - F.col("value") * 600).alias("end"))


# Every step compares with the last kept end, not with the highest so far.
KEPT_ENDS = """, f AS (SELECT lecture_key, slide_index, "end" > 0 AS ok, CASE WHEN "end" > 0 THEN "end" ELSE -1.0 END AS last FROM noisy WHERE slide_index = 0
  UNION ALL SELECT n.lecture_key, n.slide_index, n."end" > 0 AND n."end" > f.last + 1e-6,
  CASE WHEN n."end" > 0 AND n."end" > f.last + 1e-6 THEN n."end" ELSE f.last END
  FROM f JOIN noisy n ON n.lecture_key = f.lecture_key AND n.slide_index = f.slide_index + 1),
kept AS (SELECT lecture_key, row_number() OVER (PARTITION BY lecture_key ORDER BY slide_index) - 1 AS slide_index, last AS "end" FROM f WHERE ok)"""


@query("normalize_ends", ctes("ev", body=NOISY + KEPT_ENDS + """ SELECT lecture_key, slide_index, round("end", 6) AS "end" FROM kept"""))
def _(t: Tables):
    return sl.normalize_ends(noisy_ends(t)).withColumn("end", F.round("end", 6))


# A 64-bit hash per slide out of its text: one digit of a digest thirteen times over, so that near copies
# occur and the sign bit is used, and three more digits that put near copies on both sides of the limit.
_HASHED = """, h AS (SELECT lecture_key, slide_index, "end", ('0x' || repeat(substr(md5(ocr_text), 1, 1), 13) || substr(md5(ocr_text), 2, 3))::ubigint AS hash
  FROM slides)"""


@query("dedupe_slides", ctes("slides", body="").rstrip() + _HASHED + """,
f AS (SELECT lecture_key, slide_index, hash AS last, slide_index AS first FROM h WHERE slide_index = 0
  UNION ALL SELECT h.lecture_key, h.slide_index, CASE WHEN bit_count(xor(h.hash, f.last)) > 6 THEN h.hash ELSE f.last END,
  CASE WHEN bit_count(xor(h.hash, f.last)) > 6 THEN h.slide_index ELSE f.first END
  FROM f JOIN h ON h.lecture_key = f.lecture_key AND h.slide_index = f.slide_index + 1)
SELECT lecture_key, row_number() OVER (PARTITION BY lecture_key ORDER BY first) - 1 AS slide_index, first AS first_source,
  count(*) AS n_merged, round(max("end"), 6) AS "end" FROM f JOIN h USING (lecture_key, slide_index) GROUP BY lecture_key, first""")
def _(t: Tables):
    digest = F.md5("ocr_text")
    h = F.conv(F.concat(F.repeat(F.substring(digest, 1, 1), 13), F.substring(digest, 2, 3)), 16, -10).cast("long")
    got = sl.dedupe_slides(t.slides.withColumn("hash", h))
    return got.withColumn("end", F.round("end", 6))


_TERMS = """, d AS (SELECT source AS lecture_key, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS slide_index,
  count(*) OVER (PARTITION BY source) AS n, (doc_id * 40.0)::DOUBLE AS "end",
  list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 2)) AS terms FROM documents)"""


@query("filter_by_text_change", "WITH RECURSIVE z AS (SELECT 1 AS one)" + _TERMS + """,
f AS (SELECT lecture_key, slide_index, true AS ok, terms AS kept, "end" AS last FROM d WHERE slide_index = 0
  UNION ALL SELECT lecture_key, slide_index, ok, CASE WHEN ok THEN terms ELSE kept END, CASE WHEN ok THEN "end" ELSE last END FROM (
    SELECT d.lecture_key, d.slide_index, d.terms, d."end", f.kept, f.last, d.slide_index = d.n - 1 OR d."end" - f.last >= 900
      OR NOT (len(f.kept) >= 6 AND len(d.terms) >= 6 AND len(list_intersect(f.kept, d.terms))::DOUBLE
        / greatest(len(list_distinct(list_concat(f.kept, d.terms))), 1) >= 0.2) AS ok
    FROM f JOIN d ON d.lecture_key = f.lecture_key AND d.slide_index = f.slide_index + 1))
SELECT lecture_key, slide_index, "end" FROM f JOIN d USING (lecture_key, slide_index) WHERE ok""")
def _(t: Tables):
    d = t.documents.select(F.col("source").alias("lecture_key"), "doc_id", (F.col("doc_id") * 40.0).alias("end"),
                           tx.ocr_terms("text").alias("terms"))
    numbered = ordered_scan(d, KEY, "doc_id", number="slide_index")
    return sl.filter_by_text_change(numbered, similarity=0.2)


# --- chunks -------------------------------------------------------------------------


@query("config_grid", """SELECT s AS chunk_strategy, z::BIGINT AS chunk_size_tokens, p::BIGINT AS overlap_percent, m AS ocr_mode,
  round_even(z * (p / 100.0), 0)::BIGINT AS overlap_tokens, m = 'combined_ocr' AS attach_ocr,
  'baseline__' || s || '__' || z || 'tok__ov' || p || '__' || m AS system, (SELECT count(*) FROM documents) AS n_documents
FROM (SELECT unnest(['utterance_packed', 'raw_token_window']) AS s), (SELECT unnest([128, 256, 512]) AS z),
  (SELECT unnest([0, 10]) AS p), (SELECT unnest(['transcript_only', 'combined_ocr']) AS m)""")
def _(t: Tables):
    # Counted so that the grid is laid over the corpus it will be run on.
    n = t.documents.agg(F.count(F.lit(1)).alias("n_documents")).withColumn("_one", F.lit(1))
    return ch.config_grid(t.spark).withColumn("_one", F.lit(1)).join(n, "_one").drop("_one")


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS lecture_key, unnest(regexp_split_to_array(text, '[ \\n]')) AS word,
  unnest(range(len(regexp_split_to_array(text, '[ \\n]')))) AS ord FROM documents),
k AS (SELECT lecture_key, ord, regexp_extract_all(lower(word), '{TOKENS_RE}') AS toks FROM w),
k2 AS (SELECT *, row_number() OVER (PARTITION BY lecture_key ORDER BY ord) - 1 AS wi FROM k WHERE len(toks) > 0),
e AS (SELECT lecture_key, ord, wi, unnest(toks) AS tok, unnest(range(len(toks))) AS j FROM k2),
p AS (SELECT *, row_number() OVER (PARTITION BY lecture_key ORDER BY wi, j) - 1 AS pos, count(*) OVER (PARTITION BY lecture_key) AS n FROM e),
q AS (SELECT *, unnest(range(greatest(ceil((pos - {size} + 1) / {step}.0), 0)::BIGINT,
  least(pos // {step}, greatest(ceil((n - {size}) / {step}.0), 0)::BIGINT) + 1)) AS win FROM p)
SELECT lecture_key, win + 1 AS chunk_id, count(*) AS token_count, min(wi) AS source_item_start, max(wi) AS source_item_end,
  min(ord)::DOUBLE AS start, (max(ord) + 1)::DOUBLE AS "end", md5(string_agg(tok, ' ' ORDER BY pos)) AS text_md5
FROM q GROUP BY 1, 2"""


@query("token_windows_128_no_overlap", _windows_sql(128, 128))
def _(t: Tables):
    return ch.token_windows(t.doc_words, size=128).withColumn("text_md5", F.md5("text")).drop("text", "ocr_slide_indices")


@query("token_windows_256_overlap_26", _windows_sql(256, 230))
def _(t: Tables):
    w = ch.token_windows(t.doc_words, size=256, overlap=26)
    return w.withColumn("text_md5", F.md5("text")).drop("text", "ocr_slide_indices")


@query("token_windows_with_slides", ctes("words", "slide_rows", body="""
, p AS (SELECT *, row_number() OVER (PARTITION BY lecture_key ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY lecture_key) AS n FROM words),
q AS (SELECT *, unnest(range(greatest(ceil((pos - 15) / 14.0), 0)::BIGINT, least(pos // 14, greatest(ceil((n - 16) / 14.0), 0)::BIGINT) + 1)) AS win FROM p),
c AS (SELECT lecture_key, win + 1 AS chunk_id, arg_min(start, pos) AS s, arg_max("end", pos) AS e, string_agg(word, ' ' ORDER BY pos) AS spoken
  FROM q GROUP BY 1, 2)
SELECT c.lecture_key, chunk_id, spoken || coalesce(chr(10) || string_agg('[SLIDE] ' || r.text, chr(10) ORDER BY r.slide_index), '') AS text,
  coalesce(string_agg(r.slide_index::VARCHAR, ',' ORDER BY r.slide_index), '') AS slide_list
FROM c LEFT JOIN slide_rows r ON r.lecture_key = c.lecture_key AND r.start <= c.e AND r."end" >= c.s GROUP BY c.lecture_key, chunk_id, spoken"""))
def _(t: Tables):
    w = ch.token_windows(t.words, size=16, overlap=2, slides=t.slide_rows, bucket_seconds=DAY)
    return w.select("lecture_key", "chunk_id", "text",
                    F.array_join(F.col("ocr_slide_indices").cast("array<string>"), ",").alias("slide_list"))


def _pack_sql(size: int, overlap: int) -> str:
    back = "b.t" if overlap else "p.stop"
    return ctes("units", body="").rstrip() + f""",
k AS (SELECT lecture_key, idx, regexp_extract_all(text, '{TOKENS_RE}') AS toks, regexp_replace(trim(text), '@WS@+', ' ', 'g') AS text FROM units),
pc AS (SELECT lecture_key, idx, len(toks) AS n, unnest(range(ceil(len(toks) / {size}.0)::BIGINT)) AS j, toks, text FROM k WHERE len(toks) > 0),
u AS (SELECT lecture_key, idx, row_number() OVER (PARTITION BY lecture_key ORDER BY idx, j) - 1 AS t,
  CASE WHEN n > {size} THEN list_aggregate(toks[j * {size} + 1 : j * {size} + {size}], 'string_agg', ' ') ELSE text END AS text,
  least({size}, n - j * {size}) AS c FROM pc),
s AS (SELECT lecture_key, t, c FROM u UNION ALL SELECT lecture_key, max(t) + 1, 0 FROM u GROUP BY 1),
x AS (SELECT lecture_key, t, c, (sum(c) OVER (PARTITION BY lecture_key ORDER BY t) - c)::BIGINT AS x, max(t) OVER (PARTITION BY lecture_key) AS n FROM s),
p AS (SELECT *, max(t) OVER (PARTITION BY lecture_key ORDER BY x RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) AS stop,
  max(t) OVER (PARTITION BY lecture_key ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {max(overlap, 1)} PRECEDING) AS back FROM x),
nx AS (SELECT p.lecture_key, p.t, p.n, p.stop, CASE WHEN p.stop >= p.n THEN p.n
  WHEN {overlap} = 0 THEN p.stop ELSE greatest(p.t + 1, coalesce(b.back, 0)) END AS nxt
  FROM p JOIN p b ON b.lecture_key = p.lecture_key AND b.t = p.stop WHERE p.t < p.n),
f AS (SELECT lecture_key, t, stop, nxt, 1::BIGINT AS chunk_id FROM nx WHERE t = 0
  UNION ALL SELECT nx.lecture_key, nx.t, nx.stop, nx.nxt, f.chunk_id + 1 FROM f JOIN nx ON nx.lecture_key = f.lecture_key AND nx.t = f.nxt)
SELECT f.lecture_key, chunk_id, sum(c)::BIGINT AS token_count, min(idx) AS source_item_start, max(idx) AS source_item_end,
  md5(string_agg(text, chr(10) ORDER BY u.t)) AS text_md5
FROM f JOIN u ON u.lecture_key = f.lecture_key AND u.t >= f.t AND u.t < f.stop GROUP BY 1, 2"""


for _size, _over in ((128, 0), (128, 13), (512, 51)):
    @query(f"packed_units_{_size}_overlap_{_over}", _pack_sql(_size, _over))
    def _(t: Tables, size=_size, over=_over):
        units = t.units.withColumn("text", tx.clean_text("text"))
        got = ch.pack_units(units, size=size, overlap=over)
        return got.select("lecture_key", "chunk_id", "token_count", "source_item_start", "source_item_end",
                          F.md5("text").alias("text_md5"))


# --- the chunk grid over the lectures of users ---

_GRID = {"sizes": (8, 24), "overlaps": (0, 25)}


def _grid_pack_sql(n: int, system: str, size: int, overlap: int, ocr: bool) -> tuple[str, str]:
    """Parts of a recursive WITH query, and the chunks of one packing: system, lecture, tokens, characters, slides."""
    text = "CASE WHEN ocr_text IS NULL THEN text ELSE text || chr(10) || '[SLIDE] ' || ocr_text END" if ocr else "text"
    slide = "(ocr_text IS NOT NULL)::INT" if ocr else "0"
    parts = f"""k{n} AS (SELECT lecture_key, idx, {text} AS text, regexp_extract_all({text}, '{TOKENS_RE}') AS toks, {slide} AS shows FROM shown),
u{n} AS (SELECT lecture_key, row_number() OVER (PARTITION BY lecture_key ORDER BY idx, j) - 1 AS t, shows, idx,
  CASE WHEN len(toks) > {size} THEN list_aggregate(toks[j * {size} + 1 : j * {size} + {size}], 'string_agg', ' ') ELSE text END AS text, least({size}, len(toks) - j * {size}) AS c
  FROM (SELECT *, unnest(range(ceil(len(toks) / {size}.0)::BIGINT)) AS j FROM k{n})),
x{n} AS (SELECT lecture_key, t, c, (sum(c) OVER (PARTITION BY lecture_key ORDER BY t) - c)::BIGINT AS x, max(t) OVER (PARTITION BY lecture_key) AS n
  FROM (SELECT lecture_key, t, c FROM u{n} UNION ALL SELECT lecture_key, max(t) + 1, 0 FROM u{n} GROUP BY 1)),
p{n} AS (SELECT *, max(t) OVER (PARTITION BY lecture_key ORDER BY x RANGE BETWEEN CURRENT ROW AND {size} FOLLOWING) AS stop,
  max(t) OVER (PARTITION BY lecture_key ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND {max(overlap, 1)} PRECEDING) AS back FROM x{n}),
n{n} AS (SELECT p.lecture_key, p.t, p.stop, CASE WHEN p.stop >= p.n THEN p.n WHEN {overlap} = 0 THEN p.stop ELSE greatest(p.t + 1, coalesce(b.back, 0)) END AS nxt
  FROM p{n} p JOIN p{n} b ON b.lecture_key = p.lecture_key AND b.t = p.stop WHERE p.t < p.n),
f{n} AS (SELECT lecture_key, t, stop, nxt FROM n{n} WHERE t = 0
  UNION ALL SELECT x.lecture_key, x.t, x.stop, x.nxt FROM f{n} f JOIN n{n} x ON x.lecture_key = f.lecture_key AND x.t = f.nxt)"""
    chunks = f"""SELECT '{system}' AS system, f.lecture_key, sum(c)::BIGINT AS tokens, length(string_agg(text, chr(10) ORDER BY u.t)) AS chars,
  count(DISTINCT CASE WHEN shows = 1 THEN idx END) AS shows FROM f{n} f JOIN u{n} u ON u.lecture_key = f.lecture_key AND u.t >= f.t AND u.t < f.stop GROUP BY f.lecture_key, f.t"""
    return parts, chunks


def _grid_window_sql(system: str, size: int, overlap: int, ocr: bool) -> str:
    step = max(1, size - overlap)
    spoken = f"""SELECT lecture_key, win, count(*) AS tokens, arg_min(start, pos) AS s, arg_max("end", pos) AS e, string_agg(word, ' ' ORDER BY pos) AS spoken FROM (
  SELECT *, unnest(range(greatest(ceil((pos - {size} + 1) / {step}.0), 0)::BIGINT, least(pos // {step}, greatest(ceil((n - {size}) / {step}.0), 0)::BIGINT) + 1)) AS win FROM wpos)
  GROUP BY 1, 2"""
    if not ocr:
        return f"SELECT '{system}', lecture_key, tokens, length(spoken), 0 FROM ({spoken})"
    return f"""SELECT '{system}', c.lecture_key, any_value(tokens), length(spoken || coalesce(chr(10) || string_agg('[SLIDE] ' || r.text, chr(10) ORDER BY r.slide_index), '')), count(r.slide_index)
  FROM ({spoken}) c LEFT JOIN slide_rows r ON r.lecture_key = c.lecture_key AND r.start <= c.e AND r."end" >= c.s GROUP BY c.lecture_key, win, spoken"""


def _grid_sql() -> str:
    parts, rows = ["""wpos AS (SELECT *, row_number() OVER (PARTITION BY lecture_key ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY lecture_key) AS n FROM words)"""], []
    for size in _GRID["sizes"]:
        for percent in _GRID["overlaps"]:
            for mode in ch.OCR_MODES:
                over, ocr = round(size * percent / 100), mode == "combined_ocr"
                name = "baseline__{}__" + f"{size}tok__ov{percent}__{mode}"
                made, packed = _grid_pack_sql(len(rows), name.format("utterance_packed"), size, over, ocr)
                parts.append(made)
                rows += [packed, _grid_window_sql(name.format("raw_token_window"), size, over, ocr)]
    return ctes("shown", "words", "slide_rows", body=", " + ",\n".join(parts) + ", every AS (" + "\nUNION ALL ".join(rows) + """)
SELECT system, lecture_key, count(*) AS n_chunks, sum(tokens)::BIGINT AS n_tokens, sum(chars)::BIGINT AS n_chars, sum(shows)::BIGINT AS n_slides FROM every GROUP BY 1, 2""")


@query("grid_chunks", _grid_sql())
def _(t: Tables):
    made = ch.grid_chunks(t.words, t.shown, t.slide_rows, **_GRID, bucket_seconds=DAY)
    return made.groupBy("system", "lecture_key").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.sum(F.length("text").cast("long")).alias("n_chars"),
        F.sum(F.size("ocr_slide_indices").cast("long")).alias("n_slides"))
