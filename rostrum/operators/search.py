"""Nearest-neighbour retrieval, evidence expansion, reranking, overlap removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import jaccard, rerank_text, rerank_text_node, word_tokens
from rostrum.functions.times import plain_number
from rostrum.functions.vectors import dot, neg_squared_l2
from rostrum.operators.knn import nearest
from rostrum.plans.ordered import deal
from rostrum.session import materialize

# Sizes of the two retrieval stages and of the evidence list.
FIRST_STAGE = 50
FINAL_HITS = 5
TOP_LEAVES = 3
# Hits that are sent to the records: at most so many rows of keys and scores (some 10 MB).
SENT_ROWS = 1 << 17
# Queries whose evidence (some hits a query, their best leaves) is sent to the records: at most so many.
SENT_QUERIES = 1 << 10

HIT_KEY = ["query_id"]


def top_ranked(scored: DataFrame, keys: list[str], score: str, tie: list[str], k: int | None, out: str = "rank") -> DataFrame:
    """Rank rows by score within keys, best first, and keep ``k``.

    The limit on the rank also prunes each input partition before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *tie))
    ranked = scored.withColumn(out, rank)
    return ranked if k is None else ranked.where(F.col(out) <= k)


def knn_search(
    queries: DataFrame, records: DataFrame, *, top_k: int, scope: str = "lecture", normalized: bool = True
) -> DataFrame:
    """Exact nearest records per query, within the query's lecture or over all lectures.

    Queries ``query_id, lecture_key, embedding``; records ``lecture_key, rec_id,
    embedding``. The score is the inner product, or the negative squared distance if
    vectors are not normalised; higher is better, ties go to the lower ``rec_id``.
    """
    return nearest(queries, records, top_k, scope == "lecture", normalized)


def _brought(few: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A short table joined to the rows that it names. It is stored and, up to ``SENT_ROWS``, sent to them; other rows stay where they are."""
    few = materialize(few)
    return (F.broadcast(few) if few.count() <= SENT_ROWS else few).join(rows, keys)


def with_payload(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits with all record columns but the vector."""
    return _brought(hits, records.drop("embedding"), ["lecture_key", "rec_id"])


def expand_supporting_leaves(
    hits: DataFrame, records: DataFrame, queries: DataFrame, *, top: int = TOP_LEAVES, normalized: bool = True
) -> DataFrame:
    """Give inner-node hits their best descendant leaves as evidence; leaves get none.

    The leaves under a node are those that start within its range. A leaf is scored once a query, and only the
    places of leaves are ranked; texts are joined to the few that are kept.
    """
    inner = hits.where((F.col("index_kind") == "summary_tree") & ~F.col("is_leaf"))
    nodes = inner.groupBy("query_id", "lecture_key").agg(F.collect_list(F.struct(
        F.col("tree_path").alias("node"), F.col("utterance_start").alias("lo"), F.col("utterance_end").alias("hi"))).alias("_nodes"))
    asked = nodes.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
    # A query has no more hits than its first stage has.
    few = queries.limit(SENT_QUERIES + 1).count() <= SENT_QUERIES
    sent = F.broadcast if few else lambda df: df
    leaf = records.where("is_leaf")
    places = leaf.select("lecture_key", "tree_path", F.col("utterance_start").alias("_at"), "embedding")
    score = dot("_q", "embedding") if normalized else neg_squared_l2("_q", "embedding")
    got = sent(asked).join(places, "lecture_key").where(F.exists("_nodes", lambda n: F.col("_at").between(n["lo"], n["hi"])))
    got = got.select("query_id", "lecture_key", "tree_path", F.round(score, 9).alias("score"), F.transform(F.filter(
        "_nodes", lambda n: F.col("_at").between(n["lo"], n["hi"])), lambda n: n["node"]).alias("node"))
    got = got.withColumn("node", F.explode("node"))
    best = top_ranked(got, ["query_id", "lecture_key", "node"], "score", ["tree_path"], top, "support_rank")
    best = sent(best).join(leaf.select("lecture_key", "tree_path", "segment_id", "text", "start", "end"), ["lecture_key", "tree_path"])
    packed = best.groupBy("query_id", "lecture_key", F.col("node").alias("tree_path")).agg(
        F.array_sort(F.collect_list(F.struct(
            "support_rank", F.col("tree_path").alias("tree_path"), "segment_id", "text", "start", "end", "score"))).alias("supporting_leaves"))
    return hits.join(packed, ["query_id", "lecture_key", "tree_path"], "left").withColumn(
        "supporting_leaves", F.coalesce("supporting_leaves", packed_empty()))


def packed_empty() -> Column:
    return F.array().cast("array<struct<support_rank:int,tree_path:string,segment_id:bigint,text:string,"
                           "start:double,end:double,score:double>>")


def default_rerank_score(question: Column, text: Column) -> Column:
    """Deterministic stand-in for a scoring model: share of common words."""
    return jaccard(F.array_distinct(word_tokens(question)), F.array_distinct(word_tokens(text)))


def rerank(
    hits: DataFrame, *, score: Callable[[Column, Column], Column] = default_rerank_score,
    text: Callable[[], Column] | None = None, top_n: int | None = None, question: str = "question",
) -> DataFrame:
    """Score every hit against its question and sort again; equal scores keep their order."""
    body = rerank_text("text") if text is None else text()
    rescored = deal(hits, "query_id", "rank").withColumn("rerank_score", score(F.col(question), body))
    return top_ranked(rescored, HIT_KEY, "rerank_score", ["rank"], top_n, "new_rank").drop("rank").withColumnRenamed("new_rank", "rank")


def node_rerank_text() -> Column:
    """Reranker text of tree hits with their evidence."""
    return rerank_text_node(F.col("is_leaf"), F.col("text"), F.col("summary_text"), F.col("supporting_leaves"))


def tree_overlap(a: Column, b: Column, lists: bool = True) -> Column:
    """Two tree hits cover common ground: one path continues the other, or (with ``lists`` of leaves) they share a leaf."""
    pa, pb = a["tree_path"], b["tree_path"]
    paths = (pa != "") & (pb != "") & (pa.startswith(pb) | pb.startswith(pa))
    if not lists:
        return (a["lecture_key"] == b["lecture_key"]) & F.coalesce(paths, F.lit(False))
    shared = F.arrays_overlap(a["descendant_leaf_tree_paths"], b["descendant_leaf_tree_paths"])
    return (a["lecture_key"] == b["lecture_key"]) & (F.coalesce(paths, F.lit(False)) | F.coalesce(shared, F.lit(False)))


def drop_overlapping_hits(hits: DataFrame, *, id_col: str = "tree_path") -> DataFrame:
    """In rank order, drop tree hits that overlap a kept one; ranks are closed up.

    A query holds at most its first-stage hits, so the fold over one query is short.
    """
    lists = [c for c in ("descendant_leaf_tree_paths",) if c in hits.columns]
    row = F.struct(F.col("rank"), F.col("lecture_key"), F.col("tree_path"), *lists,
                   (F.col("index_kind") == "summary_tree").alias("is_tree"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(kept: Column, hit: Column) -> Column:
        clash = F.exists(kept, lambda k: k["is_tree"] & tree_overlap(k, hit, bool(lists)))
        return F.when(hit["is_tree"] & clash, kept).otherwise(F.concat(kept, F.array(hit)))

    kept = listed.select("query_id", F.explode(F.aggregate("rows", F.slice("rows", 1, 0), step)).alias("k"))
    kept = kept.select("query_id", F.col("k.rank").alias("rank"))
    out = hits.join(kept, ["query_id", "rank"])
    new = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return out.withColumn("_n", new).drop("rank").withColumnRenamed("_n", "rank")


def overlap_pairs(hits: DataFrame) -> DataFrame:
    """Overlapping pairs among the few ranked hits of each query."""
    lists = [c for c in ("descendant_leaf_tree_paths",) if c in hits.columns]
    side = F.struct("rank", "lecture_key", "tree_path", *lists)
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(side)).alias("rows"))
    first = listed.select("query_id", "rows", F.explode("rows").alias("a"))
    later = first.withColumn("b", F.explode(F.filter("rows", lambda x: x["rank"] > F.col("a.rank"))))
    return later.select("query_id", F.col("a.rank").alias("rank_a"), F.col("b.rank").alias("rank_b"),
                        tree_overlap(F.col("a"), F.col("b"), bool(lists)).alias("overlaps"))


def two_stage_search(
    queries: DataFrame, records: DataFrame, *, top_k: int = FIRST_STAGE, top_n: int = FINAL_HITS,
    score: Callable[[Column, Column], Column] = default_rerank_score, tree: bool = False, cut_before_dedup: bool = False,
) -> DataFrame:
    """Nearest records, then rerank, then cut; tree hits are expanded and freed of overlaps.

    ``cut_before_dedup`` cuts to ``top_n`` ahead of overlap removal, so fewer may remain.
    """
    hits = with_payload(knn_search(queries, records, top_k=top_k), records)
    hits = hits.join(queries.select("query_id", "question"), "query_id")
    if not tree:
        return rerank(hits, score=score, top_n=top_n)
    hits = expand_supporting_leaves(hits, records, queries)
    # Stored: the overlaps are found among the hits and then joined to them, and a hit is scored once.
    hits = materialize(rerank(hits, score=score, text=node_rerank_text, top_n=top_n if cut_before_dedup else None))
    return drop_overlapping_hits(hits).where(F.col("rank") <= top_n)


def search_by_modality(queries: DataFrame, indexes: dict[str, DataFrame], *, top_k: int) -> DataFrame:
    """Search several indexes on their own and stack the hits; a lecture missing in one yields none there."""
    out = None
    for name, records in indexes.items():
        hits = knn_search(queries, records, top_k=top_k).withColumn("modality", F.lit(name))
        out = hits if out is None else out.unionByName(hits)
    return out


def global_index(*parts: DataFrame) -> DataFrame:
    """All lectures' records in one table; searching it is searching everything."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def document_id(lecture_key: str | Column = "lecture_key") -> Column:
    """Stable id of a hit: by tree path, else segment, else slide, else time span."""
    key = F.col(lecture_key) if isinstance(lecture_key, str) else lecture_key
    part = lambda kind, x: F.concat(key, F.lit(f"::{kind}::"), x.cast("string"))
    path = F.when(F.col("tree_path") != "", F.col("tree_path"))
    return F.coalesce(
        part("tree", path), part("seg", F.col("segment_id")), part("slide", F.col("slide_index")),
        F.concat(part("span", plain_number("start")), F.lit("::"), plain_number("end")))
