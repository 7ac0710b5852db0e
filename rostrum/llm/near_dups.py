"""Near duplicates by MinHash with tensored banding.

A text's set of word shingles gives ``COLLECTIONS`` small collections of ``ROWS`` minima
each. A table key combines a pair of collections, so 24 minima make 66 tables of four
minima, where separate tables would take 264. Texts with equal sets are one class. In every bucket each member is checked against the
smallest id there on the full sets. Members that are then still outside the bucket's main
component are joined with the others on their rarest shingles, an exact filter, and checked
too. So no candidate is lost, and a bucket costs rows per member, not per pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import add_columns, as_bytes, register, stored, table
from rostrum.session import materialize

#: At a similarity of exactly 0.8 a pair meets in no table with a chance of 1 in 10,000, at 0.9 of 1 in 10^7.
COLLECTIONS, ROWS = 12, 2
_draw = np.random.default_rng(20240101)
MULTIPLIERS = _draw.integers(1, 2**63, COLLECTIONS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _draw.integers(0, 2**63, COLLECTIONS * ROWS, dtype=np.uint64)
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    seen: dict[bytes, int] = {}
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(size, len(words))
    n = len(h) - k + 1
    key = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        key = (key ^ h[j:j + n]) * ODD
        key ^= key >> np.uint64(32)
    return np.unique(key)


def collections_of(shingles: np.ndarray) -> list[int]:
    """One hash of the minima of every collection."""
    lowest = np.array([((shingles ^ c) * a).min() for a, c in zip(MULTIPLIERS, MASKS)]).reshape(COLLECTIONS, ROWS)
    mixed = np.zeros(COLLECTIONS, dtype=np.uint64)
    for r in range(ROWS):
        mixed = (mixed ^ lowest[:, r]) * ODD
        mixed ^= mixed >> np.uint64(29)
    return mixed.view(np.int64).tolist()


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(text):
        n, same, sketch = [], [], []
        for t in as_bytes(text):
            s = shingle_set(t, size)
            n.append(len(s))
            same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketch.append(collections_of(s) if len(s) else None)
        return [n, same, sketch]

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return add_columns(rows, ["_text"], run, "n long, same binary, sketch array<long>", keep=["doc_id"])


def table_keys() -> Column:
    c = [F.col("sketch")[i] for i in range(COLLECTIONS)]
    return F.explode(F.array(*[F.xxhash64(F.lit(t), c[i], c[j]) for t, (i, j) in enumerate(combinations(range(COLLECTIONS), 2))]))


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per node: columns ``u, v``, for nodes that are not the smallest themselves.

    Alternates large and small stars. Only the edges are kept between rounds, as checkpoints.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e
        mark = now


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    whole = F.size("sa") + F.size("sb") - common
    return pairs.join(a, "a").join(b, "b").where(common.cast("long") * 100 >= whole.cast("long") * percent).select("a", "b")


def may_reach(m: str, n: str, percent: int) -> Column:
    return F.least(m, n) * 100 >= F.greatest(m, n) * percent


def unresolved(buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components from buckets that the check against their hub leaves in several.

    A bucket's members outside its main component would have to be checked against all
    others there. Instead they are joined on the rarest shingles of their sets: sets that reach the
    similarity share one among the first of a common order, at places that leave room for
    the overlap. So members that are near, but not near enough, meet nobody, and none that is is missed.
    """
    placed = (buckets.where((F.col("rep") != F.col("hub")) | (F.col("same") != F.col("hub_same")))
              .join(found.select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left")
              .select("key", "rep", "same", "n", F.coalesce("comp", "rep").alias("comp")))
    mixed = (placed.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key")
             .agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1"))
    members = stored(placed.join(mixed.select("key", "main"), "key").groupBy("rep", "same", "n", "comp")
                     .agg(F.max(F.col("comp") != F.col("main")).alias("stray")))
    sets = sets.select(F.col("doc_id").alias("rep"), "same", "shingles")
    tokens = members.join(sets, ["rep", "same"]).select("rep", "same", "n", "comp", "stray", F.explode("shingles").alias("token"))
    # A shingle of one member only takes up a place in the order, but joins nothing.
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    order = F.sort_array(F.collect_list(F.struct("often", "token")))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    listed = (tokens.join(often, "token").groupBy("rep", "same", "n", "comp", "stray").agg(order.alias("order"))
              .select("rep", "n", "comp", "stray", F.posexplode("order"), (F.col("n") - F.size("order")).alias("alone"))
              .withColumn("place", F.col("alone") + F.col("pos")).where(F.col("place") < prefix)
              .select("rep", "n", "comp", "stray", F.col("col.token").alias("token"), "place"))
    listed = stored(listed)
    x = listed.where("stray").select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("place").alias("pa"))
    y = listed.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("place").alias("pb"))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # of a pair's first common shingle
    fits = room * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
    return (x.join(y, "token").where((F.col("ca") != F.col("cb")) & may_reach("na", "nb", percent) & fits)
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when the intersection of their shingle sets is at least ``percent``
    of the union; ``component_id`` is the smallest id reachable, and its document is kept. Null
    and empty texts are linked with nothing. Rows that repeat an id count as one document; a row
    without id joins its class, and is kept only where the class has no id. Other columns are ignored.
    """
    rows = stored(sketches(docs, id_col, text_col, size))
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("same").agg(F.min("doc_id").alias("rep"))
    # An id with several texts stands for the classes of all of them, with a sketch for each.
    reps = known.join(classes, "same").where("doc_id = rep").select("rep", "same", "n", "sketch").dropDuplicates(["rep", "same"])
    keys = reps.select("rep", "same", "n", table_keys().alias("key"))
    first_of = F.struct("rep", "same", "n")
    hubs = keys.groupBy("key").agg(F.min(first_of).alias("h"), F.count("*").alias("members")).where("members > 1").select(
        "key", F.col("h.rep").alias("hub"), F.col("h.same").alias("hub_same"), F.col("h.n").alias("hub_n"))
    buckets = stored(keys.join(hubs, "key"))

    wanted = stored(buckets.select(F.col("rep").alias("doc_id")).distinct())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).join(wanted, "doc_id", "left_semi")

    def shingles(text):
        found = [shingle_set(x, size) for x in as_bytes(text)]
        return [[x.view(np.int64) for x in found], [xxhash.xxh3_128_digest(x.tobytes()) for x in found]]

    sets = stored(add_columns(texts, ["_text"], shingles, "shingles array<long>, same binary", keep=["doc_id"]))

    first = (buckets.where((F.col("rep") != F.col("hub")) & may_reach("n", "hub_n", percent))
             .select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    # What one id has in several classes is one document.
    several = known.groupBy("doc_id").agg(F.min("same").alias("one"), F.max("same").alias("other")).where("one <> other").select("doc_id")
    held = known.join(several, "doc_id", "left_semi").join(classes, "same").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = stored(alike(first, sets, percent).unionByName(held).distinct())
    found = components(links)

    rest = unresolved(buckets, found, sets, percent)
    late = stored(alike(rest, sets, percent))
    if not late.isEmpty():
        found = components(found.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(late))

    # Texts without words are in no class and stay out of the joins.
    own = rows.where("n > 0").select("doc_id", "n", "same").join(classes, "same", "left")
    own = own.join(found.select(F.col("u").alias("rep"), "v"), "rep", "left").select("doc_id", "n", F.coalesce("v", "rep").alias("component_id"))
    own = own.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return own.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@register("op2_near_dups")
def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over shingles of two words."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
