"""Topic trees over ordered blocks: context, divisive splits, leaves, summaries, boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from rostrum.functions.text import BLANK, ordered_text, strip, word_tokens
from rostrum.functions.vectors import add, dot, subtract, unit
from rostrum.plans import ordered
from rostrum.plans.ordered import (
    Rows, ancestors, attach_per_key, has_long_key, map_sorted_groups, ordered_scan, pick, row_block,
)
from rostrum.session import materialize

# Defaults of the split, and the number of terms in the stand-in summary.
MIN_SEGMENT_SIZE = 5
CONTEXT_WIDTH = 4
SUMMARY_TERMS = 24

# A node of up to this many blocks, and of this many numbers in their vectors (100 MB), is finished inside
# one task; larger ones are split by Spark jobs, level by level. Trees lean, so a level takes little off a
# large node: what one task can hold must not be split in this way.
LOCAL_NODE_ROWS, LOCAL_NODE_VALUES = 1 << 17, 768 << 14

# Counts of terms in leaves that one task adds up along the tree of a lecture (some 400 MB). Every part of a
# lecture has a row per node, so parts of a fixed size make more of these than the input grows: few, large parts.
LOCAL_TERM_ROWS = 1 << 22

# Terms that are told to all tasks, those found in most texts: at most so many (some 3 MB).
KNOWN_TERMS = 1 << 17

KEY = ["lecture_key"]
NODE_SCHEMA = ("lecture_key string, path string, depth int, lo long, hi long, is_leaf boolean, "
               "split_at long, delta double")


def context_blocks(entries: DataFrame, *, width: int = CONTEXT_WIDTH) -> DataFrame:
    """Each entry's ``composite`` with up to ``width`` entries before it; ``idx`` is dense."""
    keys, rows = list(KEY), entries
    if has_long_key(entries, KEY):
        # The last rows of a block are repeated at the head of the next one.
        own = row_block("idx")
        reach = F.expr(f"(idx + {width}) div {ordered.BLOCK_ROWS}")
        rows = entries.withColumn("_own", own).withColumn("_blk", F.explode(F.sequence(own, reach)))
        keys.append("_blk")
    frame = Window.partitionBy(*keys).orderBy("idx").rowsBetween(-width, 0)
    out = rows.withColumn("convo", F.array_join(F.collect_list("composite").over(frame), "\n"))
    if len(keys) > 1:
        out = out.where(F.col("_own") == F.col("_blk")).drop("_own", "_blk")
    return out


def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dim


def _bags(size: np.ndarray, coded: pa.DictionaryArray, dim: int, blank: np.ndarray | None = None) -> pa.Array:
    """Unit vectors of texts of ``size`` words; those marked ``blank`` get that of the stand-in for no text."""
    # Each word of a batch is hashed once, however often it is used.
    hashed = [_bucket(w, dim) for w in coded.dictionary.to_pylist()]
    place = np.repeat(np.arange(len(size)), size) * dim + np.array(hashed, dtype=np.int64)[np.asarray(coded.indices)]
    counts = np.bincount(place, minlength=len(size) * dim).astype(float).reshape(-1, dim)
    if blank is not None:
        counts[blank, _bucket(BLANK.strip("<>"), dim)] = 1.0
    length = np.sqrt((counts * counts).sum(1, keepdims=True))
    unit_length = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
    ends = np.arange(len(size) + 1, dtype=np.int32) * dim
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(unit_length.ravel()))


def _bag_vectors(dim: int):
    @F.arrow_udf(ArrayType(DoubleType()))
    def vectors(words: pa.Array) -> pa.Array:
        size = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
        return _bags(size, words.flatten().dictionary_encode(), dim)

    return vectors


def hashed_embedding(texts: DataFrame, text: str = "text", *, dim: int = 64) -> DataFrame:
    """Default text vector: hashed bag of words of unit length. A model's vectors take its place.

    Computed within the row, so that embedding a corpus needs no shuffle: words are found by Spark,
    hashed and counted a batch of rows at a time.
    """
    return texts.withColumn("embedding", _bag_vectors(dim)(word_tokens(text)))


def best_cut(prefix: np.ndarray, squares: np.ndarray, lo: int, hi: int, min_size: int, balance: float):
    """First cut with the least error of both sides: (last index of the left side, loss - unsplit loss).

    ``prefix[k]`` and ``squares[k]`` sum vectors and squared lengths before position k.
    """
    at = np.arange(lo + min_size, hi - min_size + 2)
    m0, m1 = at - lo, hi + 1 - at
    left, right = prefix[at] - prefix[lo], prefix[hi + 1] - prefix[at]
    loss = (squares[hi + 1] - squares[lo]) - (left * left).sum(1) / m0 - (right * right).sum(1) / m1
    loss = loss + balance * (m0.astype(float) ** 2 + m1.astype(float) ** 2)
    k = int(np.argmin(loss))
    whole, m = prefix[hi + 1] - prefix[lo], hi + 1 - lo
    base = (squares[hi + 1] - squares[lo]) - (whole * whole).sum() / m + balance * float(m) ** 2
    return int(at[k]) - 1, float(loss[k] - base)


def _grow(min_size: int, balance: float) -> Callable[[Rows], Rows]:
    """All nodes below one node whose blocks are given in order."""

    def grow(rows: Rows) -> Rows:
        vectors = np.stack(rows["embedding"]).astype(float)
        prefix = np.vstack([np.zeros(vectors.shape[1]), vectors.cumsum(0)])
        squares = np.concatenate([[0.0], (vectors * vectors).sum(1).cumsum()])
        first, out, todo = int(rows["i"][0]), [], [(rows["path"][0], 0, len(vectors) - 1)]
        while todo:
            path, lo, hi = todo.pop()
            leaf = hi - lo + 1 < 2 * min_size
            cut, delta = (None, None) if leaf else best_cut(prefix, squares, lo, hi, min_size, balance)
            out.append((rows["lecture_key"][0], path, len(path) - 1, first + lo, first + hi, leaf,
                        None if leaf else first + cut, delta))
            if not leaf:
                todo += [(path + "L", lo, cut), (path + "R", cut + 1, hi)]
        names = ["lecture_key", "path", "depth", "lo", "hi", "is_leaf", "split_at", "delta"]
        return dict(zip(names, map(list, zip(*out))))

    return grow


def segment_tree(
    blocks: DataFrame, *, min_size: int = MIN_SEGMENT_SIZE, balance: float = 0.0, local_rows: int | None = None
) -> DataFrame:
    """Divisive segmentation: split every run of ``2 * min_size`` or more blocks in two.

    Input ``lecture_key, i, embedding`` with dense 0-based ``i``. A split minimises the
    squared error within both sides plus ``balance`` times their squared sizes; the first
    minimum wins. A lecture too short to split is one leaf ``*``.
    """
    rows = blocks.select(*KEY, "i", "embedding")
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if local_rows is None:
        local_rows = LOCAL_NODE_ROWS
        if most > LOCAL_NODE_VALUES >> 10:  # no more of them fit if they had over 1,024 numbers
            numbers = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
            local_rows = min(local_rows, max(LOCAL_NODE_VALUES // max(numbers, 1), 1))
    if most <= local_rows:
        start = rows.withColumn("path", F.lit("*"))
        return map_sorted_groups(start, [*KEY, "path"], ["i"], _grow(min_size, balance), NODE_SCHEMA)

    placed, upper = _split_large(rows, sizes, min_size, balance, local_rows)
    small = rows.join(placed, [*KEY, "i"], "left").withColumn("path", F.coalesce("path", F.lit("*")))
    lower = map_sorted_groups(small, [*KEY, "path"], ["i"], _grow(min_size, balance), NODE_SCHEMA)
    return upper.unionByName(lower)


def prefix_sums(rows: DataFrame) -> DataFrame:
    """Running vector sum ``p`` and running sum of squared lengths ``q`` up to each block."""

    def inside(group: Rows) -> Rows:
        v = np.stack(group["embedding"]).astype(float)
        return {**pick(group, ["lecture_key", "_blk", "i"]), "p": list(v.cumsum(0)), "q": (v * v).sum(1).cumsum()}

    blocked = rows.withColumn("_blk", row_block("i"))
    part = materialize(map_sorted_groups(blocked, [*KEY, "_blk"], ["i"], inside,
                                         "lecture_key string, _blk long, i long, p array<double>, q double"))
    ends = part.groupBy(*KEY, "_blk").agg(F.max_by(F.struct("p", "q"), "i").alias("e"))
    before = Window.partitionBy(*KEY, "dim").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    dims = ends.select(*KEY, "_blk", F.posexplode(F.concat("e.p", F.array("e.q"))).alias("dim", "v"))
    dims = dims.withColumn("c", F.coalesce(F.sum("v").over(before), F.lit(0.0)))
    carry = dims.groupBy(*KEY, "_blk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda s: s["c"]).alias("c"))
    joined = part.join(carry, [*KEY, "_blk"])
    return joined.select(*KEY, "i", add(F.col("p"), F.slice("c", 1, F.size("p"))).alias("p"),
                         (F.col("q") + F.element_at("c", -1)).alias("q"))


def _split_large(rows: DataFrame, sizes: DataFrame, min_size: int, balance: float, local_rows: int):
    """Split all nodes above ``local_rows`` blocks, one level of all lectures per round.

    Returns the node path of every block of the lectures concerned, and the split nodes.
    """
    long_keys = sizes.where(F.col("n") > local_rows)
    prefix = materialize(prefix_sums(rows.join(long_keys.select(*KEY), KEY, "left_semi")))
    open_ = materialize(long_keys.select(*KEY, F.lit("*").alias("path"), F.lit(0).cast("long").alias("lo"),
                                         (F.col("n") - 1).alias("hi")))
    where = materialize(prefix.select(*KEY, "i", F.lit("*").alias("path")))
    done_rows, done_nodes = None, None
    while True:
        at_lo = prefix.select(*KEY, (F.col("i") + 1).alias("lo"), F.col("p").alias("p_lo"), F.col("q").alias("q_lo"))
        at_hi = prefix.select(*KEY, F.col("i").alias("hi"), F.col("p").alias("p_hi"), F.col("q").alias("q_hi"))
        nodes = open_.join(at_hi, [*KEY, "hi"]).join(at_lo, [*KEY, "lo"], "left").withColumns({
            "p_lo": F.coalesce("p_lo", F.transform("p_hi", lambda _: F.lit(0.0))),
            "q_lo": F.coalesce("q_lo", F.lit(0.0))})
        cand = attach_per_key(where.join(prefix, [*KEY, "i"]), nodes, [*KEY, "path"], row_block("i"), "inner")
        cand = cand.where((F.col("i") >= F.col("lo") + min_size - 1) & (F.col("i") <= F.col("hi") - min_size))
        m0, m1 = F.col("i") - F.col("lo") + 1, F.col("hi") - F.col("i")
        left, right = subtract(F.col("p"), F.col("p_lo")), subtract(F.col("p_hi"), F.col("p"))
        loss = ((F.col("q_hi") - F.col("q_lo")) - dot(left, left) / m0 - dot(right, right) / m1
                + balance * (m0 * m0 + m1 * m1))
        whole, m = subtract(F.col("p_hi"), F.col("p_lo")), F.col("hi") - F.col("lo") + 1
        base = (F.col("q_hi") - F.col("q_lo")) - dot(whole, whole) / m + balance * m * m
        best = cand.select(*KEY, "path", "lo", "hi", "i", loss.alias("loss"), base.alias("base"))
        best = materialize(best.groupBy(*KEY, "path", "lo", "hi").agg(
            F.min(F.struct("loss", "i")).alias("b"), F.first("base").alias("base")
        ).select(*KEY, "path", (F.length("path") - 1).alias("depth"), "lo", "hi", F.lit(False).alias("is_leaf"),
                 F.col("b.i").alias("split_at"), (F.col("b.loss") - F.col("base")).alias("delta")))
        done_nodes = best if done_nodes is None else done_nodes.unionByName(best)

        cuts = best.select(*KEY, "path", "split_at", "lo", "hi")
        moved = attach_per_key(where, cuts, [*KEY, "path"], row_block("i"), "inner")
        is_left = F.col("i") <= F.col("split_at")
        moved = materialize(moved.select(
            *KEY, "i", F.concat("path", F.when(is_left, F.lit("L")).otherwise(F.lit("R"))).alias("path"),
            F.when(is_left, F.col("lo")).otherwise(F.col("split_at") + 1).alias("lo"),
            F.when(is_left, F.col("split_at")).otherwise(F.col("hi")).alias("hi")))
        is_open = F.col("hi") - F.col("lo") + 1 > local_rows
        settled = moved.where(~is_open).select(*KEY, "i", "path")
        done_rows = settled if done_rows is None else done_rows.unionByName(settled)
        where = moved.where(is_open).select(*KEY, "i", "path")
        open_ = moved.where(is_open).select(*KEY, "path", "lo", "hi").distinct()
        if open_.limit(1).count() == 0:
            return done_rows, done_nodes


def limit_segments(nodes: DataFrame, k: int) -> DataFrame:
    """Cut a full tree back to at most ``k`` leaves, taking splits best first.

    A greedy queue takes the open split with the lowest delta next. A split can only be
    taken after its ancestors, so its turn is given by the run of maxima of the deltas on
    its path: the highest, then the highest after that one, down to its own. Sorting by
    that sequence reproduces the queue; ties go to the lower start.
    """
    splits = nodes.where(~F.col("is_leaf"))
    up = splits.select(*KEY, "path", "lo", F.explode(ancestors(F.col("path"))).alias("anc"))
    deltas = splits.select(*KEY, F.col("path").alias("anc"), F.struct("delta", "lo").alias("d"))
    chain = up.join(deltas, [*KEY, "anc"]).groupBy(*KEY, "path", "lo").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.length("anc").alias("n"), "d"))), lambda s: s["d"]).alias("ds"))
    maxima = F.aggregate(
        F.reverse("ds"), F.slice("ds", 1, 0),
        lambda acc, d: F.when((F.size(acc) == 0) | (d > F.get(acc, F.lit(0))), F.concat(F.array(d), acc)).otherwise(acc))
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("rank", F.length("path"), "lo"))
    taken = chain.select(*KEY, "path", "lo", maxima.alias("rank")).withColumn("turn", turn).where(F.col("turn") <= k - 1)
    taken = taken.select(*KEY, F.col("path").alias("_taken"))
    kept = nodes.join(taken.withColumnRenamed("_taken", "path").withColumn("_split", F.lit(True)), [*KEY, "path"], "left")
    parent = F.when(F.col("depth") > 0, F.expr("left(path, length(path) - 1)"))
    kept = kept.withColumn("_parent", parent)
    shown = kept.join(taken.withColumnRenamed("_taken", "_parent").withColumn("_in", F.lit(True)), [*KEY, "_parent"], "left")
    shown = shown.where((F.col("depth") == 0) | F.col("_in"))
    split = F.coalesce("_split", F.lit(False))
    return shown.select(*KEY, "path", "depth", "lo", "hi", (~split).alias("is_leaf"),
                        F.when(split, F.col("split_at")).alias("split_at"), F.when(split, F.col("delta")).alias("delta"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Leaves numbered from 1, left to right."""
    return ordered_scan(nodes.where("is_leaf"), KEY, "lo", number="_n").withColumn("segment_id", F.col("_n") + 1).drop("_n")


def leaf_walk(nodes: DataFrame, *, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Leaves in depth-first order that satisfy a predicate, at most ``limit`` per lecture."""
    kept = nodes.where("is_leaf")
    kept = kept if where is None else kept.where(where)
    # "L" sorts before "R" and leaves are never prefixes of each other.
    if limit is None:
        return ordered_scan(kept, KEY, "lo", number="visit")
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy("lo"))
    return kept.withColumn("visit", turn.cast("long") - 1).where(F.col("visit") < limit)


def leaf_flags(nodes: DataFrame, *, side: str = "first") -> DataFrame:
    """A 0/1 flag per block: ``first`` marks the start of each later leaf, ``last`` the end of each earlier one."""
    ends = ordered_scan(nodes.where("is_leaf"), KEY, "lo", totals={"_max": ("max", F.col("hi"))})
    at = ends.select(*KEY, "lo", "hi", "_max", F.explode(F.sequence("lo", "hi")).alias("i"))
    mark = (F.col("i") == F.col("lo")) & (F.col("lo") > 0) if side == "first" else \
        (F.col("i") == F.col("hi")) & (F.col("hi") < F.col("_max"))
    return at.select(*KEY, "i", mark.cast("int").alias("flag"))


def _covered(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes with the count, time span and joined text of the entries they cover; a text may be empty."""
    at = nodes.select(*KEY, "path", F.explode(F.sequence("lo", "hi")).alias("idx"))
    rows = at.join(entries.select(*KEY, "idx", "start", "end", "composite"), [*KEY, "idx"])
    agg = rows.groupBy(*KEY, "path").agg(
        F.count(F.lit(1)).alias("n_utterances"), F.min_by("start", "idx").alias("start"),
        F.max_by("end", "idx").alias("end"), strip(ordered_text("composite", "\n", "idx")).alias("text"))
    return nodes.join(agg, [*KEY, "path"])


def _shown_text(text: Column) -> Column:
    return F.when(text == "", F.lit(BLANK)).otherwise(text)


def node_rows(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes with the count, time span and joined text of the entries they cover."""
    return _covered(nodes, entries).withColumn("text", _shown_text(F.col("text")))


def _count_words(dim: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Some columns and ``words`` to these columns, ``terms`` and ``tf``: words of three letters or more, counted within the row.

    With ``dim`` also the vector of all words; the column before them then tells blank texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, kept = b.column(b.num_columns - 1), b.num_columns - (1 if dim is None else 2)
            size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            n = max(len(coded.dictionary), 1)
            pair, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + np.asarray(coded.indices), return_counts=True)
            counted = np.asarray(pc.utf8_length(coded.dictionary))[pair % n] >= 3 if len(pair) else np.zeros(0, dtype=bool)
            pair, tf = pair[counted], tf[counted]
            ends = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * n).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pair % n)))
            made = [terms, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))]
            if dim is not None:
                made.append(_bags(size, coded, dim, b.column(kept).to_numpy(zero_copy_only=False).astype(bool)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:kept], *made], names=[*b.schema.names[:kept], "terms", "tf", "embedding"][:kept + len(made)])

    return run


def counted_words(rows: DataFrame, text: str, keep: list[str], dim: int | None = None) -> DataFrame:
    """``keep``, ``terms`` and ``tf``: the counts of a text are one row, and nothing is shuffled.

    With ``dim`` also its ``embedding``, from the same words: the ``hashed_embedding`` of the text as it is shown.
    """
    blank = [] if dim is None else [(F.col(text) == "").alias("_blank")]
    words = rows.select(*keep, *blank, word_tokens(text).alias("words"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in words.dtypes[:len(keep)])
    return words.mapInArrow(_count_words(dim), f"{kinds}, terms array<string>, tf array<long>" + (", embedding array<double>" if blank else ""))


def _leaf_counts(covered: DataFrame) -> DataFrame:
    """``lecture_key, leaf, n_leaves, terms, tf``: one row per leaf, from leaves with their texts. Nothing is shuffled."""
    return counted_words(covered.withColumnRenamed("path", "leaf"), "text", [*KEY, "leaf", "n_leaves"])


def _leaf_texts(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Numbered leaves with their texts and the number of leaves of their lecture."""
    leaf = leaves(nodes)
    return _covered(leaf.join(leaf.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_leaves")), KEY), entries)


def leaf_terms(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """How often each term stands in each leaf. The texts of a leaf are brought together, its words are not moved."""
    counted = _leaf_counts(_leaf_texts(nodes, entries))
    each = counted.select(*KEY, "leaf", "n_leaves", F.explode(F.arrays_zip("terms", "tf")).alias("t"))
    return each.select(*KEY, "leaf", "n_leaves", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))


def _dealt_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a leaf, a row for each part of its lecture that has some: a term is in the part that its hash names."""
    for b in batches:
        names = ["lecture_key", "leaf", "n_leaves", "_parts"]
        lecture, leaf, n_leaves, parts = (b.column(b.schema.get_field_index(c)) for c in names)
        terms, tf = (b.column(b.schema.get_field_index(c)) for c in ("terms", "tf"))
        size = np.asarray(terms.value_lengths()).astype(np.int64)
        row, term = np.repeat(np.arange(len(size)), size), terms.flatten()
        n = np.asarray(parts).astype(np.uint64)
        if not len(row):
            continue
        # Each term of a batch is hashed once, however many leaves hold it.
        coded = term.dictionary_encode()
        hashed = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
        part = (hashed[np.asarray(coded.indices)] % n[row]).astype(np.int64)
        order = np.argsort(row * int(n.max()) + part, kind="stable")
        row, part = row[order], part[order]
        starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
        ends, first = pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(row[starts])
        yield pa.RecordBatch.from_arrays(
            [lecture.take(first), leaf.take(first), n_leaves.take(first), pa.array(part[starts]),
             pa.ListArray.from_arrays(ends, term.take(pa.array(order))), pa.ListArray.from_arrays(ends, tf.flatten().take(pa.array(order)))],
            names=["lecture_key", "leaf", "n_leaves", "_part", "terms", "tf"])


def _best_terms(terms: int) -> Callable[[Rows], Rows]:
    """The best terms of all inner nodes of one lecture among some of its terms, from their counts in its leaves, left to right.

    A node is an interval of leaves, so of their counts. From a leaf upwards its sibling with fewer counts
    is added to the larger one, in one array of counts. Only terms of the smaller one rise,
    so the best of the node are among these and the best of the larger: a merge looks at no other,
    and a deep tree costs little more than a flat one.
    """

    def best(rows: Rows) -> Rows:
        # A term has one row per leaf that holds it, and all of them are here.
        code, words = pd.factorize(np.concatenate(rows["terms"]))
        turn = np.asarray(pc.sort_indices(pa.array(words, pa.string())))
        words, place = words[turn], np.empty(len(turn), dtype=np.int64)
        place[turn] = np.arange(len(turn))
        code, tf = place[code], np.concatenate(rows["tf"]).astype(np.int64)
        idf = np.log((rows["n_leaves"][0] + 1) / (np.bincount(code) + 1)) + 1
        leaf, n = rows["leaf"], len(rows["leaf"])
        ends = np.cumsum([len(t) for t in rows["terms"]]).tolist()
        # Nodes after the leaves, children first: path, range of counts, children (the one with more counts first).
        paths, lo, hi, below = list(leaf), [0, *ends[:-1]], list(ends), [()] * n
        open_: list[int] = []
        for i in range(n):
            open_.append(i)
            following = leaf[i + 1] if i + 1 < n else ""
            while len(above := paths[open_[-1]][:-1]) and not following.startswith(above):
                kids = [open_.pop()]
                if open_ and paths[open_[-1]][:-1] == above:
                    kids.append(open_.pop())
                open_.append(len(paths))
                paths.append(above)
                lo.append(lo[kids[-1]])
                hi.append(hi[kids[0]])
                below.append(tuple(sorted(kids, key=lambda k: lo[k] - hi[k])))
        counts, known = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=bool)
        out: dict[str, list] = {"lecture_key": [], "path": [], "terms": [], "scores": []}
        todo = list(open_)
        while todo:
            # Down the larger children to a leaf, and up again; what joins on the way is added to the counts of the leaf.
            way = [todo.pop()]
            while below[way[-1]]:
                way.append(below[way[-1]][0])
            at = way.pop()
            likely, ranked = code[lo[at]:hi[at]], None
            counts[likely] = tf[lo[at]:hi[at]]
            for at in reversed(way):
                if len(below[at]) > 1 or ranked is None:
                    for other in below[at][1:]:
                        new = code[lo[other]:hi[other]]
                        np.add.at(counts, new, tf[lo[other]:hi[other]])
                        if below[other]:
                            todo.append(other)
                            new = np.sort(new)
                            new = new[np.append(True, new[1:] != new[:-1])]
                        known[likely] = True
                        added = new[~known[new]]
                        known[likely] = False
                        likely = np.concatenate((likely, added))
                    score = np.round(counts[likely] * idf[likely], 6)
                    top = np.flatnonzero(score >= np.partition(score, -terms)[-terms]) if len(likely) > terms else np.arange(len(likely))
                    top = top[np.lexsort((likely[top], -score[top]))][:terms]
                    likely = likely[top]
                    ranked = words[likely].tolist(), score[top].tolist()
                out["lecture_key"].append(rows["lecture_key"][0])
                out["path"].append(paths[at])
                out["terms"].append(ranked[0])
                out["scores"].append(ranked[1])
            top_of = way[0] if way else at
            counts[code[lo[top_of]:hi[top_of]]] = 0
        return out

    return best


def key_terms(nodes: DataFrame, entries: DataFrame, *, terms: int = SUMMARY_TERMS, local_rows: int | None = None) -> DataFrame:
    """Deterministic stand-in for a summarising model: the terms that mark an inner node within its lecture.

    Every word under the node counts. Terms are counted per leaf and weighted by how few leaves of the
    lecture hold them. The counts of a lecture are added up along its tree inside a task. A lecture with
    more than ``local_rows`` of them (default ``LOCAL_TERM_ROWS``) is dealt by term over as many tasks as
    it needs; each gives the best of its terms per node, and the best of these are the node's. No text and
    no count moves to the ancestors.
    """
    counts = materialize(_leaf_counts(_leaf_texts(nodes, entries)))
    return _key_terms(nodes, counts, counts.select(*KEY, F.size("terms").alias("n_terms")), terms, local_rows)


def _key_terms(
    nodes: DataFrame, counts: DataFrame, sizes: DataFrame, terms: int = SUMMARY_TERMS, local_rows: int | None = None
) -> DataFrame:
    """``key_terms`` from the counts of leaves and their numbers of terms."""
    limit = local_rows or LOCAL_TERM_ROWS
    inner = nodes.where(~F.col("is_leaf")).select(*KEY, "path")
    # At most as many long lectures as there are limits of counts.
    long = sizes.groupBy(*KEY).agg(F.ceil(F.sum("n_terms") / F.lit(limit)).cast("long").alias("_parts")).where("_parts > 1")
    kinds = "lecture_key string, leaf string, n_leaves long, _part long, terms array<string>, tf array<long>"
    dealt = counts.join(F.broadcast(long), KEY, "left").na.fill(1, ["_parts"]).mapInArrow(_dealt_terms, kinds)
    best = map_sorted_groups(dealt, [*KEY, "_part"], ["leaf"], _best_terms(terms),
                             "lecture_key string, path string, terms array<string>, scores array<double>")
    pairs = F.flatten(F.collect_list(F.zip_with("scores", "terms", lambda s, t: F.struct((-s).alias("s"), t.alias("t")))))
    best = best.groupBy(*KEY, "path").agg(
        F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, terms), lambda p: p["t"]), " ").alias("content"))
    return inner.join(best, [*KEY, "path"], "left").withColumn("content", F.coalesce("content", F.lit(BLANK)))


def descendant_leaves(nodes: DataFrame) -> DataFrame:
    """Per node the paths of the leaves under it, left to right."""
    up = nodes.where("is_leaf").select(*KEY, F.col("path").alias("leaf"), F.explode(ancestors(F.col("path"))).alias("path"))
    return up.groupBy(*KEY, "path").agg(F.array_sort(F.collect_list("leaf")).alias("descendant_leaf_tree_paths"))


def tree_rollup(
    nodes: DataFrame, entries: DataFrame, *, combine: Callable[[Column], Column] | None = None, below: bool = True, dim: int | None = None
) -> DataFrame:
    """Contents of all nodes: a leaf's is its text, an inner node's ``combine`` of both children's.

    ``below`` lists the leaves under every node, a path for each leaf and ancestor: far more than the tree itself where that is
    deep. A search does without, as nodes of a tree share a leaf only where one path continues the other.
    ``dim`` adds the ``hashed_embedding`` of every content; the words of a leaf are found once, for its terms and its vector.
    Without ``combine`` inner nodes get their ``key_terms``, all levels at once. With it, one small job
    runs per level, deepest first; only the contents of one level are joined.
    """
    shape = materialize(nodes)
    # The texts are brought to their leaves once, for the terms, the summaries and the records.
    leaf = _leaf_texts(shape, entries)
    if combine is None or dim is not None:
        leaf = counted_words(leaf, "text", leaf.columns, dim)
    leaf = materialize(leaf if combine is None else leaf.drop("terms", "tf"))
    if combine is None:
        facts = materialize(leaf.select(*KEY, "lo", "hi", "start", "end", F.size("terms").alias("n_terms")))
        counts = leaf.select(*KEY, F.col("path").alias("leaf"), "n_leaves", "terms", "tf")
        return _with_summaries(shape, leaf.drop("terms", "tf"), _key_terms(shape, counts, facts), below, dim, facts)
    covered = leaf.select(*KEY, "path", "depth", _shown_text(F.col("text")).alias("content"))
    deepest = shape.agg(F.max("depth")).first()[0] or 0
    level = covered.where(F.col("depth") == deepest).select(*KEY, "path", "content")
    summaries = None
    for depth in range(deepest - 1, -1, -1):
        child = lambda side: F.max(F.when(F.col("path").endswith(side), F.col("content")))
        both = level.groupBy(*KEY, F.expr("left(path, length(path) - 1)").alias("parent")).agg(
            child("L").alias("a"), child("R").alias("b"))
        prompt = strip(F.concat_ws(
            "\n\n", F.when(F.col("a") != "", F.concat(F.lit("Section A:\n"), F.col("a"))),
            F.when(F.col("b") != "", F.concat(F.lit("Section B:\n"), F.col("b")))))
        prompt = F.when(prompt == "", F.lit(BLANK)).otherwise(prompt)
        made = materialize(both.select(*KEY, F.col("parent").alias("path"), combine(prompt).alias("content")))
        summaries = made if summaries is None else summaries.unionByName(made)
        level = made.unionByName(covered.where(F.col("depth") == depth).select(*KEY, "path", "content"))
    return _with_summaries(shape, leaf, summaries, below, dim, leaf)


def _with_summaries(
    shape: DataFrame, leaf: DataFrame, summaries: DataFrame | None, below: bool, dim: int | None, times: DataFrame
) -> DataFrame:
    """Leaves with their text; inner nodes with their range, times and summary, and no text of their own.

    ``node_rows`` gives the text of any node on demand. Counts and times of an inner node come from the
    first and the last leaf of its range, so no text and no row per entry moves to an ancestor. Texts stay where they are
    unless lists of leaves are asked for.
    """
    none = F.lit(None).cast("string")
    leaf = leaf.withColumns({"raw_text": _shown_text(F.col("text")), "summary_text": none}).drop("text", "n_leaves")
    inner = shape.where(~F.col("is_leaf"))
    inner = (inner.join(times.select(*KEY, "lo", "start"), [*KEY, "lo"]).join(times.select(*KEY, "hi", "end"), [*KEY, "hi"])
             .withColumns({"n_utterances": F.col("hi") - F.col("lo") + 1, "raw_text": none, "segment_id": F.lit(None).cast("long")}))
    if summaries is None:
        inner = inner.withColumn("summary_text", none)
    else:
        inner = inner.join(summaries.withColumnRenamed("content", "summary_text"), [*KEY, "path"], "left")
    if dim is not None:
        inner = hashed_embedding(inner, "summary_text", dim=dim)
    out = leaf.unionByName(inner.select(*leaf.columns))
    if not below:
        return out
    known = descendant_leaves(shape).join(leaves(shape).select(*KEY, "path", "segment_id"), [*KEY, "path"], "left")
    return out.drop("segment_id").join(known, [*KEY, "path"], "left")


def tree_records(rolled: DataFrame) -> DataFrame:
    """Searchable records of a rolled-up tree; its leaves are numbered left to right."""
    below = [c for c in ("embedding", "descendant_leaf_tree_paths") if c in rolled.columns]
    return rolled.select(
        *KEY, F.lit("summary_tree").alias("index_kind"), F.col("path").alias("tree_path"), "segment_id", "is_leaf", "depth",
        F.col("lo").alias("utterance_start"), F.col("hi").alias("utterance_end"), "n_utterances", "start", "end",
        F.when(F.col("is_leaf"), F.col("raw_text")).otherwise(F.col("summary_text")).alias("text"),
        "summary_text", "raw_text", *below)


def leaf_records(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Leaf segments as searchable records."""
    return node_rows(leaves(nodes), entries).select(
        *KEY, F.lit("leaf").alias("index_kind"), "segment_id", F.col("path").alias("tree_path"), F.lit(True).alias("is_leaf"),
        F.col("lo").alias("utterance_start"), F.col("hi").alias("utterance_end"), "n_utterances", "start", "end", "text")


def tree_statistics(records: DataFrame) -> DataFrame:
    """Per lecture: nodes, leaves, inner nodes, depth, missing summaries and embeddings."""
    inner = ~F.col("is_leaf")
    return records.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if("is_leaf").alias("n_leaves"), F.count_if(inner).alias("n_internal"),
        F.max("depth").alias("max_depth"),
        F.count_if(inner & (F.coalesce("summary_text", F.lit("")) == "")).alias("n_missing_summary"),
        F.count_if(F.col("embedding").isNull()).alias("n_missing_embedding"))


def segment_vectors(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """One unit vector per leaf: the mean of its block vectors, dimension by dimension."""
    at = leaves(nodes).select(*KEY, "segment_id", F.explode(F.sequence("lo", "hi")).alias("i"))
    dims = at.join(blocks.select(*KEY, "i", "embedding"), [*KEY, "i"]).select(
        *KEY, "segment_id", F.posexplode("embedding").alias("dim", "v"))
    means = dims.groupBy(*KEY, "segment_id", "dim").agg(F.avg("v").alias("v"))
    vec = means.groupBy(*KEY, "segment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("vector"))
    return vec.withColumn("vector", unit("vector"))


def adjacent_similarity(vectors: DataFrame) -> DataFrame:
    """Cosine of each segment's unit vector with the one before: one row per boundary."""
    scan = ordered_scan(vectors, KEY, "segment_id", lags={
        "_prev": (F.col("vector"), None), "left_segment": (F.col("segment_id"), None)})
    pairs = scan.where(F.col("_prev").isNotNull())
    return pairs.select(*KEY, (F.col("segment_id") - 1).alias("boundary_id"), "left_segment",
                        F.col("segment_id").alias("right_segment"), dot("_prev", "vector").alias("cosine"))


def _likely_terms(known: pa.Table, n_texts: int, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys, ``terms``, ``tf`` to keys, ``term``, ``tf`` of the terms that may be among the best ``top`` of their text.

    ``known`` has the terms found in most texts. Any other one is at best found in a single text; it stays
    if it could then reach the best known ones. Scores are only bounds here, so ties and roundings stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = known.column("term").combine_chunks()
        rarest = np.log((n_texts + 1) / 2) + 1
        idf = np.append(np.log((n_texts + 1) / (np.asarray(known.column("df")) + 1)) + 1, 0.0)
        for b in batches:
            lists, tf = b.column(b.num_columns - 2), np.asarray(b.column(b.num_columns - 1).flatten())
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            term = lists.flatten()
            place = np.asarray(pc.index_in(term, value_set=names).fill_null(len(names)))
            sure = tf * idf[place]
            most = np.where(place < len(names), sure, tf * rarest)
            row, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            order = np.lexsort((-sure, row))
            floor = np.zeros(len(size))
            full = size >= top
            floor[full] = sure[order][start[full] + top - 1]
            keep = np.flatnonzero(most >= floor[row] - 1e-5)
            first = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [*[c.take(first) for c in b.columns[:-2]], term.take(pa.array(keep)), pa.array(tf[keep])],
                names=[*b.schema.names[:-2], "term", "tf"])

    return run


def keyword_profile(texts: DataFrame, keys: list[str], *, top: int = 5) -> DataFrame:
    """Top terms per text by term frequency times inverse document frequency.

    Terms are counted within the row of their text and stored; only texts that share their keys over several rows
    are brought together. Document counts are combined map-side. The most frequent terms, at most ``KNOWN_TERMS``,
    are told to all tasks, which drop what cannot be among the best of a text, so no row per text and term is shuffled.
    """
    counted = counted_words(texts, "text", keys)
    if texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").limit(1).count():
        each = counted.select(*keys, F.explode(F.arrays_zip("terms", "tf")).alias("t"))
        each = each.groupBy(*keys, F.col("t.terms").alias("term")).agg(F.sum("t.tf").alias("tf"))
        counted = each.groupBy(*keys).agg(F.collect_list(F.struct("term", "tf")).alias("t")).select(
            *keys, F.col("t.term").alias("terms"), F.col("t.tf").alias("tf"))
    counted = materialize(counted)
    n_texts = texts.count()
    df = materialize(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    # Terms by the power of two that they reach: as many of the upper powers as may be told.
    powers = df.groupBy(F.floor(F.log2("df")).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).collect()
    room, least = KNOWN_TERMS, None
    for p, n in powers:
        room -= n
        if room < 0:
            break
        least = p
    known = df.where(F.lit(False) if least is None else F.floor(F.log2("df")) >= least).toArrow()
    kinds = ", ".join(f"`{c}` {t}" for c, t in counted.select(*keys).dtypes)
    tf = counted.mapInArrow(_likely_terms(known, n_texts, top), f"{kinds}, term string, tf long")
    block = F.pmod(F.xxhash64(*keys), F.lit(256))
    scored = attach_per_key(tf, df, ["term"], block, "inner", long=has_long_key(texts, []))
    idf = F.log((F.lit(n_texts) + 1) / (F.col("df") + 1)) + 1
    scored = scored.withColumn("score", F.round(F.col("tf") * idf, 6))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(*keys, "rank", "term", "tf", "df", "score")


def principal_axes(vectors: DataFrame, column: str = "vector", *, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first ``k`` principal axes (rows) and their variances.

    Tasks add up the products of coordinates of their rows; Spark adds up the tasks. What reaches the driver is one
    number per pair of coordinates, however many rows there are. An axis points to where its largest coordinate,
    the first one of those, is positive. Rows with a null vector are left out; all vectors have one length.
    """
    some = vectors.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
                x = np.hstack([x, np.ones((len(x), 1))])  # the last row and column hold sums and the count
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(n), n)), pa.array(np.tile(np.arange(n), n)), pa.array(total.ravel())], names=["a", "b", "s"])

    sums = some.mapInArrow(products, "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).toPandas()
    if not len(sums):
        return np.empty(0), np.empty((0, 0)), np.empty(0)
    size = int(sums["a"].max()) + 1
    full = np.zeros((size, size))
    full[sums["a"], sums["b"]] = sums["s"]
    n, mean = full[-1, -1], full[-1, :-1] / full[-1, -1]
    spread = (full[:-1, :-1] - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, axes = np.linalg.eigh((spread + spread.T) / 2)
    axes, values = axes.T[::-1][:k], values[::-1][:k]
    lead = np.abs(axes).round(12).argmax(1)
    return mean, axes * np.sign(axes[np.arange(len(axes)), lead])[:, None], np.maximum(values, 0.0)


def project(vectors: DataFrame, column: str = "vector", *, k: int = 2) -> DataFrame:
    """Coordinates ``pc1, pc2 ..`` along the first principal axes; null for a null vector."""
    mean, axes, _ = principal_axes(vectors, column, k=k)
    if not len(mean):
        return vectors.withColumns({f"pc{i}": F.lit(None).cast("double") for i in range(1, k + 1)})
    centred = subtract(F.col(column).cast("array<double>"), F.array(*[F.lit(float(m)) for m in mean]))
    return vectors.withColumns({f"pc{i}": dot(centred, F.array(*[F.lit(float(v)) for v in axis])) for i, axis in enumerate(axes, 1)})


def project_2d(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """First two principal components of the vectors."""
    return project(vectors, column, k=2)
