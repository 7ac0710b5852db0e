"""BM25 over an inverted index, with upper bounds per term for the top ``k``.

The index holds one row per record with its words and their counts, of which the part of the
score that a single record decides (``weight``) follows, and one row per term with what all
records decide: the document frequency, the largest weight, and the ``k``-th largest. The last
gives every query a floor that its best ``k`` records reach with one term alone. Terms whose
largest scores together stay below the floor cannot bring in a record: their long lists are
only looked up for the records that other terms have found.

Queries are sent to the records, which are read in place; scores of a batch of records are added up
in a matrix, and only the best ``k`` of a query leave a task. There is no row per query and
record, and none per posting. More queries than a task holds meet the records block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rostrum.functions.text import word_tokens
from rostrum.session import materialize, stored

# The usual saturation and length parameters.
K1, B = 1.2, 0.75
PLACES = 9
SLACK = 10.0 ** -PLACES
#: Words and scopes, and terms of queries, that are sent to the records: at most so many rows (some 10 MB).
MEMORY_ROWS = 1 << 17
#: Records of a block of the grid; scores that are added up at a time.
RECORD_ROWS, SCORES = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Index:
    """``records``: scope, rec_id, len, mean, terms, counts, weights. ``terms``: scope, term, idf, most, floor. ``k`` is what the floors hold for.

    Weights are null where counts and lengths give them. Of an id that repeats they are the sums over its
    lengths, and counts say in how many of these a term occurs.
    """

    records: DataFrame
    terms: DataFrame
    scoped: bool
    k: int
    k1: float = K1
    b: float = B

    @property
    def postings(self) -> DataFrame:
        """scope, term, rec_id, weight."""
        weight = F.transform("counts", lambda n: n * (self.k1 + 1) / (n + self.k1 * (1 - self.b + self.b * F.col("len") / F.col("mean"))))
        rows = self.records.withColumn("_w", F.coalesce("weights", weight))
        return rows.select("scope", "rec_id", F.inline(F.arrays_zip("terms", "_w")).alias("term", "weight")).select(
            "scope", "term", "rec_id", "weight")


def _scope(scoped: bool) -> Column:
    return F.col("lecture_key") if scoped else F.lit("")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """Marked as sent to all tasks if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _counted(docs: DataFrame, known: list[str] | None = None) -> DataFrame:
    """``scope, rec_id, len, terms, counts`` from ``scope, rec_id`` and the words of a record, counted within its row.

    Terms stand in their order, so that equal texts give equal sums. ``known``: only these.
    """
    kinds = docs.schema
    out = T.StructType([T.StructField("scope", kinds["scope"].dataType), T.StructField("rec_id", kinds["rec_id"].dataType),
                        T.StructField("len", T.IntegerType()), T.StructField("terms", T.ArrayType(T.StringType())),
                        T.StructField("counts", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(out)
    wanted = None if known is None else pa.array(sorted(known), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            size = np.asarray(lists.value_lengths()).astype(np.int64)
            row, flat, names = np.repeat(np.arange(len(size)), size), lists.flatten(), wanted
            if wanted is None:
                coded = flat.dictionary_encode()
                order = pc.sort_indices(coded.dictionary)
                names, place = coded.dictionary.take(order), np.empty(len(order), dtype=np.int64)
                place[np.asarray(order)] = np.arange(len(order))
                code = place[np.asarray(coded.indices)]
            else:
                code = np.asarray(pc.index_in(flat, value_set=wanted).fill_null(-1)).astype(np.int64)
                row, code = row[code >= 0], code[code >= 0]
            n = max(1, len(names))
            pair, tf = np.unique(row * n + code, return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) * n), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(size, pa.int32()), pa.ListArray.from_arrays(ends, names.take(pa.array(pair % n))).cast(arrow.field("terms").type),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())).cast(arrow.field("counts").type)], schema=arrow)

    return docs.mapInArrow(run, out)


def _put_together(rows: DataFrame, k1: float, b: float) -> DataFrame:
    """The rows of each id as one: the counts of equal lengths are added up, then the weights of all lengths."""
    rows = rows.select("scope", "rec_id", "len", "mean", "terms", "counts").repartition("scope", "rec_id").sortWithinPartitions("scope", "rec_id", "len")
    out = T.StructType([*(rows.schema[c] for c in rows.columns), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, length, tf, weights, lengths = None, None, {}, {}, {}

        def close_length():
            for t, n in tf.items():
                weights[t] = weights.get(t, 0.0) + n * (k1 + 1) / (n + k1 * (1 - b + b * length / at[2]))
                lengths[t] = lengths.get(t, 0) + 1
            tf.clear()

        def close_id():
            close_length()
            terms = sorted(weights)
            values = [at[0], at[1], length, at[2], terms, [lengths[t] for t in terms], [weights[t] for t in terms]]
            weights.clear()
            lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        for batch in batches:
            for scope, rec, n, mean, terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and at[:2] != (scope, rec):
                    yield close_id()
                elif at is not None and n != length:
                    close_length()
                at, length = (scope, rec, mean), n
                for t, c in zip(terms, counts):
                    tf[t] = tf.get(t, 0) + c
        if at is not None:
            yield close_id()

    return rows.mapInArrow(run, out)


def asked_words(queries: DataFrame, question: str = "question") -> DataFrame:
    return queries.select(F.explode(word_tokens(question)).alias("term")).distinct()


READ = ["scope", "rec_id", "len", "mean", "terms", "counts", "weights"]


def _weights(b: pa.RecordBatch, k1: float, b_: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of each record of a batch (columns ``READ``); their weights and how many records they stand for."""
    size = np.asarray(b.column(4).value_lengths()).astype(np.int64)
    counts = np.asarray(b.column(5).flatten()).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):  # a mean of 0 has no postings
        norm = k1 * (1 - b_ + b_ * np.asarray(b.column(2)) / np.asarray(b.column(3)))
    weight, df = counts * (k1 + 1) / (counts + np.repeat(norm, size)), np.ones(len(counts), dtype=np.int64)
    if b.column(6).null_count < len(b):
        own = np.repeat(np.asarray(b.column(6).is_valid()), size)
        weight[own], df[own] = np.asarray(b.column(6).flatten()), counts[own]
    return size, weight, df


def _bounds(index: Index) -> DataFrame:
    """``scope, term, df, weight``: the ``k`` largest weights of a term in each batch of records, one of them with its document frequency there."""
    k, k1, b_ = index.k, index.k1, index.b
    out = T.StructType([index.records.schema["scope"], T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("weight", T.DoubleType())])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, weight, df = _weights(b, k1, b_)
            if not len(weight):
                continue
            scopes, terms = b.column(0).dictionary_encode(), b.column(4).flatten().dictionary_encode()
            n = len(terms.dictionary)
            key = np.repeat(np.asarray(scopes.indices).astype(np.int64), size) * n + np.asarray(terms.indices)
            order = np.lexsort((-weight, key))
            key, weight = key[order], weight[order]
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            total = np.zeros(len(key), dtype=np.int64)
            total[first] = np.add.reduceat(df[order], first)
            kept = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) < k
            key = key[kept]
            yield pa.RecordBatch.from_arrays(
                [scopes.dictionary.take(pa.array(key // n)), terms.dictionary.take(pa.array(key % n)), pa.array(total[kept]), pa.array(weight[kept])], schema=arrow)

    return index.records.select(READ).mapInArrow(run, out)


def build_index(
    records: DataFrame, *, text: str = "text", scoped: bool = False, k: int = 10, k1: float = K1, b: float = B, words: DataFrame | None = None
) -> Index:
    """Index of ``lecture_key, rec_id`` and a text; with ``scoped`` every lecture has its own statistics.

    Records without words count as records, but are never found. Null texts are empty, null lectures in no scope.
    ``words`` (``term``) names the words that will be asked for, see ``asked_words``: others get no postings (if
    no more than ``MEMORY_ROWS`` are named), though they count in the length of their records. The words of a record are
    counted within its row, which is stored as one; rows are only brought together where an id repeats.
    """
    docs = records.select(_scope(scoped).alias("scope"), "rec_id", word_tokens(text).alias("_w")).where("scope IS NOT NULL")
    known = None
    if words is not None:
        few = words.select("term").where("term IS NOT NULL").distinct().limit(MEMORY_ROWS + 1).toArrow().column(0).to_pylist()
        known = few if len(few) <= MEMORY_ROWS else None
    rows = stored(_counted(docs, known))
    sizes = materialize(rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")))
    sizes = _sent(sizes, MEMORY_ROWS)
    rows = rows.join(sizes.drop("n"), "scope")
    again = materialize(rows.groupBy("scope", "rec_id").count().where("count > 1").select(F.col("scope").alias("_s"), F.col("rec_id").alias("_i")))
    single = rows.withColumn("weights", F.lit(None).cast("array<double>"))
    if again.limit(1).count():
        again = _sent(again, MEMORY_ROWS)
        same = (F.col("scope") == F.col("_s")) & F.col("rec_id").eqNullSafe(F.col("_i"))
        several = stored(_put_together(rows.join(again, same, "left_semi"), k1, b))
        single = single.join(again, same, "left_anti").select(READ).unionByName(several)
    index = Index(single.select(READ), rows, scoped, k, k1, b)
    found = stored(_bounds(index))
    by_term = found.groupBy("scope", "term").agg(F.sum("df").alias("_df"), F.max("weight").alias("most")).join(sizes, "scope")
    idf = F.log(1 + (F.col("n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    by_term = by_term.select("scope", "term", idf.alias("idf"), "most")
    order = F.row_number().over(Window.partitionBy("scope", "term").orderBy(F.desc("weight")))
    kth = found.select("scope", "term", "weight").withColumn("_r", order).where(F.col("_r") <= k).groupBy("scope", "term").agg(
        F.min(F.when(F.col("_r") == k, F.col("weight"))).alias("kth"))
    terms = by_term.join(kth, ["scope", "term"]).select(
        "scope", "term", "idf", (F.col("idf") * F.col("most")).alias("most"), F.coalesce(F.col("idf") * F.col("kth"), F.lit(0.0)).alias("floor"))
    return replace(index, terms=materialize(terms))


def query_terms(index: Index, queries: DataFrame, question: str = "question") -> DataFrame:
    """Distinct known terms of every query with their bounds; ``essential`` ones can bring in a record.

    From the lowest bound up, terms are not essential as long as their bounds add up to less than the
    query's floor. The slack covers what rounding could add.
    """
    q = queries.select("query_id", _scope(index.scoped).alias("scope"), F.explode(F.array_distinct(word_tokens(question))).alias("term"))
    q = q.join(index.terms, ["scope", "term"])
    floor = F.max("floor").over(Window.partitionBy("query_id", "scope"))
    so_far = F.sum("most").over(Window.partitionBy("query_id", "scope").orderBy("most", "term"))
    q = q.withColumns({"_floor": floor, "_sum": so_far})
    return q.withColumn("essential", F.col("_sum") * (1 + 1e-9) + SLACK >= F.col("_floor")).drop("floor")


def score_pairs(index: Index, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score that ``terms`` (``query_id, scope, term, idf``) give the records of ``query_id, scope, rec_id``, where above 0."""
    pairs = materialize(pairs)
    some = _sent(terms.select("scope", "term").distinct(), MEMORY_ROWS)
    wanted = pairs.join(terms.select("query_id", "scope", "term", "idf"), ["query_id", "scope"])
    index = replace(index, records=index.records.join(_sent(pairs.select("scope", "rec_id").distinct(), MEMORY_ROWS), ["scope", "rec_id"], "left_semi").select(READ))
    found = wanted.join(index.postings.join(some, ["scope", "term"], "left_semi"), ["scope", "term", "rec_id"])
    return found.groupBy("query_id", "scope", "rec_id").agg(F.sum(F.col("idf") * F.col("weight")).alias("part"))


class Best:
    """The best ``k`` records so far of the queries of one scope, from rows of ``_packed``."""

    def __init__(self, queries: list[dict], k: int):
        self.ids, self.k = [q["query_id"] for q in queries], k
        self.bar = np.array([q["floor"] * (1 - 1e-9) - 2 * SLACK for q in queries])  # at least so much has the k-th best
        self.rest = np.array([q["rest"] for q in queries])  # what terms that bring in no record may add
        self.found: list[list[tuple]] = [[] for _ in queries]  # (-score, record), best first
        lists: tuple[dict, dict] = ({}, {})
        for i, q in enumerate(queries):
            for w in q["words"]:
                lists[w["essential"]].setdefault(w["term"], []).append((i, w["idf"]))
        terms = sorted(lists[0].keys() | lists[1].keys())
        self.terms = pa.array(terms, pa.string())
        self.common, self.essential = ([(np.array([i for i, _ in x[t]])[:, None], np.array([w for _, w in x[t]])[:, None]) if t in x else None for t in terms]
                                       for x in lists)

    @staticmethod
    def add_up(scores: np.ndarray, asked: list, code: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
        """Add the part of every posting (sorted by term) to the scores of the queries that ask for it."""
        cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)).tolist() if len(code) else []
        for lo, hi in zip(cuts, cuts[1:]):
            if (found := asked[code[lo]]) is not None:
                scores[found[0], row[lo:hi]] += found[1] * weight[lo:hi]

    def add(self, ids: list, size: np.ndarray, terms: pa.Array, weight: np.ndarray) -> None:
        """Records, the number of their postings, and the term and weight of each."""
        code = np.asarray(pc.index_in(terms, value_set=self.terms).fill_null(-1)).astype(np.int64)
        ends, step = np.append(0, np.cumsum(size)), max(1, SCORES // len(self.ids))
        for at in range(0, len(ids), step):
            part = slice(ends[at], ends[min(at + step, len(ids))])
            row = np.repeat(np.arange(len(size[at:at + step])), size[at:at + step])
            order = np.argsort(code[part], kind="stable")
            order = order[np.searchsorted(code[part][order], 0):]
            c, w, row = code[part][order], weight[part][order], row[order]
            scores = np.zeros((len(self.ids), len(size[at:at + step])))
            self.add_up(scores, self.essential, c, row, w)
            reach = (scores > 0) & ((scores + self.rest[:, None]) * (1 + 1e-9) + SLACK >= self.bar[:, None])
            more = (reach & (self.rest > 0)[:, None]).any(0)[row]
            self.add_up(scores, self.common, c[more], row[more], w[more])
            scores = np.round(scores, PLACES)
            reach &= scores >= self.bar[:, None]
            for q in np.flatnonzero(reach.any(1)):
                hits = np.flatnonzero(reach[q])
                if len(hits) > self.k:
                    hits = hits[scores[q, hits] >= np.partition(scores[q, hits], -self.k)[-self.k]]
                best = self.found[q] + [(-scores[q, h], ids[at + h]) for h in hits.tolist()]
                best.sort(key=lambda r: (r[0], r[1] is not None, r[1]))
                del best[self.k:]
                self.found[q] = best
                if len(best) == self.k:
                    self.bar[q] = -best[-1][0]


def _packed(terms: DataFrame) -> DataFrame:
    """One row per query and scope of ``query_terms``."""
    one = terms.groupBy("query_id", "scope", "term").agg(
        F.sum("idf").alias("idf"), F.sum("most").alias("most"), F.max("_floor").alias("floor"), F.max("essential").alias("essential"))
    return one.groupBy("query_id", "scope").agg(
        F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("essential"), F.col("most"))), F.lit(0.0)).alias("rest"),
        F.collect_list(F.struct("term", "idf", "essential")).alias("words"))


def _blocks(queries: list[dict], k: int) -> dict[str, Best]:
    by_scope: dict[str, list] = {}
    for q in queries:
        by_scope.setdefault(q["scope"], []).append(q)
    return {scope: Best(own, k) for scope, own in by_scope.items()}


def _feed(blocks: dict[str, Best], b: pa.RecordBatch, k1: float, b_: float) -> None:
    """Score a batch of records (columns ``READ``) against the queries of their scopes."""
    size, weight, _ = _weights(b, k1, b_)
    scopes, ids, terms = b.column(0).dictionary_encode(), b.column(1).to_pylist(), b.column(4).flatten()
    code = np.asarray(scopes.indices)
    if len(scopes.dictionary) > 1:
        order = np.argsort(code, kind="stable")
        starts = np.cumsum(size) - size
        code, size, ids = code[order], size[order], [ids[i] for i in order.tolist()]
        moved = np.repeat(starts[order] - (np.cumsum(size) - size), size) + np.arange(len(weight))
        weight, terms = weight[moved], terms.take(pa.array(moved))
    ends = np.append(0, np.cumsum(size))
    cuts = [*np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist(), len(code)] if len(code) else []
    for lo, hi in zip(cuts, cuts[1:]):
        if (best := blocks.get(scopes.dictionary[int(code[lo])].as_py())) is not None:
            s, e = int(ends[lo]), int(ends[hi])
            best.add(ids[lo:hi], size[lo:hi], terms.slice(s, e - s), weight[s:e])


def _rows(blocks: dict[str, Best], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    for scope, best in blocks.items():
        for at in range(0, len(best.ids), 256):
            got = [(q, scope, r, -s) for q, found in zip(best.ids[at:at + 256], best.found[at:at + 256]) for s, r in found]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), arrow)], schema=arrow)


def _met_in_grid(packed: DataFrame, index: Index, out: T.StructType, k: int) -> DataFrame:
    """Blocks of queries and of records of a scope meet in cells; a cell reads its queries, then streams its records."""
    k1, b_, arrow = index.k1, index.b, to_arrow_schema(out)

    def blocks_of(df: DataFrame, size: Column, rows: int, name: str) -> DataFrame:
        return df.groupBy("scope").agg(F.ceil(F.sum(size) / F.lit(rows)).cast("long").alias(name))

    grid = materialize(blocks_of(packed, F.size("words"), MEMORY_ROWS, "_nq").join(blocks_of(index.records, F.lit(1), RECORD_ROWS, "_nr"), "scope"))
    grid = _sent(grid, MEMORY_ROWS)

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    # A seed of its own, so that the cell of a row is not tied to the partition that it comes from.
    q = packed.join(grid, "scope").select(F.lit(0).alias("_side"), "scope", F.pmod(F.xxhash64("query_id", F.lit("cell")), F.col("_nq")).alias("_cq"),
                                          every("_nr").alias("_cr"), "query_id", "floor", "rest", "words")
    r = index.records.join(grid, "scope").select(F.lit(1).alias("_side"), "scope", every("_nq").alias("_cq"),
                                                 F.pmod(F.xxhash64("rec_id", F.lit("cell")), F.col("_nr")).alias("_cr"), *READ[1:])
    cells = q.unionByName(r, allowMissingColumns=True).repartition("scope", "_cq", "_cr").sortWithinPartitions("scope", "_cq", "_cr", "_side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, blocks = None, [], {}
        for b in batches:
            marks = list(zip(*(b.column(c).to_pylist() for c in ("scope", "_cq", "_cr", "_side"))))
            cuts = [i for i in range(len(marks)) if not i or marks[i] != marks[i - 1]] + [len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                part, mark = b.slice(lo, hi - lo), marks[lo]
                if mark[:3] != cell:
                    yield from _rows(blocks, arrow)
                    cell, waiting, blocks = mark[:3], [], {}
                if mark[3] == 0:
                    waiting += part.select(["query_id", "scope", "floor", "rest", "words"]).to_pylist()
                    continue
                if waiting:
                    blocks, waiting = _blocks(waiting, k), []
                _feed(blocks, part.select(READ), k1, b_)
        yield from _rows(blocks, arrow)

    return cells.mapInArrow(run, out)


def _sent_to_records(few: pa.Table, index: Index, out: T.StructType, k: int) -> DataFrame:
    k1, b_, arrow = index.k1, index.b, to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(few.to_pylist(), k)
        for b in batches:
            _feed(blocks, b, k1, b_)
        yield from _rows(blocks, arrow)

    return index.records.select(READ).mapInArrow(run, out)


def search(index: Index, queries: DataFrame, *, question: str = "question", top_k: int | None = None) -> DataFrame:
    """``query_id, lecture_key, rec_id, score, rank``: the best records that share a word with the query.

    ``lecture_key`` is the scope, empty for an index over everything. Ties go to the lower ``rec_id``.
    """
    top_k = top_k or index.k
    if top_k > index.k:
        raise ValueError(f"the index was built for {index.k} results")
    terms = materialize(query_terms(index, queries, question))
    kinds = terms.schema
    out = T.StructType([T.StructField("query_id", kinds["query_id"].dataType), T.StructField("lecture_key", kinds["scope"].dataType),
                        T.StructField("rec_id", index.records.schema["rec_id"].dataType), T.StructField("score", T.DoubleType())])
    if terms.limit(MEMORY_ROWS + 1).count() <= MEMORY_ROWS:
        lists = _sent_to_records(_packed(terms).toArrow(), index, out, top_k)
    else:
        lists = _met_in_grid(_packed(terms), index, out, top_k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= top_k)


def rerank_by_index(index: Index, hits: DataFrame, queries: DataFrame, *, top_n: int | None = None, question: str = "question") -> DataFrame:
    """Sort the hits of a first stage by BM25; hits without a common word score 0, equal scores keep their order."""
    terms = query_terms(index, queries, question)
    pairs = hits.select("query_id", _scope(index.scoped).alias("scope"), "rec_id")
    scored = score_pairs(index, terms, pairs).select("query_id", "rec_id", F.round("part", PLACES).alias("rerank_score"))
    out = hits.join(scored, ["query_id", "rec_id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank"))
    out = out.withColumn("_n", rank).drop("rank").withColumnRenamed("_n", "rank")
    return out if top_n is None else out.where(F.col("rank") <= top_n)
